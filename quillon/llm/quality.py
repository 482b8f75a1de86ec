"""Quality rules with host verdicts, in DataFrame expressions only.

Failures are counted by host and rule. A host's failure rate for a rule is
shrunk towards the corpus by that rule's beta prior, whose two parameters come
from all hosts (method of moments), so that a host of three documents is not
condemned for one. A document goes if it breaks the base rules, two rules of
the method, or one rule that its host breaks more often than the corpus does
(HOST_EXCESS times the prior's mean, after shrinking). A document that breaks
no rule always stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WORD_BREAK, cut_lineage

WINDOW = 8
#: A host's shrunk rate of a rule over the prior's mean, from which its verdict counts.
HOST_EXCESS = 1.05
#: Method rules: name and condition over the measures of a document.
RULES = {
    "many_symbols": "n_symbols > 0.25 * n_words",
    "many_dup_lines": "n_dup_lines > 0.3 * n_lines",
    "odd_word_length": "n_words > 0 AND (word_chars < 2.0 * n_words OR word_chars > 14.0 * n_words)",
    "repeats": "n_repeat_words > 0.15 * n_words",
    "short": "n_words < 20",
}
#: Fewest and most pseudo-documents that the prior may weigh.
PRIOR_WEIGHT = (1.0, 1_000.0)


def _adjacent(values: Column, n: Column) -> tuple[Column, Column]:
    """The array moved by one to the right and to the left, with null at the open end."""
    none = F.array(F.lit(None).cast("long"))
    return F.concat(none, F.slice(values, 1, n - 1)), F.concat(F.slice(values, 2, n), none)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long).

    Null and empty texts measure 0 throughout. Words are compared by 64-bit
    hashes within one text only. Repeated rows get equal values; columns of
    docs of the same names are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    docs = docs.drop(*made)
    keep = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(
        *keep,
        F.array_remove(F.split(whole, WORD_BREAK), "").alias("__words"),
        lines.alias("__lines"),
        (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
    )
    hashed = split.select(
        *keep,
        "n_symbols",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__words", lambda x: F.xxhash64(x)).alias("__hash"),
    )
    n = F.col("n_words").cast("int")
    shifted = [F.slice("__hash", i + 1, F.greatest(n - (WINDOW - 1), F.lit(0))) for i in range(WINDOW)]
    windows = hashed.select("*", F.transform(F.arrays_zip(*shifted), lambda s: F.xxhash64(s)).alias("__key")).drop("__hash")
    # Only texts with a repeated window go on to the sort; for all others the arrays are null.
    repeated = windows.withColumn("__key", F.when(F.size(F.array_distinct("__key")) < F.size("__key"), F.col("__key")))
    place = F.sequence(F.lit(0), F.size("__key") - 1)
    ordered = repeated.withColumn("__at", F.when(F.col("__key").isNotNull(), F.sort_array(F.arrays_zip(F.col("__key").alias("k"), place.alias("p"))))).drop("__key")
    parts = ordered.select("*", F.col("__at.k").alias("__k"), F.col("__at.p").alias("__p")).drop("__at")
    before, after = _adjacent(F.col("__k"), F.size("__k"))
    beside = parts.withColumn("__all", F.when(F.col("__k").isNotNull(), F.arrays_zip(F.col("__p").alias("p"), F.col("__k").alias("k"), before.alias("b"), after.alias("a")))).drop("__k", "__p")
    twice = beside.withColumn("__starts", F.sort_array(F.filter("__all", lambda t: (t["k"] == t["b"]) | (t["k"] == t["a"]))["p"])).drop("__all")
    gaps = F.zip_with(F.slice("__starts", 2, F.size("__starts")), F.slice("__starts", 1, F.size("__starts") - 1), lambda b, a: F.least(F.lit(WINDOW), b - a))
    covered = F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda total, x: total + x)
    return twice.withColumn("n_repeat_words", F.when(F.col("__starts").isNull(), F.lit(0).cast("long")).otherwise(covered)).drop("__starts")


def host_excess(measured: DataFrame, host: str) -> DataFrame:
    """Per host: its documents and, for each rule, excess_<rule>: its shrunk failure rate over the prior's mean.

    measured has failed_<rule> (0 or 1). The priors are one row of sums over hosts.
    """
    n = F.col("host_docs").cast("double")
    failed = {rule: F.col(f"failed_{rule}").cast("double") for rule in RULES}
    hosts = measured.groupBy(F.col(f"`{host}`").alias("host")).agg(F.count("*").alias("host_docs"), *[F.sum(f"failed_{rule}").alias(f"failed_{rule}") for rule in RULES])
    square = [F.sum(k / n * k / n * n).alias(f"square_{rule}") for rule, k in failed.items()]
    sums = hosts.agg(F.sum("host_docs").alias("n"), F.count("*").alias("hosts"), *[F.sum(f"failed_{rule}").alias(f"k_{rule}") for rule in RULES], *square).first()
    out = ["host", "host_docs"]
    for rule, k in failed.items():
        alpha, beta = beta_prior(sums["n"] or 0, sums[f"k_{rule}"] or 0, sums["hosts"] or 0, sums[f"square_{rule}"] or 0.0)
        out.append(((k + F.lit(alpha)) / (n + F.lit(alpha + beta)) / F.lit(alpha / (alpha + beta))).alias(f"excess_{rule}"))
    return hosts.select(*out)


def beta_prior(n: float, k: float, hosts: float, square: float) -> tuple[float, float]:
    """Parameters of the prior by moments: n documents, k failing, square the sum of docs * rate ** 2 over hosts."""
    if not n:
        return 1.0, 1.0
    mean = min(max(k / n, 1e-6), 1 - 1e-6)
    spread = max(square / n - (k / n) ** 2, 0.0) - mean * (1 - mean) * hosts / n  # less what chance alone gives
    weight = PRIOR_WEIGHT[1] if spread <= 0 else (mean * (1 - mean) - spread) / spread
    weight = min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
    return mean * weight, (1 - mean) * weight


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", excess: float = HOST_EXCESS) -> DataFrame:
    """Per row: id, the measures, n_failed, host_excess, base_failed and kept.

    host_excess is the largest excess of the document's host among the rules
    that the document breaks, null if it breaks none. A null host is a host of
    its own. Null and empty texts break the base rules. Texts of any length are
    one row, measured whole. Rows are kept apart even with equal or null ids;
    other columns, whatever their names, don't go through. An empty table gives
    an empty result.
    """
    measured = measures(docs.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("__text"), F.col(f"`{host}`").alias("__host")), "__text").drop("__text")
    base = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
    failed = {rule: F.expr(f"CAST(({condition}) AS BIGINT)").alias(f"failed_{rule}") for rule, condition in RULES.items()}
    measured = cut_lineage(measured.select("*", F.expr(base).alias("base_failed"), *failed.values()))
    hosts = host_excess(measured, "__host").withColumnRenamed("host", "__of")
    joined = measured.join(hosts, F.col("__host").eqNullSafe(F.col("__of")), "left")
    worst = F.array_max(F.array(*[F.when(F.col(f"failed_{rule}") == 1, F.col(f"excess_{rule}")) for rule in RULES]))
    n_failed = sum((F.col(f"failed_{rule}") for rule in RULES), F.lit(0).cast("long"))
    kept = ~F.col("base_failed") & (F.col("n_failed") < 2) & ~(F.coalesce(F.col("host_excess"), F.lit(0.0)) > excess)
    joined = joined.withColumns({"n_failed": n_failed, "host_excess": worst})
    return joined.select(F.col("__id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed", "host_excess", "base_failed", kept.alias("kept"))

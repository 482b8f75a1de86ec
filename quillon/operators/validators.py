"""Checks of tables before they are used.

Each check is a small aggregation (map-side partial, one row of counts). The
functions named check_ raise ValueError on the driver from that one row; the
others give the counts or a filtered frame, so that a plan can go on.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_BINS, MIN_POSITIVES = 100, 20


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0).cast("long"))


def check(frame: DataFrame, **faults: Column) -> DataFrame:
    """frame, if it has rows and none for which a named condition holds; ValueError names the others."""
    row = frame.agg(F.count("*").alias("n"), *[count_if(F.coalesce(c, F.lit(True))).alias(name) for name, c in faults.items()]).first()
    if not row["n"]:
        raise ValueError("no rows")
    found = {name: row[name] for name in faults if row[name]}
    if found:
        raise ValueError(", ".join(f"{name}: {n} rows" for name, n in found.items()))
    return frame


def check_coordinates(bins: DataFrame, width: int) -> DataFrame:
    """bins, if (chrom, bin_start) is a key and all bins have the width, no nulls and no negative start."""
    key = ["chrom", "bin_start", "bin_end"]
    missing = [c for c in key if c not in bins.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    null = F.col("chrom").isNull() | F.col("bin_start").isNull() | F.col("bin_end").isNull()
    check(bins, null=null, width=F.col("bin_end") - F.col("bin_start") != width, negative=F.col("bin_start") < 0)
    if bins.groupBy("chrom", "bin_start").count().where("count > 1").limit(1).count():
        raise ValueError("repeated coordinates")
    return bins


def mask_values(values: Column) -> Column:
    """0 and 1 (or booleans) as booleans; anything else, null too, fails when it is read."""
    number = values.cast("double")
    return F.when(number.isin(0.0, 1.0), number == 1.0).otherwise(F.raise_error(F.concat(F.lit("not a mask value: "), F.coalesce(values.cast("string"), F.lit("null")))).cast("boolean"))


def mask_counts(frame: DataFrame, column: str) -> DataFrame:
    """One row: n, n_true and how many values are no mask values."""
    number = F.col(column).cast("double")
    return frame.agg(F.count("*").alias("n"), count_if(number == 1.0).alias("n_true"), count_if(~F.coalesce(number.isin(0.0, 1.0), F.lit(False))).alias("n_bad"))


def misaligned(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, n_a, n_b): keys that the two tables don't hold equally often. Empty: they are aligned."""
    one = a.select(*keys, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(*keys, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    return one.groupBy(*keys).agg(F.sum("in_a").cast("long").alias("n_a"), F.sum("in_b").cast("long").alias("n_b")).where("n_a <> n_b")


def check_aligned(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("chrom", "bin_start", "bin_end", "split")) -> None:
    if misaligned(a, b, keys).limit(1).count():
        raise ValueError("rows are not aligned")


def panel_differences(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per role of two panels (concept, role): whether both list the same concepts."""
    lists = lambda p, name: p.groupBy("role").agg(F.sort_array(F.collect_set("concept")).alias(name))  # noqa: E731  a panel's names: a few hundred
    both = lists(reference, "expected").join(lists(candidate, "given"), "role", "full")
    return both.select("role", F.coalesce(F.size("expected"), F.lit(0)).alias("n_expected"), F.coalesce(F.size("given"), F.lit(0)).alias("n_given"), F.coalesce(F.col("expected") == F.col("given"), F.lit(False)).alias("equal"))


def check_panel(reference: DataFrame, candidate: DataFrame, settings: dict | None = None, expected: dict | None = None) -> None:
    wrong = [r["role"] for r in panel_differences(reference, candidate).where("NOT equal").collect()]
    wrong += [k for k in sorted({*(settings or {}), *(expected or {})}) if (settings or {}).get(k) != (expected or {}).get(k)]
    if wrong:
        raise ValueError(f"panels differ in {wrong}")


def selected(frame: DataFrame, split: str, mask: str = "kept") -> DataFrame:
    """Rows of one split whose mask holds."""
    return frame.where((F.col("split") == split) & F.col(mask).cast("boolean"))


def parse_region(text: str) -> tuple[str, int, int]:
    """chr:1,000-2,000 as (chrom, start, end)."""
    m = re.fullmatch(r"([^:\s]+):([0-9,]+)-([0-9,]+)", text.strip())
    if not m:
        raise ValueError(f"not a region: {text!r}")
    low, high = (int(x.replace(",", "")) for x in m.groups()[1:])
    if high <= low:
        raise ValueError(f"empty region: {text!r}")
    return m[1], low, high


def within_region(bins: DataFrame, region: str) -> DataFrame:
    """Bins (chrom, bin_start, bin_end) that lie wholly in the region."""
    chrom, low, high = parse_region(region)
    return bins.where((F.col("chrom") == chrom) & (F.col("bin_start") >= low) & (F.col("bin_end") <= high))


def label_counts(labels: DataFrame, keys: tuple[str, ...] = ("concept",)) -> DataFrame:
    """Per keys of (keys, y): n, n_pos, and whether the labels are usable, constant or too rare."""
    sums = labels.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("n_pos"))
    usable = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    enough = (F.col("n") >= MIN_BINS) & (F.col("n_pos") >= MIN_POSITIVES) & (F.col("n_pos") <= F.col("n") - MIN_POSITIVES)
    return sums.withColumns({"usable": usable, "enough": enough})


def usable_draws(draws: DataFrame) -> DataFrame:
    """Draws (draw, concept, y ...) in which both classes are present."""
    good = label_counts(draws, ("draw", "concept")).where("usable").select("draw", "concept")
    return draws.join(good, ["draw", "concept"], "left_semi")


def without_rare(labels: DataFrame) -> DataFrame:
    """Labels of those concepts that have enough bins of either class."""
    return labels.join(label_counts(labels).where("enough").select("concept"), "concept", "left_semi")


def check_varied(labels: DataFrame) -> DataFrame:
    """labels, if every concept has both classes."""
    flat = [r["concept"] for r in label_counts(labels).where("NOT usable").select("concept").collect()]
    if flat:
        raise ValueError(f"constant concepts: {sorted(map(str, flat))}")
    return labels


def bin_widths(bins: DataFrame) -> DataFrame:
    """(width, n): one row if the widths are uniform."""
    return bins.groupBy((F.col("bin_end") - F.col("bin_start")).alias("width")).agg(F.count("*").alias("n"))


def check_uniform(bins: DataFrame) -> int:
    widths = [r["width"] for r in bin_widths(bins).limit(2).collect()]
    if len(widths) != 1 or not widths[0] or widths[0] <= 0:
        raise ValueError(f"bins are not of one positive width: {widths}")
    return widths[0]


def sequence_bins(sequences: DataFrame, width: int) -> DataFrame:
    """(id, bin, valid) of (id, sequence): whole bins; valid if every base is A, C, G or T."""
    parts = F.regexp_extract_all("sequence", F.lit(f"(?s).{{{width}}}"), F.lit(0))  # one pass over the sequence
    bins = sequences.select("id", F.posexplode(parts).alias("bin", "bases"))
    return bins.select("id", "bin", (~F.col("bases").rlike("[^ACGTacgt]")).alias("valid"))


def element_masks(masks: DataFrame, length: int) -> DataFrame:
    """Per row of (id, mask array<boolean>): whether it has the length, no nulls and something set."""
    some = F.exists("mask", lambda x: F.coalesce(x, F.lit(False)))
    return masks.select("id", F.coalesce((F.size("mask") == length) & ~F.exists("mask", lambda x: x.isNull()) & some, F.lit(False)).alias("valid"), F.size(F.filter("mask", lambda x: x)).cast("long").alias("n_set"))


def resolve_concepts(frame: DataFrame, panel: DataFrame, keys: Iterable[str]) -> list[tuple[str, str]]:
    """(concept, role) of those panel rows that are 0/1 columns of frame; ValueError for concepts without a column."""
    roles = {r["concept"]: r["role"] for r in panel.select("concept", "role").collect()}  # a panel's names
    missing = sorted(c for c in roles if c not in frame.columns or c in set(keys))
    if missing:
        raise ValueError(f"no columns for {missing}")
    return [(c, roles[c]) for c in frame.columns if c in roles]


def melt(frame: DataFrame, id: str, concepts: list[str]) -> DataFrame:
    """Wide 0/1 columns as (id, concept, y); one narrow exploded row a concept, no shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("concept"), F.col(f"`{c}`").cast("int").alias("y")) for c in concepts])
    return frame.select(F.col(id).alias("id"), F.explode(pairs).alias("p")).select("id", "p.concept", "p.y")


def row_text(frame: DataFrame, columns: list[str] | None = None) -> Column:
    """A row's values as one text from which they can be told: each with its length, null apart, by column name."""
    parts = []
    for c in sorted(columns or frame.columns):
        kind = frame.schema[c].dataType.typeName()
        value = F.to_json(F.struct(F.col(f"`{c}`"))) if kind in ("array", "map", "struct") else F.col(f"`{c}`").cast("string")
        parts.append(F.when(F.col(f"`{c}`").isNull(), F.lit("-")).otherwise(F.concat(F.length(value).cast("string"), F.lit(":"), value)))
    return F.concat(*parts)


def text_hash(text: Column) -> Column:
    """An aggregate over rows, whatever their order: the sums of two 60-bit halves of their MD5, as text."""
    half = lambda at: F.sum(F.conv(F.substring(F.md5(text), at, 15), 16, 10).cast("decimal(20,0)"))
    return F.concat_ws("/", F.coalesce(half(1), F.lit(0)).cast("string"), F.coalesce(half(16), F.lit(0)).cast("string"))


def content_hash(frame: DataFrame) -> DataFrame:
    """(n, hash) of a table whatever its order: the number of rows, and text_hash of their values."""
    return frame.agg(F.count("*").alias("n"), text_hash(row_text(frame)).alias("hash"))


def check_frozen(frame: DataFrame, n: int, hash: str) -> DataFrame:
    """frame, if it is what was frozen."""
    row = content_hash(frame).first()
    if (row["n"], row["hash"]) != (n, hash):
        raise ValueError(f"frozen content differs: {row['n']} rows, hash {row['hash']}")
    return frame


def output_faults(outputs: DataFrame, low: float = 0.75, high: float = 1.25) -> DataFrame:
    """One row of counts over outputs (value, dose): rows, values that aren't finite, doses outside the range."""
    v = F.col("value").cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return outputs.agg(F.count("*").alias("n"), count_if(~F.coalesce(finite, F.lit(False))).alias("not_finite"), count_if(~F.coalesce(F.col("dose").between(low, high), F.lit(False))).alias("bad_dose"))

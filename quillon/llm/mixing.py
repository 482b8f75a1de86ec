"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / source_size copies. Documents are
put in an order (size, salt, id), their expected copies are summed up
along it, one random offset per source is added, and a document is taken once for
each integer that its step crosses. As documents of next sizes stand together,
the words taken come near the target.

The order's ranks come in three steps, none of which brings a source into one
task: counts by (source, size), by salt within these, and row numbers within a
salt. A source's table of counts has one row for each different size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import cut_lineage, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
#: Parts of a source's documents of one size, by hash; as many at every size of the input.
SALTS = 64
#: Random offsets drawn for each source; the one whose words come nearest to the target is taken.
OFFSETS = 16


def salt_of(id: Column, salts: int) -> Column:
    """A salt from the id's md5; equal in any SQL dialect."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(salts))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Adds target to a table (source, source_size), one row per source.

    Sources in code point order (null last) weigh as weights says, in turn. A
    source is at its limit (most * source_size) if filling all sources to the
    level at which it is full takes no more than there is; the others share
    the rest by weight. That is where resharing the excess ends.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(in_order) - 1) % len(weights)
    table = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int")))
    table = table.withColumn("most", F.col("source_size") * F.lit(float(most))).withColumn("level", F.col("most") / F.col("w"))
    everything = Window.partitionBy()
    up = Window.orderBy(F.col("level"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    table = table.select(
        "*",
        F.sum("most").over(up).alias("filled"),
        (F.sum("w").over(everything) - F.sum("w").over(up)).alias("above"),
        (F.sum("source_size").over(everything) * F.lit(share)).alias("total"),
    )
    table = table.withColumn("full", F.col("filled") + F.col("level") * F.col("above") <= F.col("total"))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    target = F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("most"), rest * F.col("w") / open_weight))
    return table.select("source", "source_size", F.round(target, 6).alias("target"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, keep: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Per row: id, source, the columns keep, size, source_size, target, copies and taken (copies * size).

    Null and empty texts have size 0 and are taken with 0 words. Null sources
    form a source of their own. Rows with equal id and size are exchangeable,
    so reruns agree. Texts of any length are counted whole; a clash of names
    with other columns of docs doesn't matter, as only those in keep go through.
    An empty table gives an empty result.
    """
    sized = docs.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"), *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)])
    sized = cut_lineage(sized)
    sized = sized.select("*", F.coalesce("source", F.lit("")).alias("__s"), F.col("source").isNull().alias("__none"), F.col("size").alias("__class"), salt_of(F.col("__id"), SALTS).alias("__salt"))
    of_source, of_class = ["__s", "__none"], ["__s", "__none", "__class"]
    by_salt = sized.groupBy(*of_class, "__salt").agg(F.count("*").alias("n"))
    by_class = sized.groupBy(*of_class).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    level = targets(sources, weights, share, most).select(F.coalesce("source", F.lit("")).alias("__s"), F.col("source").isNull().alias("__none"), "source_size", "target")
    before = lambda group, order: F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_class = by_class.withColumn("__before_class", before(of_source, "__class")).drop("n", "words").join(level, of_source)
    by_salt = by_salt.withColumn("__before_salt", before(of_class, "__salt")).drop("n").join(by_class, of_class)
    ranked = sized.withColumn("__row", F.row_number().over(Window.partitionBy(*of_class, "__salt").orderBy(F.col("__id"), "size")))
    joined = ranked.join(by_salt, [*of_class, "__salt"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumns({"__rate": rate, "__rank": F.col("__before_class") + F.col("__before_salt") + F.col("__row")})

    def copies(offset: Column) -> Column:
        at = lambda rank: F.floor(rank * F.col("__rate") + offset)
        return F.least(F.greatest(at(F.col("__rank")) - at(F.col("__rank") - 1), F.lit(0)), F.ceil("__rate")).cast("long")

    offsets = [salt_of(F.concat(F.lit(f"{seed}/{i}/"), F.col("__none").cast("string"), F.lit("/"), F.col("__s")), 1_000_000) / F.lit(1_000_000.0) for i in range(OFFSETS)]
    # One row a source: the words that each offset would take.
    tried = joined.groupBy(*of_source, "target").agg(*[F.sum(copies(x) * F.col("size")).alias(f"__t{i}") for i, x in enumerate(offsets)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"__t{i}") - F.col("target")).alias("off"), F.lit(i).alias("i"), x.alias("offset")) for i, x in enumerate(offsets)]))
    joined = joined.join(tried.select(*of_source, best["offset"].alias("__offset")), of_source)
    copies = copies(F.col("__offset"))
    return joined.select(F.col("__id").alias(id), F.col("source").alias(source), *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def emit(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of docs, each as often as mix takes it.

    Rows of equal id are told apart by their sizes; of equal sizes, they are
    exchangeable for the mix, and each gets the copies of one of them.
    """
    taken = mix(docs, id, text, source, **how).where("copies > 0").select(F.col(f"`{id}`").alias("__of"), F.col("size").alias("__words"), F.col("copies").alias("__copies"))
    same = Window.partitionBy("__of", "__words").orderBy("__copies")
    taken = taken.withColumn("__nth", F.row_number().over(same))
    rows = docs.select("*", F.col(f"`{id}`").alias("__of"), word_count(F.col(f"`{text}`")).alias("__words"))
    rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("__of", "__words").orderBy(F.xxhash64(F.col(f"`{text}`")))))
    hit = rows["__of"].eqNullSafe(taken["__of"]) & (rows["__words"] == taken["__words"]) & (rows["__nth"] == taken["__nth"])
    times = F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))
    return rows.join(taken, hit).select(*[rows[c] for c in docs.columns], times.alias("__time")).drop("__time")

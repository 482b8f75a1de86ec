"""Manifests of windows: territory, tiles, draws, positions within windows, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import draw
from quillon.operators.intervals import scan, subtract, tile
from quillon.operators.orders import before, numbered


def deal(pool: DataFrame, key: tuple[str, ...], counts: dict[str, int], seed: str = "manifest") -> DataFrame:
    """Rows of pool dealt to splits, without replacement, in the order of a hash of their key.

    A count of 0 takes what is left and has to come last. Asking for more than
    there is fails. Hashes have 32 bits: counts by their upper 16 (at most
    65,536 rows) tell up to where rows are dealt, and only these are ordered,
    by upper half. The pool is persisted, as it is read several times.
    """
    names, asked = list(counts), sum(counts.values())
    if any(n == 0 for n in list(counts.values())[:-1]):
        raise ValueError("only the last split can take what is left")
    keyed = pool.withColumn("__key", draw(F.lit(seed), *[F.col(k) for k in key])).withColumn("__upper", F.shiftright("__key", 16)).persist()
    order = Window.orderBy("__upper")
    sizes = keyed.groupBy("__upper").agg(F.count(F.lit(1)).alias("__n")).withColumn("__upto", F.sum("__n").over(order))
    found = sizes.agg(F.coalesce(F.max("__upto"), F.lit(0)).alias("have"), F.min(F.when(F.col("__upto") >= asked, F.col("__upper"))).alias("last")).first()
    if asked > found["have"]:
        raise ValueError(f"{asked} windows asked for, {found['have']} there")
    last = -1 if asked == 0 else found["last"]
    before_ = sizes.where(F.col("__upper") <= last).select("__upper", (F.col("__upto") - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__upper").orderBy("__key", *key))
    ranked = keyed.where(F.col("__upper") <= last).join(F.broadcast(before_), "__upper").withColumn("__r", F.col("__before") + within)
    split, at = F.lit(None).cast("string"), 0
    for name in names:
        split = F.when((F.col("__r") > at) & (F.col("__r") <= at + counts[name]), name).otherwise(split)
        at += counts[name]
    if counts[names[-1]]:
        return ranked.where(F.col("__r") <= asked).withColumn("split", split).select(*pool.columns, "split")
    dealt = ranked.withColumn("split", F.coalesce(split, F.lit(names[-1]))).select(*pool.columns, "split")
    left = keyed.where(F.col("__upper") > last).select(*pool.columns, F.lit(names[-1]).alias("split"))
    return dealt.unionByName(left)


def build_manifest(held_out: DataFrame, trained: DataFrame, exclude: DataFrame, width: int, held_counts: dict[str, int], trained_counts: dict[str, int], seed: str = "manifest") -> DataFrame:
    """(chrom, win_start, win_end, split): both territories less exclude, tiled and dealt; the two never overlap.

    All three are merged intervals (chrom, start, end); trained is cut by held_out.
    """
    rest = lambda t: subtract(t, exclude)
    windows = lambda t: tile(rest(t), width).select("chrom", F.col("start").alias("win_start"), F.col("end").alias("win_end"))
    held = deal(windows(held_out), ("chrom", "win_start"), held_counts, seed)
    own = deal(windows(subtract(trained, held_out)), ("chrom", "win_start"), trained_counts, seed)
    return held.unionByName(own)


def overlaps(manifest: DataFrame, cell: int | None = None) -> DataFrame:
    """Windows that begin before the ones before them on their chrom end."""
    reach = scan(manifest, ("chrom",), "win_start", {"reach": ("max_before", "win_end")}, cell, ("win_end",))
    return reach.where(F.col("win_start") < F.col("reach"))


def expand(manifest: DataFrame, width: int) -> DataFrame:
    """The bins of each window of a manifest, with its split."""
    starts = F.sequence(F.col("win_start"), F.col("win_end") - width, F.lit(width).cast("long"))
    return manifest.select("chrom", "win_start", "split", F.explode(starts).alias("bin_start")).withColumn("bin_end", F.col("bin_start") + width)


def choose_positions(bins: DataFrame, keep: int, seed: str = "positions") -> DataFrame:
    """Up to keep bins of each window (chrom, win_start), in hash order; a window's order doesn't depend on the others."""
    key = draw(F.lit(seed), F.col("chrom"), F.col("win_start"), F.col("bin_start"))
    order = Window.partitionBy("chrom", "win_start").orderBy("__key", "bin_start")
    return bins.withColumn("__key", key).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).drop("__key")


def shards(manifest: DataFrame, per_shard: int) -> DataFrame:
    """manifest with shard: windows numbered over the whole manifest by (split, chrom, win_start), so many to a shard.

    Numbers come from counts of each (split, chrom) first, so that no task sorts the whole table.
    """
    counts = manifest.groupBy("split", "chrom").agg(F.count("*").alias("n"))  # one row a chrom and split
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("split", "chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("split", "chrom", earlier.alias("before"))
    own = F.row_number().over(Window.partitionBy("split", "chrom").orderBy("win_start")) - 1
    return manifest.withColumn("__own", own).join(F.broadcast(offsets), ["split", "chrom"]).withColumn("shard", F.floor((F.col("before") + F.col("__own")) / per_shard)).drop("__own", "before")


def epoch_order(rows: DataFrame, seed: str, epoch: int) -> tuple[Column, ...]:
    """Sort columns of an epoch: shards shuffled, and the rows within each (shard, row)."""
    at = F.lit(f"{seed}/{epoch}")
    return draw(at, F.col("shard")), F.col("shard"), draw(at, F.col("shard"), F.col("row")), F.col("row")


def in_epoch_order(rows: DataFrame, seed: str, epoch: int, into: str = "at") -> DataFrame:
    """rows (shard, row) numbered in the order of an epoch: shards first, then the rows of each."""
    at = F.lit(f"{seed}/{epoch}")
    keyed = rows.withColumns({"__shard": draw(at, F.col("shard")), "__row": draw(at, F.col("shard"), F.col("row"))})
    sizes = keyed.groupBy("shard", "__shard").agg(F.count(F.lit(1)).alias("__n"))  # one row a shard
    first = numbered(sizes, (), "__shard", ("shard",), "__place")
    first = before(first, (), "__place", {"__b": ("sum", "__n")}).select("shard", "__b")
    within = numbered(keyed, ("shard",), "__row", ("row",), "__i")
    return within.join(first, "shard").withColumn(into, F.col("__b") + F.col("__i")).drop("__shard", "__row", "__i", "__b")


def one_per_slice(sites: DataFrame, slices: int, seed: str = "slices") -> DataFrame:
    """One site (id, value) drawn from each of so many slices of equal counts by value."""
    n = sites.agg(F.count(F.lit(1)).alias("__n"))
    placed = numbered(sites, (), "value", ("id",), "__i").join(n, F.lit(True))
    sliced = placed.withColumn("slice", F.floor((F.col("__i") - 1) * slices / F.col("__n")).cast("long"))
    best = F.min(F.struct(draw(F.lit(seed), F.col("id")).alias("__d"), *sites.columns)).alias("__s")
    return sliced.groupBy("slice").agg(best).select(*[F.col(f"__s.{c}").alias(c) for c in sites.columns], "slice")

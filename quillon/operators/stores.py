"""Stores of activations: partitioned Parquet with an index of what was finished.

A store is a folder with activations (tap, split, shard, row_id, chrom,
win_start, bin_start, bin_end, kept, vec), partitioned by tap and split, and
an index of finished shards with counts and hashes. Writing replaces only what
a shard wrote before, so that a failed or repeated run never doubles rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.validators import check, content_hash, row_text, text_hash

KEYS = ["tap", "split", "shard"]


def shard_index(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per shard: rows, and an order-free hash of their values, vectors included (or of columns alone)."""
    own = columns or [c for c in rows.columns if c not in KEYS]
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n"), text_hash(row_text(rows, own)).alias("hash"))


def write_store(rows: DataFrame, path: str, identity: str) -> None:
    """Writes those shards of rows that the store's index lacks.

    A store belongs to one identity (of its source and settings); another one
    fails. Shards are whole partitions: a rewritten one replaces itself.
    """
    spark = rows.sparkSession
    rest, index = rows, None
    if exists(spark, f"{path}/index"):
        index = spark.read.parquet(f"{path}/index")
        if other := index.where(F.col("identity") != identity).limit(1).count():
            raise ValueError(f"the store belongs to another run: {other}")
        rest = rows.join(F.broadcast(index.select(*KEYS)), KEYS, "left_anti")  # one row a shard
    rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(f"{path}/activations")
    # The index is of what was written, not of a second run of its source.
    written = spark.read.parquet(f"{path}/activations").join(F.broadcast(index.select(*KEYS)), KEYS, "left_anti") if index is not None else spark.read.parquet(f"{path}/activations")
    done = shard_index(written).withColumn("identity", F.lit(identity))
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(f"{path}/index")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def open_store(spark: SparkSession, path: str, tap: str, split: str, shards: int | None = None, verify: bool = True) -> DataFrame:
    """The kept rows of one tap and split (pruned partitions); fails on missing shards, or rows that differ from the index."""
    own = (F.col("tap") == tap) & (F.col("split") == split)
    rows = spark.read.parquet(f"{path}/activations").where(own)
    index = spark.read.parquet(f"{path}/index").where(own)
    if verify:
        have = index.agg(F.count("*").alias("n")).first()["n"]
        if not have or (shards is not None and have != shards):
            raise ValueError(f"{have} of {shards} shards are finished")
        found = shard_index(rows).join(index.select(*KEYS, F.col("n").alias("n_index"), F.col("hash").alias("hash_index")), KEYS, "full")
        check(found, differs=(F.col("n") != F.col("n_index")) | (F.col("hash") != F.col("hash_index")))
    return rows.where("kept")


def coordinates(store: DataFrame) -> DataFrame:
    """Coordinates of a store's rows; vectors are not read."""
    return store.select("row_id", "shard", "chrom", "win_start", "bin_start", "bin_end")


def take(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ids (at, row_id), as often as they are asked for, with their place at; unknown ids have null vectors."""
    return ids.join(store, "row_id", "left")


def batches(store: DataFrame, size: int, columns: tuple[str, ...] = ("row_id", "vec")) -> Iterator[pa.Table]:
    """A sequential pass over a store on the driver: tables of size rows, the last one of the rest.

    Partitions come one after the other, as Arrow streams of at most size rows.
    """

    def packed(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["stream"])

    held: list[pa.Table] = []
    rows = 0
    for r in store.select(*columns).mapInArrow(packed, "stream binary").toLocalIterator(prefetchPartitions=True):
        held.append(pa.ipc.open_stream(r["stream"]).read_all())
        rows += held[-1].num_rows
        while rows >= size:
            whole = pa.concat_tables(held)
            yield whole.slice(0, size)
            held, rows = [whole.slice(size)], rows - size
    if rows:
        yield pa.concat_tables(held)


def window_coordinates(store: DataFrame, chrom: str, win_start: int) -> DataFrame:
    """One window's bins in order."""
    return coordinates(store.where((F.col("chrom") == chrom) & (F.col("win_start") == win_start))).orderBy("bin_start")


def window_rows(coords: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """Per window of windows (chrom, win_start, n_bins): rows found, different bins, shards, and whether the grid is complete.

    complete: every expected bin once, in one shard.
    """
    joined = windows.join(coords, ["chrom", "win_start"], "left")
    sums = joined.groupBy("chrom", "win_start", "n_bins").agg(F.count("bin_start").alias("n_rows"), F.countDistinct("bin_start").alias("n_different"), F.countDistinct("shard").alias("n_shards"), F.min("bin_start").alias("low"), F.max("bin_start").alias("high"))
    n = F.col("n_bins")
    grid = (F.col("n_rows") == n) & (F.col("n_different") == n) & (F.col("n_shards") == 1) & (F.col("low") == F.col("win_start")) & (F.col("high") == F.col("win_start") + (n - 1) * width)
    return sums.select("chrom", "win_start", "n_bins", "n_rows", "n_shards", F.coalesce(grid, F.lit(False)).alias("complete"))


def check_windows(coords: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """(chrom, win_start, shard) of windows that are all complete; ValueError otherwise."""
    check(window_rows(coords, windows, width), incomplete=~F.col("complete"))
    return coords.join(windows.select("chrom", "win_start"), ["chrom", "win_start"], "left_semi").select("chrom", "win_start", "shard").distinct()


def same_content(a: DataFrame, b: DataFrame) -> bool:
    return content_hash(a).first() == content_hash(b).first()

"""Lloyd's clustering by what changes from round to round.

Assignments live in a written table: every vector with its owner and its
distance to it. A round compares a vector only with the centroids that changed
since the last one, and with all of them only where its own centroid moved
away from it. The sums of all clusters are kept between rounds; a round adds
signed integer transfers, that is, the vectors that came and those that left.

Only k centroids and their k x width sums pass the driver, whatever the number
of vectors; vectors never move between tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut_lineage, remove, scratch

K = 40
ROUNDS = 5
WIDTH = 64
#: Vectors are turned into integers floor(SCALE * x).
SCALE = 256
#: Components from here on are out of range: their squared distances fit no long.
LIMIT = 1 << 27
_EXACT = 1 << 22  # up to here, sums of WIDTH products are exact in doubles


def whole_numbers(vector: Column, width: int = WIDTH) -> Column:
    """floor(256 x) of each component; null unless there are width components, all finite and in range."""
    scaled = F.transform(vector, lambda x: x.cast("double") * SCALE)
    good = (F.size(vector) == width) & F.forall(scaled, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < LIMIT), F.lit(False)))
    return F.when(good, F.transform(scaled, lambda x: F.floor(x).cast("int")))


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of v from all rows of c, exact."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < _EXACT and v.shape[1] <= WIDTH:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((v - x) ** 2).sum(1) for x in c], axis=1)


def reassign(v: np.ndarray, owner: np.ndarray, far: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after the centroids numbered in changed (ascending) have moved.

    A vector whose own centroid stayed, or came no further away, is still at
    least as near to it as to all others that stayed, ties included: only the
    changed ones can win it. All others are compared with every centroid.
    """
    near = distances(v, centroids[changed])
    at = np.searchsorted(changed, owner)
    own_moved = changed[np.minimum(at, len(changed) - 1)] == owner
    own = far.copy()
    own[own_moved] = near[own_moved, at[own_moved]]
    best = near.argmin(1)
    number, least = changed[best], near[np.arange(len(v)), best]
    wins = (least < own) | ((least == own) & (number < owner))
    new_owner, new_far = np.where(wins, number, owner), np.where(wins, least, own)
    again = np.flatnonzero(own_moved & (own > far))
    if len(again):
        every = distances(v[again], centroids)
        new_owner[again] = every.argmin(1)
        new_far[again] = every.min(1)
    return new_owner, new_far


def _points(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("point").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _assign(centroids: np.ndarray, changed: np.ndarray | None, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _points(batch, width)
            if changed is None:
                every = distances(v, centroids)
                was, owner, far = np.full(len(v), -1), every.argmin(1), every.min(1)
            else:
                was = batch.column("cluster").to_numpy(zero_copy_only=False)
                owner, far = reassign(v, was.astype(np.int64), batch.column("distance").to_numpy(zero_copy_only=False), centroids, changed)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("point"), pa.array(was, pa.int32()), pa.array(owner, pa.int32()), pa.array(far, pa.int64())], ["id", "point", "was", "cluster", "distance"])

    return work


def _transfers(k: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's signed sums: one row for each cluster that won or lost vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), dtype=np.int64)
        for batch in batches:
            v = np.column_stack((_points(batch, width), np.ones(batch.num_rows, dtype=np.int64)))
            for name, sign in (("cluster", 1), ("was", -1)):
                who = batch.column(name).to_numpy(zero_copy_only=False)
                np.add.at(total, who[who >= 0], sign * v[who >= 0])
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    return work


def cluster(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, width: int = WIDTH, seed: str = "2") -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    Vectors of another width than asked, with null, NaN or infinite components,
    or with components whose squared distances fit no long, don't take part.
    The first centroids are the k vectors with the least SHA-256 of seed:id
    (null ids: of seed:; ties: by the vector), fewer if there are fewer.
    Repeated rows count as often as they stand there. Ties between centroids
    go to the smaller number, and empty clusters keep their centroid. Other
    columns are left out. An empty table, or one without such vectors, gives
    an empty result.
    """
    spark = vectors.sparkSession
    points = vectors.select(F.col(f"`{id}`").alias("id"), whole_numbers(F.col(f"`{vector}`"), width).alias("point")).where(F.col("point").isNotNull())
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = points.select(by_hash.alias("h"), "point").orderBy("h", "point").limit(k).collect()
    k = len(first)
    centroids = np.array([r["point"] for r in first], dtype=np.int64).reshape(k, width)
    sums, changed, path = np.zeros((k, width + 1), dtype=np.int64), None, None
    kind = f"id {vectors.schema[id].dataType.simpleString()}, point array<int>, was int, cluster int, distance long"
    for number in range(rounds + 1):
        state = points if path is None else spark.read.parquet(path)
        new = scratch(spark, "lloyd")
        state.mapInArrow(_assign(centroids, changed, width), kind).write.parquet(new)
        if path is not None:
            remove(spark, path)
        path = new
        if number == rounds:
            break
        moved = spark.read.parquet(path).where("was <> cluster").select("point", "was", "cluster")
        parts = moved.mapInArrow(_transfers(k, width), "cluster int, sums array<long>")
        for r in parts.select("cluster", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x")).collect():
            sums[r["cluster"], r["at"]] += r["x"]
        full = sums[:, width] > 0
        after = centroids.copy()
        after[full] = sums[full, :width] // sums[full, width:]
        changed = np.flatnonzero((after != centroids).any(1))
        centroids = after
        if not len(changed):
            break
    found = cut_lineage(spark.read.parquet(path).select(F.col("id").alias(id), "cluster", "distance"))
    remove(spark, path)
    spread = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame([(i, spread.get(i, 0), reduce(int.__add__, spread.values(), 0), h) for i, h in enumerate(shas)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

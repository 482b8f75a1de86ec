"""Operators on activation vectors and sparse codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import let


def topk_codes(frame: DataFrame, id: str, vector: str, k: int) -> DataFrame:
    """(id, feature, value): the k largest entries of each vector that are positive; the lower index wins ties."""
    pairs = F.transform(vector, lambda v, i: F.struct(v.alias("v"), (-i).alias("i")))
    best = F.slice(F.sort_array(pairs, asc=False), 1, k)
    out = frame.select(F.col(id).alias("id"), F.explode(best).alias("b"))
    return out.where("b.v > 0").select("id", (-F.col("b.i")).alias("feature"), F.col("b.v").alias("value"))


def channel_moments(scores: DataFrame) -> DataFrame:
    """Per feature of (id, feature, value): n, mean and sum of squared deviations."""
    v = F.col("value").cast("double")
    return scores.groupBy("feature").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count("*")).alias("m2"))


def channel_scale(scores: DataFrame, least: float = 1e-8) -> DataFrame:
    """Per feature its maximum, else its largest magnitude, else 1."""
    v = F.col("value").cast("double")
    top, size = F.max(v), F.max(F.abs(v))
    return scores.groupBy("feature").agg(F.when(top > least, top).when(size > least, size).otherwise(1.0).alias("scale"))


def reconstruction(original: DataFrame, codes: DataFrame, dictionary: int) -> DataFrame:
    """Of vectors (id, feature, value) kept as codes (same form): unexplained variance, MSE, mean active codes, features used."""
    joined = original.join(codes.select("id", "feature", F.col("value").cast("double").alias("kept")), ["id", "feature"], "left")
    v = F.col("value").cast("double")
    error = v - F.coalesce("kept", F.lit(0.0))
    per = joined.groupBy("feature").agg(F.sum(error * error).alias("err"), F.sum(v * v).alias("sq"), F.sum(v).alias("s"), F.count("*").alias("n"), F.count("kept").alias("fired"))
    total = per.agg(
        (F.sum("err") / F.sum(F.col("sq") - F.col("s") * F.col("s") / F.col("n"))).alias("fvu"),
        (F.sum("err") / F.sum("n")).alias("mse"),
        (F.sum("fired") / F.max("n")).alias("mean_l0"),
        F.sum((F.col("fired") > 0).cast("long")).alias("used"),
    )
    return total.withColumn("dictionary_use", F.col("used") / F.lit(float(dictionary)))


def ablate(vector: Column, code: Column, direction: Column) -> Column:
    """vector - code * direction."""
    return F.zip_with(vector, direction, lambda x, d: x.cast("double") - code * d)


def local_edit(vector: Column, decoded: Column, code: Column, edited: Column, direction: Column, residual_preserving: bool) -> Column:
    """The vector after a code changes; based on the vector itself, or on its reconstruction."""
    base = vector if residual_preserving else decoded
    return F.zip_with(base, direction, lambda x, d: x.cast("double") + (edited - code) * d)


def dose_scale(target: Column, control: Column, least: float = 1e-8) -> Column:
    """What a control's change is multiplied by to reach the target's norm; null when the control doesn't move."""
    return F.when(F.abs(control) > least, target / control)


def selectivity(sites: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per keys of (keys, effect, y): mean effect on and off the concept and their ratio (infinite when off is 0)."""
    on, off = F.avg(F.when(F.col("y") == 1, F.col("effect"))), F.avg(F.when(F.col("y") == 0, F.col("effect")))
    means = sites.groupBy(*keys).agg(on.alias("on_effect"), off.alias("off_effect"))
    return means.withColumn("ratio", F.when(F.col("off_effect") == 0, float("inf")).otherwise(F.col("on_effect") / F.col("off_effect")))


def contrastive_feature(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per keys and feature of (keys, window, feature, value, y): the mean over windows of positive less negative mean, over windows that have both."""
    on, off = F.avg(F.when(F.col("y") == 1, F.col("value"))), F.avg(F.when(F.col("y") == 0, F.col("value")))
    per = rows.groupBy(*keys, "window", "feature").agg((on - off).alias("contrast")).where("contrast IS NOT NULL")
    return per.groupBy(*keys, "feature").agg(F.avg("contrast").alias("contrast"), F.count("*").alias("n_windows"))


def discovered(contrasts: DataFrame, keys: tuple[str, ...] = ("concept",)) -> DataFrame:
    """(keys, feature, contrast): the feature of the largest contrast, the first of equals; fails for keys without any contrast.

    contrasts: those of contrastive_feature, joined to all keys that are asked for.
    """
    best = contrasts.groupBy(*keys).agg(F.max(F.struct("contrast", (-F.col("feature")).alias("f"))).alias("m"))
    missing = F.raise_error(F.concat(F.lit("no window has both classes: "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))).cast("int")
    return best.select(*keys, F.when(F.col("m.contrast").isNull(), missing).otherwise(-F.col("m.f")).alias("feature"), F.col("m.contrast").alias("contrast"))


def intervention_norms(delta: DataFrame) -> DataFrame:
    """Of (site, vec): the L2 norm of each change."""
    return delta.select("site", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("l2"))


def encode_topk(frame: DataFrame, vector: str, w: np.ndarray, bias: np.ndarray, pre: np.ndarray, k: int, scale: np.ndarray | None = None, layernorm: bool = False, exact: bool = False) -> DataFrame:
    """frame without vector, with features and values: scale, layer norm, affine map, k largest, positive ones.

    The matrix product has no SQL form: one product for each Arrow batch. The
    weights are a model of fixed size, sent once to each executor. exact: in
    doubles, as the relational form has them.
    """
    kind, value_kind = (np.float64, pa.float64()) if exact else (np.float32, pa.float32())
    weights = frame.sparkSession.sparkContext.broadcast((w, bias, pre, scale))
    keep = [c for c in frame.columns if c != vector]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != vector) + f", features array<int>, code_values array<{'double' if exact else 'float'}>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias, pre, scale = weights.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(kind)
            x = x / scale if scale is not None else x
            if layernorm:
                x = (x - x.mean(axis=1, keepdims=True)) / (x.std(axis=1, ddof=1, keepdims=True) + 1e-5)
            h = (x - pre) @ w + bias
            order = np.argsort(-h, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(h, order, axis=1)
            features = [o[v > 0].astype(np.int32) for o, v in zip(order, value, strict=True)]
            values = [v[v > 0].astype(kind) for v in value]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(features, pa.list_(pa.int32())), pa.array(values, pa.list_(value_kind))], names=[*keep, "features", "code_values"])

    return frame.mapInArrow(work, schema)


def layer_norm(vec: Column) -> Column:
    """A vector less its mean, over its spread (n - 1) and 1e-5."""
    x, n = F.transform(vec, lambda v: v.cast("double")), F.size(vec).cast("double")
    square = lambda m: F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m))
    sums = let(F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n, lambda m: F.struct(m.alias("mean"), (F.sqrt(square(m) / (n - 1)) + 1e-5).alias("spread")))
    return let(sums, lambda s: F.transform(x, lambda v: (v - s["mean"]) / s["spread"]))


def encode_relational(frame: DataFrame, weights: DataFrame, bias: DataFrame | None = None, pre: DataFrame | None = None, k: int = 16) -> DataFrame:
    """(id, feature, value) of (id, vec): the k largest of vec x weights + bias that are positive, the lower feature of equals.

    weights (channel, feature, w), bias (feature, b) and pre (channel, b, taken
    off before) are tables of any size: the product is a join on channel, with
    weights of 0 and components of 0 left out, and a sum by (id, feature). For a
    dictionary that fits into memory encode_topk gives the same by Arrow batch.
    """
    x = frame.select("id", F.posexplode("vec").alias("channel", "v"))
    if pre is not None:
        x = x.join(pre.select("channel", F.col("b").alias("__b")), "channel", "left").withColumn("v", F.col("v") - F.coalesce("__b", F.lit(0.0)))
    terms = x.where("v <> 0").join(weights.where("w <> 0"), "channel").select("id", "feature", (F.col("v").cast("double") * F.col("w")).alias("t"))
    if bias is not None:  # a feature of no term still has its bias
        terms = terms.unionByName(frame.select("id").join(bias.where("b > 0"), F.lit(True)).select("id", "feature", F.lit(0.0).alias("t")))
    sums = terms.groupBy("id", "feature").agg(F.sum("t").alias("value"))
    if bias is not None:
        sums = sums.join(bias, "feature", "left").withColumn("value", F.col("value") + F.coalesce("b", F.lit(0.0))).drop("b")
    order = Window.partitionBy("id").orderBy(F.desc("value"), "feature")
    return sums.where("value > 0").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).select("id", "feature", "value")


def decode_relational(codes: DataFrame, weights: DataFrame, pre: DataFrame | None = None) -> DataFrame:
    """(id, channel, value) of codes (id, feature, value): codes x weights (feature, channel, w), and pre (channel, b) on top where something is decoded."""
    found = codes.join(weights, "feature").groupBy("id", "channel").agg(F.sum(F.col("value").cast("double") * F.col("w")).alias("value"))
    if pre is None:
        return found
    return found.join(pre, "channel", "left").withColumn("value", F.col("value") + F.coalesce("b", F.lit(0.0))).drop("b")


def _finite(weights: DataFrame, columns: list[str]) -> DataFrame:
    bad = None
    for c in columns:
        v = F.col(c).cast("double")
        one = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        bad = one if bad is None else bad | one
    if n := weights.where(bad).count():
        raise ValueError(f"{n} weights are not finite")
    return weights


def write_weights(weights: DataFrame, path: str, columns: tuple[str, ...] = ("w",)) -> None:
    """A table of weights as Parquet; ValueError, and nothing written, if one isn't finite."""
    _finite(weights, list(columns)).write.mode("error").parquet(path)


def read_weights(spark: SparkSession, path: str, columns: tuple[str, ...] = ("w",)) -> DataFrame:
    """A table of weights; ValueError if one isn't finite or a place has two."""
    weights = _finite(spark.read.parquet(path), list(columns))
    keys = [c for c in weights.columns if c not in columns]
    if weights.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a place has two weights")
    return weights


def weight_matrix(weights: DataFrame, rows: int, columns: int, most: int = 1 << 26) -> np.ndarray:
    """Weights (channel, feature, w) as a matrix on the driver, for encode_topk; ValueError if it has more than most places."""
    if rows * columns > most:
        raise ValueError(f"{rows} x {columns} weights are too many for one machine: use encode_relational")
    out = np.zeros((rows, columns))
    table = weights.select(F.col("channel").cast("int"), F.col("feature").cast("int"), F.col("w").cast("double")).toArrow()
    out[table.column(0).to_numpy(), table.column(1).to_numpy()] = table.column(2).to_numpy()
    return out


def nearest_by_cosine(left: DataFrame, right: DataFrame, block: int = 4096) -> DataFrame:
    """For each row of left (id, vec) the row of right of the largest cosine, the lowest id of equals.

    Blocks of rows meet once each: a task multiplies one block of left with
    one of right and keeps the best of each row, so that a vector is sent once
    for each block of the other side and no pairs leave a task.
    """
    parts = lambda frame: max(1, -(-frame.count() // block))
    rows, cols = parts(left), parts(right)
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    vec = F.transform("vec", lambda x: x.cast("double"))
    a = left.select(of(rows).alias("row"), F.explode(every(cols)).alias("col"), F.col("id").cast("long").alias("id"), vec.alias("vec"))
    b = right.select(F.explode(every(rows)).alias("row"), of(cols).alias("col"), F.col("id").cast("long").alias("id"), vec.alias("vec"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["left_id", "right_id", "cosine"]
        if not a.num_rows or not b.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.float64()), strict=True)})
        b = b.sort_by("id")
        x, y = (np.stack(t.column("vec").to_numpy(zero_copy_only=False)) for t in (a, b))
        x, y = (m / (np.sqrt((m * m).sum(axis=1, keepdims=True)) + 1e-12) for m in (x, y))
        product = np.round(x @ y.T, 12)  # equal vectors have equal cosines whatever the block
        at = product.argmax(axis=1)
        return pa.table({"left_id": a.column("id"), "right_id": b.column("id").take(pa.array(at)), "cosine": pa.array(product[np.arange(len(at)), at])})

    found = a.groupBy("row", "col").cogroup(b.groupBy("row", "col")).applyInArrow(best, "left_id long, right_id long, cosine double")
    first = F.max(F.struct("cosine", (-F.col("right_id")).alias("n"))).alias("m")
    return found.groupBy("left_id").agg(first).select("left_id", (-F.col("m.n")).alias("right_id"), F.col("m.cosine").alias("cosine"))

"""Prefix sums by digits against plain Python, and where the work of one key goes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import inference, orders, ranks, reports

ODD = [0.0, -0.0, 1.0, -1.0, 1.0000000000000002, 0.1, 0.3, 1e-300, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), -float("inf"), 2.0**52, 2.0**52 + 1, 3.0, 4.0, 7.999999999999999, 8.0]


def test_order_key_follows_the_order(spark):
    rnd = random.Random(2)
    values = ODD + [rnd.gauss(0, 1) * 10.0 ** rnd.randrange(-320, 300) for _ in range(2000)] + [2.0**e for e in range(-1074, 1024)]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").select("v", orders.order_key(F.col("v")).alias("k"))
    rows = [tuple(r) for r in frame.collect()]
    null, nan = (next(k for v, k in rows if v is None), next(k for v, k in rows if v is not None and math.isnan(v)))
    own = sorted((v, k) for v, k in rows if v is not None and not math.isnan(v))
    assert null < own[0][1] and nan > own[-1][1]
    for (a, x), (b, y) in zip(own, own[1:], strict=False):
        assert (x < y) == (a < b), (a, b)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_before_equals_plain_sums(spark, kind):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", None]), float(rnd.choice([0, 0.5, -2, 1e-9, rnd.randrange(-50, 50), 3.25])), rnd.randrange(9)) for _ in range(500)]
    table = spark.createDataFrame(rows, f"k string, v {kind}, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))
    found = orders.before(table, ("k",), "v", {"s": ("sum", "n"), "m": ("min", "n"), "x": ("max", "n")}).collect()
    own = {(r["k"], r["v"]): r["n"] for r in table.collect()}
    assert len(found) == len(own)
    for r in found:
        less = [n for (k, v), n in own.items() if k == r["k"] and v < r["v"]]
        assert (r["s"], r["m"], r["x"]) == (sum(less), min(less, default=None), max(less, default=None))


def test_one_feature_is_ranked_by_several_tasks(spark):
    n = 4000
    rnd = random.Random(6)
    values = [(i, 0, 0.0 if i % 3 == 0 else rnd.gauss(0, 1)) for i in range(n)]  # a third of the rows are tied
    frame = spark.createDataFrame(values, "id long, feature int, value float")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        ranked = ranks.average_rank(frame)
        got = {r["id"]: r["rk"] for r in ranked.collect()}
        counts = frame.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        below = orders.before(counts, ("feature",), "value", {"b": ("sum", "n")})
        assert below.withColumn("t", F.spark_partition_id()).select("t").distinct().count() >= 8
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    own = sorted(r["value"] for r in frame.collect())
    first, last = {}, {}
    for i, v in enumerate(own):
        first.setdefault(v, i)
        last[v] = i
    assert got == {r["id"]: (first[r["value"]] + last[r["value"]]) / 2 + 1 for r in frame.collect()}


def test_strata_rows_and_pool(spark):
    rnd = random.Random(8)
    rows = [(s, float(rnd.randrange(12)), int(rnd.random() < 0.4)) for s in (-1, 0, 1, 2) for _ in range(60 if s < 2 else 12)]
    frame = spark.createDataFrame(rows, "stratum int, value double, y int")

    def pairs(own):
        p, q = [v for v, y in own if y], [v for v, y in own if not y]
        return len(p), len(q), sum((a > b) + 0.5 * (a == b) for a in p for b in q)

    per = {s: pairs([(v, y) for t, v, y in rows if t == s]) for s in (0, 1, 2)}
    got = {r["stratum"]: (r["p"], r["q"], r["auroc"], r["used"]) for r in ranks.auroc_by_stratum(frame).collect()}
    assert got == {s: (p, q, pytest.approx(w / (p * q)), p >= 10 and q >= 10) for s, (p, q, w) in per.items()}
    used = [x for x in per.values() if x[0] >= 10 and x[1] >= 10]
    p, q, w = pairs([(v, y) for _, v, y in rows])
    row = ranks.stratified_auroc(frame).first()
    assert row["adjusted"] == pytest.approx(sum(x[2] for x in used) / sum(x[0] * x[1] for x in used)) and row["unadjusted"] == pytest.approx(w / (p * q))
    assert (row["used"], row["skipped"]) == (len(used), 3 - len(used))


def test_discoveries_within_families_and_without_p(spark):
    rows = [("a", "f", 0.01), ("b", "f", 0.02), ("c", "f", 0.02), ("d", "f", 0.9), ("e", "g", 0.04), ("x", "g", None)]
    frame = spark.createDataFrame(rows, "id string, kind string, p double")
    got = {r["id"]: (r["rank"], r["significant"]) for r in inference.benjamini_hochberg(frame, family="kind").collect()}
    assert got == {"a": (1, True), "b": (2, True), "c": (3, True), "d": (4, False), "e": (1, True), "x": (None, False)}
    one = {r["id"]: (r["rank"], r["significant"]) for r in inference.benjamini_hochberg(frame).collect()}
    assert one == {"a": (1, True), "b": (2, True), "c": (3, True), "e": (4, True), "d": (5, False), "x": (None, False)}


def test_frontier_with_equal_points(spark):
    rows = [(1, 1, 5.0), (2, 1, 4.0), (3, 2, 4.0), (4, 3, 3.0), (5, 3, 3.0), (6, 9, 3.5)]
    frame = spark.createDataFrame(rows, "id int, cost int, loss double")
    assert sorted((r["cost"], r["loss"]) for r in reports.pareto(frame, "cost", "loss").collect()) == [(1, 4.0), (3, 3.0)]

"""Chains longer than a part, odd receipts against plain Python, and how often receipts and orders are read and dealt."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.operators import orders
from quillon.sources import receipts

SCHEMA = "seq long, key string, body string, sha256 string, previous string"


def leaves(frame):
    return str(frame._jdf.queryExecution().analyzed().toString()).count("LogicalRDD")


def plain(rows, plan, wanted):
    """What an audit has to find; the hashes of rows are right or start with x."""
    found, keys, numbers = [], defaultdict(list), defaultdict(list)
    for r in rows:
        keys[r[1]].append(r)
        numbers[r[0]].append(r)
    for seq, key, _, sha, previous in rows:
        if sha is None or sha.startswith("x"):
            found.append(("changed", seq, key))
        before = numbers.get(seq - 1) if seq is not None else None
        if seq is not None and seq > 1 and not before:
            found.append(("gap", seq, key))
        if seq == 1 and previous != plan or seq is not None and seq != 1 and before and previous not in [b[3] for b in before if b[3] is not None]:
            found.append(("unlinked", seq, key))
        if wanted is not None and (key is None or key not in wanted):
            found.append(("unplanned", seq, key))
    for seq, own in numbers.items():
        if len(own) > 1:
            found.append(("fork", seq, min((r[1] for r in own if r[1] is not None), default=None)))
    for key, own in keys.items():
        if len(own) > 1:
            found.append(("repeated", min((r[0] for r in own if r[0] is not None), default=None), key))
    found += [("missing", None, k) for k in set(wanted or ()) if k is None or k not in keys]
    return Counter(found)


@pytest.mark.parametrize("part", [1, 4, 1 << 12])
@pytest.mark.parametrize("seed", [1, 2])
def test_odd_receipts_across_parts(spark, monkeypatch, part, seed):
    monkeypatch.setattr(receipts, "PART", part)
    rnd = random.Random(seed)
    rows = spark.createDataFrame([(i - 9, f"w{i}") for i in range(40)], "at long, key string")
    held = [tuple(r) for r in receipts.freeze(rows, "at", "key", "plan").orderBy("seq").collect()]
    assert all(b[4] == a[3] for a, b in zip([(0, 0, 0, "plan"), *held], held, strict=False))
    odd = []
    for r in held:
        for _ in range(rnd.choice([0, 1, 1, 1, 1, 2])):
            seq, key, body, sha, previous = r
            if rnd.random() < 0.2:
                sha = rnd.choice(["x1", "x2", None])
            if rnd.random() < 0.2:
                previous = rnd.choice(["x1", "x2", None])
            odd.append((seq, key, body, sha, previous))
    odd += [(None, None, "b", "x1", "x2"), (None, "w1", "b", "x1", "x2"), (0, None, "b", "x3", None), (-1, "w2", "b", "x3", "x3")]
    planned = [f"w{i}" for i in range(0, 45, 2)] + ["w2", None, None]
    frame, plan = spark.createDataFrame(odd, SCHEMA), spark.createDataFrame([(k,) for k in planned], "key string")
    for wanted in (None, planned):
        got = receipts.audit(frame, "plan", None if wanted is None else plan).collect()
        assert Counter((r["fault"], r["seq"], r["key"]) for r in got) == plain(odd, "plan", wanted)


def test_columns_go_along_with_receipts(spark):
    rows = spark.createDataFrame([(3, "a", True), (1, "b", False)], "at long, key string, gone boolean")
    got = receipts.freeze(rows, "at", "key", "plan", F.col("key"), ("gone",))
    assert got.columns == ["seq", "key", "body", "sha256", "previous", "gone"]
    assert [(r["seq"], r["key"], r["gone"]) for r in got.orderBy("seq").collect()] == [(1, "b", False), (2, "a", True)]


def test_receipts_are_read_few_times(spark):
    frame, plan = spark.createDataFrame([(1, "a", "b", "c", "plan")], SCHEMA), spark.createDataFrame([("a",)], "key string")
    assert leaves(receipts.audit(frame, "plan", plan)) <= 3
    assert leaves(receipts.freeze(spark.createDataFrame([(1, "a")], "at long, key string"), "at", "key", "plan")) <= 4


@pytest.mark.parametrize(("kind", "values"), [("bigint", [None, -(1 << 63), -(1 << 53) - 1, -(1 << 53), -1, 0, 1, (1 << 53), (1 << 53) + 1, (1 << 63) - 1]), ("int", [None, -(1 << 31), -1, 0, 65535, 65536, (1 << 31) - 1]), ("smallint", [None, -(1 << 15), -1, 0, (1 << 15) - 1])])
def test_whole_numbers_are_ordered_exactly(spark, kind, values):
    rows = spark.createDataFrame([(v,) for v in random.Random(3).sample(values, len(values))], f"v {kind}").withColumn("one", F.lit(1))
    got = {r["v"]: r["s"] for r in orders.before(rows, (), "v", {"s": ("sum", "one")}).collect()}
    assert got == {v: i for i, v in enumerate(values)}


def test_dense_numbers_share_their_upper_digits(spark):
    dense = spark.range(3_000_000, 3_000_000 + 200_000)
    *upper, _ = orders.digits(F.col("id"), "bigint")
    assert dense.select(*[d.alias(f"d{i}") for i, d in enumerate(upper)]).distinct().count() <= 5

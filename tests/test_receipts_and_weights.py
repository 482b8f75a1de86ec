"""Chained receipts, anchors, placement, weights, p values and motif scans against plain Python."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import scalar, sequence
from quillon.operators import inference, intervals, vectors
from quillon.sources import receipts


def chain(spark, n=30):
    rows = spark.createDataFrame([(i * 3, f"w{i}", float(i)) for i in range(n)], "at long, key string, value double")
    plan = receipts.plan_hash(rows.select("key"))
    return rows, plan, receipts.freeze(rows.repartition(5), "at", "key", plan).persist()


def faults(frame):
    return sorted((r["fault"], r["seq"], r["key"]) for r in frame.collect())


def test_receipts_hold_the_one_before(spark):
    rows, plan, held = chain(spark)
    own = held.orderBy("seq").collect()
    assert [r["key"] for r in own] == [f"w{i}" for i in range(30)] and own[0]["previous"] == plan
    assert all(b["previous"] == a["sha256"] for a, b in itertools.pairwise(own))
    assert own[4]["sha256"] == hashlib.sha256(f"5|w4|{own[4]['body']}".encode()).hexdigest()
    assert faults(receipts.audit(held, plan, rows.select("key"))) == []
    closing = receipts.finalize(held, plan, rows.select("key"))
    assert (closing["n"], closing["head"]) == (30, own[-1]["sha256"])
    assert receipts.finalize(held.repartition(3), plan) == closing


def test_changed_dropped_swapped_and_doubled_receipts_are_found(spark):
    rows, plan, held = chain(spark)
    changed = held.withColumn("body", F.when(F.col("seq") == 7, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    assert faults(receipts.audit(changed, plan)) == [("changed", 7, "w6")]
    resealed = changed.withColumn("sha256", F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "key", "body"), 256))
    assert faults(receipts.audit(resealed, plan)) == [("unlinked", 8, "w7")]
    assert faults(receipts.audit(held.where("seq <> 12"), plan, rows.select("key"))) == sorted([("gap", 13, "w12"), ("missing", None, "w11")], key=lambda x: (x[0], x[1] or 0))
    swapped = held.withColumn("seq", F.when(F.col("seq") == 3, 4).when(F.col("seq") == 4, 3).otherwise(F.col("seq")))
    assert {f for f, *_ in faults(receipts.audit(swapped, plan))} == {"changed", "unlinked"}
    assert {f for f, *_ in faults(receipts.audit(held.union(held.where("seq = 9")), plan))} == {"fork", "repeated"}
    assert faults(receipts.audit(held, "another plan")) == [("unlinked", 1, "w0")]
    assert faults(receipts.audit(held, plan, rows.where("at > 0").select("key"))) == [("unplanned", 1, "w0")]
    with pytest.raises(ValueError, match="gap"):
        receipts.finalize(held.where("seq <> 12"), plan)


def test_rank_access_knows_its_bounds(spark):
    rows, _, _ = chain(spark, 5)
    assert receipts.at_rank(rows, [F.desc("at")], 1)["key"] == "w3"
    for rank in (-1, 5):
        with pytest.raises(IndexError):
            receipts.at_rank(rows, [F.desc("at")], rank)


def test_anchors_always_change(spark):
    rows = [(i, s, 0, len(s)) for i, s in enumerate(["ATAT", "AAAC", "AC", "ACGTACGT", "AAAA", "A", ""])] + [(50 + i, "GGACGTAA", 2, 4) for i in range(20)]
    frame = spark.createDataFrame(rows, "id int, s string, at int, w int").select("id", "s", "at", "w", scalar.mutate_anchor(F.col("s"), F.col("at"), F.col("w"), F.col("id")).alias("m"))
    for r in frame.collect():
        part = r["s"][r["at"] : r["at"] + r["w"]]
        if len(set(part)) < 2:
            assert r["m"] is None
        else:
            own = r["m"][r["at"] : r["at"] + r["w"]]
            assert own != part and sorted(own) == sorted(part) and r["m"][: r["at"]] == r["s"][: r["at"]] and r["m"][r["at"] + r["w"] :] == r["s"][r["at"] + r["w"] :]


def test_placement_avoids_what_is_excluded(spark):
    rnd = random.Random(3)
    spans = [(c, s, s + rnd.randrange(1, 30)) for c in "ab" for s in rnd.sample(range(900), 60)]
    out = [("a", 0, 100), ("a", 90, 400), ("a", 430, 800), ("b", 10, 990)]
    frame = spark.createDataFrame(spans, "chrom string, start long, end long")
    sizes = spark.createDataFrame([("a", 1000), ("b", 1000)], "chrom string, size long")
    exclude = spark.createDataFrame(out, "chrom string, start long, end long")
    own = frame.where("chrom = 'a' OR end - start <= 10")
    found = intervals.shuffle_avoiding(own, sizes, exclude, "x").collect()
    assert len(found) == own.count()
    for r in found:
        assert r["end"] - r["start"] == r["old_end"] - r["old_start"] and 0 <= r["start"] and r["end"] <= 1000
        assert not any(c == r["chrom"] and s < r["end"] and e > r["start"] for c, s, e in out)
    again = intervals.shuffle_avoiding(own.repartition(7), sizes, exclude, "x").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    with pytest.raises(Exception, match="no free place"):
        intervals.shuffle_avoiding(frame, sizes, exclude, "x").collect()
    # Every free place is as likely: 10-base spans on a chrom with 3 and 22 places.
    many = spark.range(2000).select(F.lit("c").alias("chrom"), (F.col("id") * 100).alias("start"), (F.col("id") * 100 + 10).alias("end"))
    gaps = spark.createDataFrame([("c", 12, 50), ("c", 81, 300)], "chrom string, start long, end long")
    starts = [r["start"] for r in intervals.shuffle_avoiding(many, spark.createDataFrame([("c", 300)], "chrom string, size long"), gaps, "y").collect()]
    assert set(starts) == {0, 1, 2, *range(50, 72)} and abs(sum(s < 3 for s in starts) / 2000 - 3 / 25) < 0.03


def test_relational_encoder_equals_the_batched_one(spark):
    rng = np.random.default_rng(4)
    x, w, b, pre = rng.normal(size=(30, 12)), rng.normal(size=(12, 40)), rng.normal(size=40), rng.normal(size=12)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    table = spark.createDataFrame([(c, f, float(w[c, f])) for c in range(12) for f in range(40)], "channel int, feature int, w double")
    bias, shift = (spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"{name} int, b double") for name, values in (("feature", b), ("channel", pre)))
    got = sorted((r["id"], r["feature"], round(r["value"], 9)) for r in vectors.encode_relational(frame, table, bias, shift, 5).collect())
    batch = vectors.encode_topk(frame, "vec", vectors.weight_matrix(table, 12, 40), b, pre, 5, exact=True)
    assert got == sorted((r["id"], f, round(v, 9)) for r in batch.collect() for f, v in zip(r["features"], r["code_values"], strict=True))
    back = table.select("feature", "channel", "w")
    codes = vectors.encode_relational(frame, table, bias, shift, 5)
    for r in vectors.decode_relational(codes, back, shift).collect():
        own = {f: v for i, f, v in got if i == r["id"]}
        assert r["value"] == pytest.approx(sum(v * w[r["channel"], f] for f, v in own.items()) + pre[r["channel"]], abs=1e-6)


def test_layer_norm(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(3, 2, size=(5, 7))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    for r in frame.select("id", vectors.layer_norm(F.col("vec")).alias("n")).collect():
        v = x[r["id"]]
        assert np.allclose(r["n"], (v - v.mean()) / (v.std(ddof=1) + 1e-5))


def test_weights_have_to_be_finite_and_single(spark, tmp_path):
    good = spark.createDataFrame([(0, 0, 1.0), (0, 1, -2.0)], "channel int, feature int, w double")
    vectors.write_weights(good, str(tmp_path / "w"))
    assert vectors.read_weights(spark, str(tmp_path / "w")).count() == 2
    for i, bad in enumerate((float("nan"), float("inf"), None)):
        worse = good.union(spark.createDataFrame([(1, 1, bad)], good.schema))
        with pytest.raises(ValueError, match="finite"):
            vectors.write_weights(worse, str(tmp_path / f"x{i}"))
        assert not (tmp_path / f"x{i}").exists()
        worse.write.parquet(str(tmp_path / f"y{i}"))
        with pytest.raises(ValueError, match="finite"):
            vectors.read_weights(spark, str(tmp_path / f"y{i}"))
    good.union(good.limit(1)).write.parquet(str(tmp_path / "z"))
    with pytest.raises(ValueError, match="two"):
        vectors.read_weights(spark, str(tmp_path / "z"))
    with pytest.raises(ValueError, match="too many"):
        vectors.weight_matrix(good, 1 << 20, 1 << 20)


def test_p_values_against_counts_and_integrals(spark):
    cases = [(n, w) for n in (1, 2, 5, 9, 12) for w in range(0, n * (n + 1) // 4 + 1)]
    frame = spark.createDataFrame([(i, 3, 1.0, n, float(w), 0.0) for i, (n, w) in enumerate(cases)], "i int, n long, t double, w_n long, w double, ties double")
    got = {r["i"]: r["w_p"] for r in inference.with_p_values(frame).collect()}
    for i, (n, w) in enumerate(cases):
        below = sum(sum(s) <= w for s in itertools.product(*[(0, k) for k in range(1, n + 1)]))
        assert got[i] == pytest.approx(min(1.0, 2 * below / 2**n)), (n, w)

    def tail(t, df):  # Simpson's rule over the density
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        x = np.linspace(0, abs(t), 20001)
        y = c * (1 + x * x / df) ** (-(df + 1) / 2)
        return 1 - 2 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (x[1] - x[0]) / 3

    ts = [(t, n) for t in (0.01, 0.5, -1.3, 2.0, 5.0) for n in (2, 3, 4, 10, 51, 1000, 200_000)]
    frame = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(ts)], "i int, t double, n long")
    for r in frame.select("i", inference.student_p(F.col("t"), F.col("n")).alias("p")).collect():
        t, n = ts[r["i"]]
        assert r["p"] == pytest.approx(tail(t, n - 1), abs=1e-9), (t, n)
    zs = [0.0, 1e-6, 0.3, 1.0, 1.999, 2.0, 2.001, 3.5, 6.0, 12.0]
    frame = spark.createDataFrame([(z,) for z in zs], "z double").select("z", inference.erfc(F.col("z")).alias("e"))
    assert all(r["e"] == pytest.approx(math.erfc(r["z"]), rel=1e-9) for r in frame.collect())


def test_tests_of_degenerate_groups(spark):
    rows = [("one", 3)] + [("zero", 0)] * 4 + [("same", 2)] * 3
    frame = spark.createDataFrame(rows, "k string, delta long")
    got = {r["k"]: (r["t_p"], r["w_p"], r["w"], r["w_n"]) for r in inference.paired_tests(frame, ("k",)).collect()}
    assert got["one"] == (1.0, 1.0, 0.0, 1) and got["zero"] == (1.0, 1.0, 0.0, 0) and got["same"][0] == 0.0


@pytest.mark.parametrize("piece", [7, 64, 1 << 16])
def test_motif_scan_equals_every_window(spark, piece):
    rng = random.Random(2)
    texts = {i: "".join(rng.choice("ACGTacgtN" if i % 2 else "ACGT") for _ in range(n)) for i, n in enumerate((0, 4, 5, 200, 333))}
    frame = spark.createDataFrame(list(texts.items()), "id long, sequence string")
    table = {(j, b): rng.gauss(0, 1) for j in range(5) for b in "ACGT"}
    scores = spark.createDataFrame([(j, b, v) for (j, b), v in table.items()], "pos int, base string, score double")
    least = 0.4 * sum(max(table[j, b] for b in "ACGT") for j in range(5))
    pair = dict(zip("ACGT", "TGCA", strict=True))
    want = []
    for i, text in texts.items():
        for s in range(len(text) - 4):
            w = text[s : s + 5].upper()
            if "N" in w:
                continue
            for strand, score in (("+", sum(table[j, c] for j, c in enumerate(w))), ("-", sum(table[4 - j, pair[c]] for j, c in enumerate(w)))):
                if score >= least:
                    want.append((i, s, s + 5, strand, round(score, 9), w))
    hits = sequence.scan_motif(frame, scores, 5, 0.4, piece=piece)
    assert sorted((r["id"], r["start"], r["end"], r["strand"], round(r["score"], 9), r["window"]) for r in hits.collect()) == sorted(want)
    best = {r["id"]: (r["start"], r["strand"]) for r in sequence.best_hits(hits).collect()}
    assert best == {i: min((-h[4], h[1], h[3] != "+", h[3]) for h in want if h[0] == i)[1::2] for i in {h[0] for h in want}}
    ordered = [(r["id"], r["start"], -r["score"]) for r in sequence.in_scan_order(hits).collect()]
    assert ordered == sorted(ordered)

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import scalar, sequence
from quillon.operators import inference, ranks, reports, vectors


def brute_auroc(values, y):
    pos, neg = [v for v, t in zip(values, y) if t], [v for v, t in zip(values, y) if not t]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_dense_and_sparse_auroc(spark):
    rng = np.random.default_rng(1)
    values = np.maximum(rng.integers(-3, 4, size=(60, 3)), 0).astype(float)
    y = (rng.random(60) < 0.4).astype(int)
    scores = spark.createDataFrame([(i, f, float(values[i, f])) for i in range(60) for f in range(3)], "id long, feature int, value double")
    labels = spark.createDataFrame([(i, "c", int(y[i])) for i in range(60)], "id long, concept string, y int")
    dense = {r["feature"]: r["auroc"] for r in ranks.auroc_dense(scores, labels).collect()}
    dictionary = spark.range(4).select(F.col("id").cast("int").alias("feature"))
    sparse = {r["feature"]: r["auroc"] for r in ranks.auroc_sparse(scores.where("value > 0"), labels, dictionary).collect()}
    for f in range(3):
        assert dense[f] == pytest.approx(brute_auroc(values[:, f], y))
        assert sparse[f] == pytest.approx(dense[f])
    assert sparse[3] == 0.5


@pytest.mark.parametrize("scores, want", [([1, 1, 1, 1], 0.5), ([4, 1, 3, 2], 1.0), ([1, 4, 2, 3], 0.4166666667)])
def test_average_precision(spark, scores, want):
    rows = spark.createDataFrame([("k", float(s), y) for s, y in zip(scores, [1, 0, 1, 0])], "k string, value double, y int")
    assert ranks.average_precision(rows, ("k",)).first()["ap"] == pytest.approx(want)


def test_domain_f1(spark):
    rows = [("a", 0, True, False), ("a", 128, True, True), ("a", 512, True, False), ("b", 0, True, True), ("b", 128, False, True)]
    frame = spark.createDataFrame([(c, s, s + 128, y, p) for c, s, y, p in rows], "chrom string, bin_start long, bin_end long, label boolean, pred boolean")
    out = ranks.domain_f1(frame).first()
    assert (out["n_domains"], out["n_recovered"]) == (3, 2)
    assert all(out[k] == pytest.approx(2 / 3) for k in ("precision", "recall", "f1"))


def test_paired_statistics_degenerate(spark):
    rows = [("one", 3)] + [("zero", 0)] * 4 + [("same", 2)] * 3 + [("mixed", v) for v in (1, -2, 3, 4)]
    out = {r["k"]: r for r in inference.paired_stats(spark.createDataFrame(rows, "k string, delta long"), ("k",)).collect()}
    assert out["one"]["t"] is None and out["zero"]["t"] is None and out["same"]["t"] == math.inf
    d = np.array([1, -2, 3, 4])
    assert out["mixed"]["t"] == pytest.approx(d.mean() / (d.std(ddof=1) / 2))
    w = {r["k"]: r for r in inference.wilcoxon_w(spark.createDataFrame(rows, "k string, delta long"), ("k",)).collect()}
    assert w["mixed"]["w"] == 2.0 and "zero" not in w


def test_p_values(spark):
    one = spark.createDataFrame([(2.0, 11, 0, None, None), (math.inf, 5, 5, 0.0, 0.0), (None, 20, 15, 0.0, 15.0 * (15**2 - 1))], "t double, n long, w_n long, w double, ties double")
    got = {r["n"]: (r["t_p"], r["w_p"]) for r in inference.with_p_values(one).collect()}
    assert got[11] == (pytest.approx(0.07338803, abs=1e-7), 1.0)
    assert got[5] == (0.0, pytest.approx(2 / 32))
    assert got[20][0] == 1.0 and got[20][1] < 0.01


def test_benjamini_hochberg(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205]
    rows = spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(p)], "id string, p double")
    assert [r["significant"] for r in inference.benjamini_hochberg(rows).orderBy("rank").collect()] == [True, True] + [False] * 6


def test_quantile_strata_and_ceiling(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (4.0,)], "v double")
    out = [r[0] for r in rows.select(scalar.quantile_stratum(F.col("v"), F.array(F.lit(2.0)))).collect()]
    assert out == [0, 1, -1, 1]
    assert spark.range(1).select(scalar.auroc_ceiling(F.lit(0.5), F.lit(0.1))).first()[0] == pytest.approx(0.6)


def test_topk_prefers_low_index(spark):
    frame = spark.createDataFrame([(1, [1.0, 3.0, 3.0, -1.0])], "vec_id long, e array<double>")
    assert sorted((r["feature"], r["value"]) for r in vectors.topk_codes(frame, "vec_id", "e", 2).collect()) == [(1, 3.0), (2, 3.0)]
    assert [(r["feature"]) for r in vectors.topk_codes(frame, "vec_id", "e", 1).collect()] == [1]


def test_encoder_agrees_with_numpy(spark):
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(5, 4)).astype(np.float32), rng.normal(size=(4, 8)).astype(np.float32)
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, e array<float>")
    out = vectors.encode_topk(frame, "e", w, np.zeros(8, np.float32), np.zeros(4, np.float32), 3).orderBy("id").collect()
    for row, h in zip(out, x @ w, strict=True):
        best = [int(i) for i in np.argsort(-h, kind="stable")[:3] if h[i] > 0]
        assert row["features"] == best


def test_local_edit_baselines(spark):
    row = spark.createDataFrame([([1.0, 2.0], [0.5, 1.0], [1.0, -1.0])], "x array<double>, d array<double>, dir array<double>")
    edit = lambda keep: row.select(vectors.local_edit(F.col("x"), F.col("d"), F.lit(2.0), F.lit(3.0), F.col("dir"), keep)).first()[0]
    assert edit(True) == [2.0, 1.0] and edit(False) == [1.5, 0.0]


def test_roles_and_splits(spark):
    rows = spark.createDataFrame([("blacklist", 0.5), ("shuffled_x", 0.5), ("a", 0.5), ("b", 0.01), ("c", 1e-5)], "c string, p double")
    assert [r[0] for r in rows.select(reports.role(F.col("c"), F.col("p"))).collect()] == ["artifact_control", "negative_control", "exploratory", "confirmatory", "excluded_too_rare"]
    out = reports.draw_splits(spark.range(10), "id", [("test", 2), ("train", 3)]).orderBy("id").collect()
    assert [r["split"] for r in out] == ["test", "test", "train", "train", "train"]


def test_motif_scan_and_strings(spark):
    counts = {"T": [9, 0, 0, 0, 0], "G": [0, 9, 9, 0, 0], "C": [0, 0, 0, 9, 9], "A": [0, 0, 0, 0, 0]}
    w = spark.createDataFrame([(i, b, float(v)) for b, r in counts.items() for i, v in enumerate(r)], "pos int, base string, w double")
    weights = sequence.position_weights(w)
    assert sequence.consensus(weights).first()[0] == "TGGCC"
    seqs = spark.createDataFrame([(1, "NNNNTGGCCNNNNGGCCANNNN")], "id long, sequence string")
    hits = sequence.scan_motif(seqs, sequence.log_odds(weights), 5, 0.7).orderBy("start").collect()
    assert [(h["start"], h["strand"], h["window"]) for h in hits] == [(4, "+", "TGGCC"), (13, "-", "GGCCA")]
    assert spark.range(1).select(scalar.reverse_complement(F.lit("TGGCC"))).first()[0] == "GGCCA"
    assert spark.range(1).select(scalar.gc_fraction(F.lit("ACNG"))).first()[0] is None


def test_windows_of_long_sequences(spark):
    import random

    from quillon.functions.sequence import sequence_windows

    rng = random.Random(1)
    texts = {i: "".join(rng.choice("ACGT") for _ in range(n)) for i, n in enumerate((0, 5, 6, 7, 4095, 4096, 4101, 12_000))}
    rows = spark.createDataFrame(list(texts.items()), "id long, sequence string")
    for width, step in ((6, 1), (6, 4), (64, 64), (200, 100), (5000, 700)):
        out = sorted((r["id"], r["start"], r["window"]) for r in sequence_windows(rows, width, step).collect())
        assert out == sorted((i, s, t[s : s + width]) for i, t in texts.items() for s in range(0, len(t) - width + 1, step)), (width, step)

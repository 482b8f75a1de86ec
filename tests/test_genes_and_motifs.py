import numpy as np
import pytest

from quillon.__main__ import main
from quillon.operators import genes, motifs


def test_eligibility(spark):
    t = spark.createDataFrame([("c", "A", "a", "+", 5000), ("c", "B", "b", "+", 5200), ("c", "C", "k", "+", 100)], "chrom string, gene string, transcript string, strand string, pos long")
    exons = spark.createDataFrame([(x, 4000, 7000) for x in "ab"] + [("k", 0, 3000)], "transcript string, start long, end long")
    windows = spark.createDataFrame([("c", 0, 10_000)], "chrom string, start long, end long")
    none = spark.createDataFrame([], "chrom string, bin_start long")
    names = lambda marked: {r["gene"] for r in genes.eligible_genes(t, exons, windows, marked, 1000).collect()}
    assert names(none) == {"A", "B"}
    assert names(spark.createDataFrame([("c", 4992)], "chrom string, bin_start long")) == {"B"}


def test_readouts(spark):
    tracks = spark.createDataFrame([("r", "RNA", 2, 2.0), ("r", "RNA", 3, 6.0), ("s", "CAGE", 2, 3.0), ("s", "CAGE", 9, 5.0)], "track string, modality string, bin int, value double")
    sites = spark.createDataFrame([("g", 2)], "gene string, bin int")
    weights = spark.createDataFrame([("g", 2, 32), ("g", 3, 96)], "gene string, bin int, bases int")
    assert {r["track"]: r["readout"] for r in genes.readouts(tracks, sites, weights).collect()} == {"r": 5.0, "s": 3.0}


MATRICES = "matrix_id string, matrix array<array<double>>"


def brute_alignments(a, b, least=motifs.LEAST_OVERLAP):
    """Best Pearson correlation of a with b on either strand, by trying every pair of first positions."""
    best = (-1.0, None, None)
    for strand, other in (("+", b), ("-", np.flip(b))):
        for shift in range(-len(other), len(a)):
            common = [i for i in range(len(a)) if 0 <= i - shift < len(other)]
            if len(common) >= least:
                x, y = np.concatenate([a[i] for i in common]), np.concatenate([other[i - shift] for i in common])
                if np.ptp(x) > 1e-9 and np.ptp(y) > 1e-9:
                    best = max(best, (float(np.corrcoef(x, y)[0, 1]), strand, shift), key=lambda t: t[0])
    return best


def test_motif_match_against_brute_force(spark):
    rng = np.random.default_rng(2)
    m = [rng.dirichlet(np.ones(4), size=n) for n in (8, 6, 12, 4, 9)] + [np.full((7, 4), 0.25)]
    named = {f"m{i}": x for i, x in enumerate(m)} | {"back": np.flip(m[0]), "longer": np.vstack([m[1], m[0], m[1]])}
    db = spark.createDataFrame([(i, x.tolist()) for i, x in named.items()], MATRICES)
    query = spark.createDataFrame([("q", m[0].tolist())], MATRICES)
    out = {r["matrix_id"]: r for r in motifs.match_motifs(db, query, 40, top=None).collect()}
    for i, x in named.items():
        score, strand, shift = brute_alignments(m[0], x)
        assert out[i]["score"] == pytest.approx(score, abs=1e-9)
        if strand and i in ("m0", "back", "longer"):
            assert (out[i]["strand"], out[i]["offset"]) == (strand, shift)
    assert out["m0"]["score"] == pytest.approx(1.0) and out["back"]["strand"] == "-" and out["longer"]["offset"] == -6
    assert out["m3"]["score"] == out["m5"]["score"] == -1.0  # too short, and without any spread
    nulls = [r["flat"] for r in motifs.shuffled(query, 40).where("draw >= 0").collect()]
    best = sorted(max(brute_alignments(np.array(q).reshape(-1, 4), x)[0] for x in named.values()) for q in nulls)
    assert out["m1"]["p"] == pytest.approx((1 + sum(b >= out["m1"]["score"] - 1e-12 for b in best)) / 41)
    assert out["m1"]["null_p95"] == pytest.approx(np.quantile(best, 0.95)) and out["m0"]["p"] <= 2 / 41
    assert [r["matrix_id"] for r in motifs.match_motifs(db, query, 5, top=2).collect()] in (["back", "longer"], ["back", "m0"], ["longer", "m0"])
    assert motifs.match_motifs(db.where("false"), query, 5).collect() == []


def test_command_line():
    assert main(["--list"]) == 0 and main(["nothing"]) == 2

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.operators import intervals as iv


def frame(spark, rows, chrom="c"):
    return spark.createDataFrame([(chrom, int(a), int(b)) for a, b in rows], "chrom string, start long, end long")


def pairs(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


def test_merge_overlap_abut_nested(spark):
    assert pairs(iv.merge(frame(spark, [(30, 40), (0, 10), (10, 20), (15, 25)]))) == [(0, 25), (30, 40)]
    assert pairs(iv.merge(frame(spark, [(0, 100), (20, 30)]))) == [(0, 100)]


def test_merge_by_cells_is_the_same(spark):
    rows = frame(spark, [(i * 7 % 500, i * 7 % 500 + i % 11 + 1) for i in range(200)])
    assert pairs(iv.merge(rows, cell=64)) == pairs(iv.merge(rows))


def test_merge_refuses_empty_intervals(spark):
    with pytest.raises(Exception, match="end <= start"):
        iv.merge(frame(spark, [(50, 50)])).collect()


@pytest.mark.parametrize(
    "right, left",
    [((200, 300), [(0, 100)]), ((0, 100), []), ((0, 200), []), ((0, 40), [(40, 100)]), ((60, 100), [(0, 60)]), ((40, 60), [(0, 40), (60, 100)])],
)
def test_subtract_one(spark, right, left):
    assert pairs(iv.subtract(frame(spark, [(0, 100)]), frame(spark, [right]))) == left


def test_subtract_many(spark):
    out = iv.subtract(frame(spark, [(0, 100), (200, 300), (400, 500)]), frame(spark, [(10, 20), (50, 250), (460, 600)]))
    assert pairs(out) == [(0, 10), (20, 50), (250, 300), (400, 460)]


def test_pad(spark):
    assert pairs(iv.pad(frame(spark, [(100, 200), (260, 300)]), 30)) == [(70, 330)]
    assert pairs(iv.pad(frame(spark, [(10, 20)]), 50)) == [(0, 70)]
    with pytest.raises(ValueError):
        iv.pad(frame(spark, [(10, 20)]), -1)


def test_tile(spark):
    rows = frame(spark, [(0, 250)], "a").union(frame(spark, [(1000, 1099)], "b")).union(frame(spark, [(1000, 1100)], "d"))
    assert sorted(tuple(r) for r in iv.tile(rows, 100).select("chrom", "start", "end").collect()) == [("a", 0, 100), ("a", 100, 200), ("d", 1000, 1100)]
    assert pairs(iv.tile(frame(spark, [(0, 90), (100, 190)]), 100)) == []


def bins(spark, n, width=128):
    return spark.range(n).select(F.lit("c").alias("chrom"), (F.col("id") * width).alias("bin_start"), ((F.col("id") + 1) * width).alias("bin_end"))


@pytest.mark.parametrize(
    "spans, want",
    [([(128, 256)], [0, 1, 0, 0]), ([(0, 128)], [1, 0, 0, 0]), ([(127, 129)], [1, 1, 0, 0]), ([(100, 500), (200, 260)], [1, 1, 1, 1])],
)
def test_labels_agree(spark, spans, want):
    own, b = frame(spark, spans), bins(spark, 4)
    for f in (lambda: iv.label_bins(b, own, width=128), lambda: iv.label_bins_sweep(b, own)):
        assert [int(r["label"]) for r in f().orderBy("bin_start").collect()] == want


def test_circular_shift(spark):
    row = lambda s, e, off: spark.createDataFrame([("c", 0, 100, s, e, off)], "chrom string, low long, high long, start long, end long, offset long")
    assert pairs(iv.circular_shift(row(10, 20, 25))) == [(35, 45)]
    assert pairs(iv.circular_shift(row(90, 100, 5))) == [(0, 5), (95, 100)]
    assert sum(b - a for a, b in pairs(iv.circular_shift(row(0, 250, 7)))) == 100


def test_grid_map_keeps_unobserved_apart(spark):
    seen = spark.createDataFrame([("c", 0, True), ("c", 256, False)], "chrom string, bin_start long, y boolean")
    out = [(r["positive"], r["observed"]) for r in iv.map_to_grid(bins(spark, 4), seen, "y").orderBy("bin_start").collect()]
    assert out == [(True, True), (False, False), (False, True), (False, False)]


def test_runs_domains_centres(spark):
    b = bins(spark, 9).where("bin_start <> 512").withColumn("label", F.col("bin_start").isin(128, 256, 384, 640))
    assert [r["run"] for r in iv.contiguous_runs(b).orderBy("bin_start").collect()] == [1] * 4 + [2] * 4
    assert sorted(r["n_bins"] for r in iv.domains(b).collect()) == [1, 3]
    assert sorted(r["centre"] for r in iv.domain_centres(b).collect()) == [256, 640]


def test_n_runs_join_across_pieces(spark):
    rows = spark.createDataFrame([("c", 0, "ACNN"), ("c", 4, "nnGT"), ("c", 8, "NAAA")], "chrom string, offset long, sequence string")
    assert pairs(iv.n_runs(rows, 3)) == [(2, 6)]


def test_first_containing_and_gap(spark):
    points = spark.createDataFrame([("c", 50), ("c", 5)], "chrom string, pos long")
    out = iv.first_containing(points, frame(spark, [(0, 100), (40, 200)]), 10).collect()
    assert [(r["pos"], r["win_start"]) for r in out] == [(50, 0)]
    assert [tuple(r)[1:] for r in iv.largest_gap(frame(spark, [(0, 5), (10, 15), (20, 22)])).collect()] == [(0, 5)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12)), min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12)), min_size=1, max_size=12))
def test_subtract_against_sets(spark, left, right):
    a, b = ([(s, s + n) for s, n in x] for x in (left, right))
    covered = lambda x: {i for s, e in x for i in range(s, e)}
    got = pairs(iv.subtract(iv.merge(frame(spark, a)), iv.merge(frame(spark, b))))
    assert covered(got) == covered(a) - covered(b)
    assert all(e1 < s2 for (_, e1), (s2, _) in zip(got, got[1:], strict=False))

"""What the findings of round 3 named: plans that read a part more than once, steps that grow with it, and cuts."""

import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.functions import sequence
from quillon.operators import inference, intervals, manifests, orders
from quillon.plans import cohorts  # noqa: F401  registers its queries
from quillon.plans.queries import ORACLES, QUERIES
from quillon.sources import fasta

TABLES = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")


def both(spark, name):
    """The query's rows and those of its SQL."""
    con = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    close = lambda rows: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    return close(tuple(r) for r in QUERIES[name](spark, str(TABLES)).select(*columns).collect()), close(want.fetchall())


def leaves(frame):
    return str(frame._jdf.queryExecution().analyzed().toString()).count("LogicalRDD")


@needs_tables
def test_overlaps_build_the_manifest(spark):
    assert "man AS" in ORACLES["manifest_overlaps"] and "DISTINCT" not in ORACLES["manifest_overlaps"].split("man AS")[1]
    got, want = both(spark, "manifest_overlaps")
    assert got == want and got


def test_subtraction_makes_each_side_once(spark):
    rows = lambda *r: spark.createDataFrame([("c", a, b) for a, b in r], "chrom string, start long, end long")
    cut = intervals.subtract(rows((0, 100)), rows((10, 20), (90, 110)))
    assert sorted((r["start"], r["end"]) for r in cut.collect()) == [(0, 10), (20, 90)]
    assert leaves(cut) == 2


def test_territory_does_not_grow_with_its_steps(spark):
    regions = spark.createDataFrame([("c", 0, 10, "a"), ("c", 20, 30, "b"), ("c", 40, 50, "x")], "chrom string, start long, end long, fold string")
    held, trained = intervals.territory(regions, "a", "b", 12)
    assert leaves(held) + leaves(trained) <= 6
    assert [[(r["start"], r["end"]) for r in t.orderBy("start").collect()] for t in (held, trained)] == [[(0, 10), (20, 28)], [(40, 50)]]


def test_dealing_reads_the_pool_few_times(spark):
    pool = spark.createDataFrame([("c", i * 10) for i in range(300)], "chrom string, win_start long")
    dealt = manifests.deal(pool, ("chrom", "win_start"), {"test": 20, "train": 0})
    assert leaves(dealt) <= 3
    assert {r["split"]: r["count"] for r in dealt.groupBy("split").count().collect()} == {"test": 20, "train": 280}
    assert manifests.deal(pool, ("chrom", "win_start"), {"train": 0}).count() == 300
    with pytest.raises(ValueError, match="301 windows"):
        manifests.deal(pool, ("chrom", "win_start"), {"test": 301})


def test_many_short_records_share_partitions(spark, tmp_path):
    (tmp_path / "a.fa").write_text("".join(f">r{i}\nACGTAC\nGT\n" for i in range(500)))
    rows = fasta.read_chunks(spark, fasta.index_fasta(spark, str(tmp_path)), chunk=4, range_bytes=8)
    assert rows.rdd.getNumPartitions() <= fasta.PARTITIONS * spark.sparkContext.defaultParallelism
    got = rows.groupBy("chrom").agg(F.array_join(F.sort_array(F.collect_list(F.concat("chunk", F.lit(":"), "bases"))), "").alias("b")).collect()
    assert len(got) == 500 and {r["b"] for r in got} == {"0:ACGT1:ACGT"}


@needs_tables
def test_bases_through_files(spark):
    got, want = both(spark, "fasta_bases")
    assert got == want and got


def test_only_long_runs_and_those_at_ends_leave_a_text(spark):
    own = spark.createDataFrame([("a", 0, "NNACNNGNNNTnn"), ("a", 13, "NCNNAN"), ("b", 0, "ACNNGT"), ("c", 0, "NN"), ("c", 2, "N"), ("c", 3, "")], "chrom string, offset long, sequence string")
    assert [(r["chrom"], r["start"], r["end"]) for r in intervals.n_runs(own, 3).orderBy("chrom", "start").collect()] == [("a", 7, 10), ("a", 11, 14), ("c", 0, 3)]
    parts = intervals.n_runs(own.where("chrom = 'b'"), 3)._jdf.queryExecution().analyzed().toString()
    assert "{3,}" in parts


def test_hits_leave_a_scan_in_small_batches(spark, monkeypatch):
    own = spark.createDataFrame([("a", "ACGT" * 200), ("b", "acg"), ("c", "TTNACGTT")], "id string, sequence string")
    scores = spark.createDataFrame([(i, b, 1.0 if b == "ACGT"[i] else 0.0) for i in range(4) for b in "ACGT"], "pos int, base string, score double")
    monkeypatch.setattr(sequence, "HITS", 7)
    found = sequence.scan_motif(own, scores, 4, 0.9).collect()
    assert len(found) == 2 * 200 + 2 and {r["window"] for r in found} == {"ACGT"}
    assert sorted(r["start"] for r in found if r["id"] == "c") == [3, 3]


@needs_tables
@pytest.mark.parametrize("name", ["event_enrichment_blocks", "motif_scan_both_strands"])
def test_rows_are_the_sql_s(spark, name):
    got, want = both(spark, name)
    assert got == want and got


@needs_tables
def test_a_null_that_is_read_twice_is_made_once(spark):
    plan = str(QUERIES["match_table"](spark, str(TABLES))._jdf.queryExecution().withCachedData().toString())
    assert re.search(r"InMemoryRelation \[[^\]]*\bdraw#", plan)


def test_first_element_of_a_bin_gives_its_row(spark):
    rnd = random.Random(5)
    bins = [(i, "ab"[i % 2], i // 2 * 7, i // 2 * 7 + rnd.choice([3, 7, 12])) for i in range(60)]
    places = [(c, chrom, s, s + rnd.choice([1, 4, 9, 30])) for c in "xyz" for chrom in "ab" for s in rnd.sample(range(-5, 205), 9)] + [("w", "a", 0, 300), ("w", "b", 60, 104)]
    ends = [("a", 0, 100), ("a", 100, 200), ("b", 4, 90), ("b", 95, 101)]
    own = spark.createDataFrame(bins, "id int, chrom string, bin_start long, bin_end long")
    parts = spark.createDataFrame(places, "concept string, chrom string, start long, end long")
    domains = spark.createDataFrame(ends, "chrom string, low long, high long")
    offsets = inference.shift_offsets(domains, 20, "s").collect()
    want = set()
    for r in offsets:
        size = r["high"] - r["low"]
        for c, chrom, s, e in places:
            if chrom == r["chrom"] and s < r["high"] and e > r["low"]:
                covered = {r["low"] + (x - r["low"] + r["offset"]) % size for x in range(s, min(e, s + size))}
                want |= {(r["draw"], c, i) for i, b, low, high in bins if b == chrom and covered & set(range(low, high))}
    found = inference.shifted_positives(own, parts, domains, 20, "s", cell=16)
    rows = [tuple(r) for r in found.select("draw", "concept", "id").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want

    codes = spark.createDataFrame([(i, f, float(rnd.randrange(1, 4))) for i in range(60) for f in range(5) if rnd.random() < 0.4], "id int, feature int, value float")
    close = lambda f: sorted((r["draw"], r["concept"], round(r["value"], 9)) for r in f.collect())
    plain = inference.sparse_null(codes, found, parts.select("concept").distinct(), own, 20)
    assert close(inference.shifted_sparse_null(codes, own, parts, domains, 20, "s", cell=16)) == close(plain)


@needs_tables
@pytest.mark.parametrize("name", ["shifted_sparse_null", "shifted_null_discoveries"])
def test_elements_of_all_draws_are_dealt_and_not_ordered(spark, name):
    frame = QUERIES[name](spark, str(TABLES))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ShuffledHashJoin [__cell" in plan
    got, want = both(spark, name)
    assert got == want and got


def test_small_keys_are_ordered_at_once_and_large_ones_by_digits(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 1, 2, 2, 2, 2, 2, 2]), rnd.choice([None, 0.0, -0.0, 1.5, 2.5, float("nan"), 1e300]), 1) for _ in range(300)]
    frame = spark.createDataFrame(rows, "k int, v double, up long")
    close = lambda f: sorted((tuple(r) for r in f.select("k", F.col("v").cast("string"), "n", "up", "rk").collect()), key=repr)
    want = close(orders.tied_ranks(frame, ("k",), "v", ("up",)))
    for whole in (0, 60, 1 << 16):
        monkeypatch.setattr(orders, "WHOLE", whole)
        assert close(orders.tied_ranks(frame, ("k",), "v", ("up",), split=True)) == want


def test_a_step_of_the_t_tail_is_a_short_expression(spark):
    rows = spark.createDataFrame([(0.0, 5), (1.0, 2), (2.0, 11), (-2.5, 40), (0.3, 4000), (7.0, 3), (None, 9)], "t double, n long")
    frame = rows.select("n", inference.student_p(F.col("t"), F.col("n")).alias("p"))
    assert len(frame._jdf.queryExecution().analyzed().toString()) < 40_000
    found = [r["p"] for r in frame.collect()]
    assert found[:3] == [1.0, pytest.approx(0.5, abs=1e-9), pytest.approx(0.0733880, abs=1e-6)] and found[-1] == 1.0
    assert found[5] == pytest.approx(1 - 7 / 51**0.5, abs=1e-9)  # two degrees of freedom have a closed form


@needs_tables
def test_paired_p_values_by_part_are_the_sql_s(spark):
    got, want = both(spark, "paired_p_values_by_part")
    assert got == want and got

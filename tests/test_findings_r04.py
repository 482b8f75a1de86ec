"""What the finding of round 4 named: a plan that held its input hundreds of times."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.operators import enrichment, intervals
from quillon.plans import cohorts  # noqa: F401  registers its queries
from quillon.plans.queries import ORACLES, QUERIES
from test_findings_r03 import both, needs_tables

BINS = "chrom string, bin_start long, bin_end long, label boolean, score double"


def reads(frame):
    """How often the plan that runs, with what it persists, has its input."""
    return str(frame._jdf.queryExecution().executedPlan().toString()).count("Scan ExistingRDD")


def drawn(seed, n=90, step=10, width=10):
    rnd = random.Random(seed)
    return [(c, i * step, i * step + width, rnd.choice([True, False, False, None]), rnd.random()) for c in "ab" for i in range(n) if rnd.random() > 0.1]


@pytest.mark.parametrize("cell", [None, 70])
def test_bootstrap_plan_stays_small(spark, cell):
    frame = spark.createDataFrame(drawn(1), BINS)
    blocks = enrichment.event_blocks(frame, 10, 300, cell=cell)
    assert 0 < reads(blocks) <= 6
    assert 0 < reads(enrichment.log_enrichment(blocks, draws=5)) <= 12


@needs_tables
@pytest.mark.parametrize("name", ["event_bootstrap_ci", "event_enrichment_blocks"])
def test_enrichment_equals_sql(spark, name):
    got, want = both(spark, name)
    assert got == want and got


@pytest.mark.parametrize("width", [10, 15, 5])
@pytest.mark.parametrize("cell", [None, 1, 20, 33, 10_000])
def test_runs_among_bins_that_meet_a_condition(spark, cell, width):
    """Also of bins that overlap, that never abut, and with cells that hold none."""
    own = [r for r in drawn(3, width=width) if not (r[0] == "b" and 100 <= r[1] < 300)] + [("c", 0, width, None, 1.0)]
    frame = spark.createDataFrame(own, BINS)
    got = {(r["chrom"], r["bin_start"]): (r["run"], r["lab"]) for r in intervals.numbered_runs(frame, {"run": F.lit(True), "lab": F.col("label")}, cell=cell).collect()}
    want, last = {}, {}
    for c, s, e, lab, _ in sorted(own, key=lambda r: r[:2]):
        row = []
        for k, one in (("run", True), ("lab", lab)):
            n, end = last.get((c, k), (0, None))
            if one:
                last[c, k] = (n + (s != end), e)
            row.append(last[c, k][0] if one else None)
        want[c, s] = tuple(row)
    assert got == want and any(x[1] for x in got.values())


@pytest.mark.parametrize("cell", [None, 45])
def test_blocks_of_odd_bins(spark, cell):
    """A block without event and background is none; what a kernel would reach across a gap is background."""
    run = [("a", i * 10, i * 10 + 10, True, 1.0) for i in range(13)]  # its centre is 60: blocks 0 and 4 have labelled bins only
    gap = [("b", 60, 70, True, 5.0), ("b", 80, 90, False, 7.0), ("b", 90, 100, None, 9.0), ("b", 70, 80, True, None)]
    frame = spark.createDataFrame(run + gap + [("c", 0, 10, False, math.nan)], BINS)
    found = {r["block"]: tuple(r)[1:] for r in enrichment.event_blocks(frame, 10, 30, cell=cell).collect()}
    assert set(found) == {0, 2} and found[2] == pytest.approx((6.0, 2, 7.0, 1))
    assert found[0][1:2] + found[0][3:] == (0, 1) and math.isnan(found[0][2])
    none = enrichment.log_enrichment(enrichment.event_blocks(frame.where("false"), 10, 30, cell=cell), draws=3).collect()
    assert [tuple(r) for r in none] == [(None, None, None, 0)]


@pytest.mark.parametrize("name", ["event_bootstrap_ci", "event_enrichment_blocks"])
def test_events_without_user_or_time_count_nowhere(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_minutes(CAST(i * 37 % 9000 AS INTEGER)) AS ts, i % 3 AS user_id, CASE WHEN i % 5 = 0 THEN 'purchase' ELSE 'view' END AS event_type, CAST(i * 7 % 11 AS DOUBLE) AS value FROM range(300) t(i)")
    con.execute("UPDATE events SET user_id = NULL WHERE event_id % 13 = 0; UPDATE events SET ts = NULL WHERE event_id % 17 = 0")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    close = lambda rows: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    got = close(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*columns).collect())
    assert got == close(want.fetchall()) and None not in got[0]

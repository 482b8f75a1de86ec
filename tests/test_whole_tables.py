"""Queries over all rows, concepts and channels of a table, held against SQL that has no cuts."""

from pathlib import Path

import duckdb
import pytest

from quillon.plans.queries import ORACLES, QUERIES

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")


def both(spark, name):
    """The query's rows and those of its SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{TABLES}/embeddings.parquet')")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    close = lambda rows: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    return close(tuple(r) for r in QUERIES[name](spark, str(TABLES)).select(*columns).collect()), close(want.fetchall())


@pytest.mark.parametrize("cut", ["id % 10 = ", "concept < 3", "feature < 4", "feature < 8", "feature < 16", "event_id % 50 = ", "concept = 0)", "range(0, 20)", "range(0, 200)"])
def test_no_query_has_a_cut(cut):
    assert not [name for name, sql in ORACLES.items() if cut in sql]


def test_seed_agreement_compares_every_vector(spark):
    got, want = both(spark, "seed_agreement_cosine")
    assert got == want and len(got) == 250


@pytest.mark.parametrize(("name", "rows"), [("max_feature_null", 10 * 319), ("empirical_p", 10), ("match_table", 10)])
def test_all_ten_concepts_are_tested(spark, name, rows):
    got, want = both(spark, name)
    assert got == want and len(got) == rows


def test_average_precision_of_all_channels(spark):
    got, want = both(spark, "average_precision")
    assert got == want and len(got) == 640

import importlib.util
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quillon.plans.cohorts import ORACLES, QUERIES
from quillon.streaming import events as stream

TABLES = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    frame = QUERIES[name](spark, str(TABLES))
    assert sorted(frame.columns) == sorted(columns)
    close = lambda rows: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert close(tuple(r) for r in frame.select(*columns).collect()) == close(want.fetchall())


@needs_tables
def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_nothing_outside_imports_the_corpus_operators():
    for f in Path("quillon").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"quillon\.llm|corpus_pipeline", f.read_text()), f


def test_entry_without_the_corpus_operators(tmp_path):
    for absent in ("quillon.llm", "corpus_pipeline", "public_tokenizers"):
        code = f"import sys; sys.modules[{absent!r}] = None\nimport __spark_entry__ as e; assert len(e.queries()) > 50 and 'pipeline' not in e.queries() and e.oracle_sql()"
        subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__spark_entry__.__file__).parent)
    assert importlib.util.find_spec("quillon.plans")


@needs_tables
def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "events")
    spark.read.parquet(str(TABLES / "events.parquet")).repartitionByRange(3, "ts").write.parquet(source)
    q = stream.block_counts(stream.event_stream(spark, source, 3)).writeStream.format("memory").queryName("blocks").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    total = spark.sql("SELECT sum(n) AS n FROM blocks").first()["n"]
    assert total == spark.read.parquet(source).count()

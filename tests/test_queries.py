"""Every registered query of the core against DuckDB on the same tables, and streams against batches."""

import os

import duckdb
import pytest

from skein.plans.registry import QUERIES
from skein.streaming import heat

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    run, sql = QUERIES[name]
    df = run(spark, SF)
    columns = sorted(df.columns)
    if sql is None:  # trained by rounds over all rows: test_models.py compares it with numpy
        assert df.count() > 0
        return
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert normal(got) == normal(want)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartitionByRange(5, "ts").write.parquet(str(tmp_path / "in"))
    stream = heat.tumbling_heat(heat.event_stream(spark, str(tmp_path / "in"), events.schema, 99))
    q = stream.writeStream.format("memory").queryName("heat").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = QUERIES["tumbling_heat"][0](spark, SF)
    assert normal(map(tuple, spark.sql("SELECT start, event_type, n, heat FROM heat").collect())) == normal(map(tuple, batch.select("start", "event_type", "n", "heat").collect()))


def test_stream_drops_repeated_events(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").limit(200)
    events.union(events).write.parquet(str(tmp_path / "in"))
    q = heat.distinct_events(heat.event_stream(spark, str(tmp_path / "in"), events.schema, 99)).writeStream.format("memory").queryName("distinct").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT event_id FROM distinct").count() == 200


def test_entry_works_without_the_llm_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(QUERIES)), str(sum(sql is not None for _, sql in QUERIES.values()))], out.stderr

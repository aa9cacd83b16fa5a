"""The streaming queries over a table of many files in no order of time."""

import duckdb
import pytest
from pyspark.sql import functions as F

import weftline.plans  # noqa: F401
from tests.test_queries import plain
from weftline.plans import registry


@pytest.fixture(scope="module")
def many(spark, sf_dir, tmp_path_factory):
    """More files than two batches took before (late rows go from the third on); a few events in each."""
    d = tmp_path_factory.mktemp("many")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(230, F.xxhash64("event_id")).write.parquet(f"{d}/events.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["t01_t12_stream_once", "t16_t17_stream_metered", "t03_t15_stream_failures", "t02_t07_t11_stream_holds", "t05_t14_stream_sessions", "t04_t06_stream_routed"])
def test_unordered_files(spark, many, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view events as select * from '{many}/events.parquet/*.parquet'")
    assert con.execute(f"select count(*) from glob('{many}/events.parquet/*.parquet')").fetchone()[0] > 200
    df = registry.QUERIES[name](spark, many)
    cols = sorted(df.columns)
    ran = con.execute(registry.ORACLE[name])
    names = [d[0] for d in ran.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in ran.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want and want

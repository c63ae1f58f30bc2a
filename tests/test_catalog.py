"""Queries against their SQL oracles on the smallest tables, and the streaming forms."""

import os
from datetime import datetime, timedelta

import pytest

from alertloom.plans import catalog, detectors, stores  # noqa: F401  the last two add their queries
from alertloom.streaming.windows import capped_sessions, distinct_alerts, window_counts

DIR = os.environ.get("ALERTLOOM_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in sorted(os.listdir(DIR)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    found = catalog.QUERIES[name](spark, DIR)
    result = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(found.columns)
    text = lambda v: str(round(v, 6)) if isinstance(v, float) else str(v)
    assert sorted(tuple(text(r[c]) for c in columns) for r in found.collect()) == sorted(tuple(map(text, r)) for r in result.fetchall())


def stream(spark, tmp_path, query, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    seconds = [0, 60, 121, 500, 90000, 200000]
    for i, s in enumerate(seconds):
        rows = [(f"a{i}", "k", t0 + timedelta(seconds=s))] * (2 if i == 0 else 1)
        spark.createDataFrame(rows, "alert_id string, key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("alert_id string, key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = stream(spark, tmp_path, capped_sessions(distinct_alerts(source(), late="0 seconds"), "key", 60, 900, late=None), "sessions")
    spans = sorted(((r.first_ts - t0).total_seconds(), (r.last_ts - t0).total_seconds(), r.members) for r in found)
    assert spans[:4] == [(0, 60, 2), (121, 121, 1), (500, 500, 1), (90000, 90000, 1)][: len(spans)] and len(spans) >= 3
    days = stream(spark, tmp_path, window_counts(source(), "key", late="0 seconds"), "days")
    assert (t0, 7 - 2) in {(r.window_start, r.n) for r in days}

"""Streams in many small batches against the whole answer, with late and repeated rows."""

import os
import random
from datetime import datetime, timedelta

import pytest

from alertloom.operators import scoring
from alertloom.streaming.windows import capped_sessions, score_closed_days

T0 = datetime(2024, 1, 1)
SCHEMA = "alert_id string, key string, ts timestamp"


def feed(spark, tmp_path, batches):
    """A stream of one file a batch, in order."""
    for k, rows in enumerate(batches):
        data = [(f"{k}-{i}", key, T0 + timedelta(seconds=s)) for i, (key, s) in enumerate(rows)]
        where = tmp_path / f"part{k}"
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(str(where))
        (tmp_path / "in").mkdir(exist_ok=True)
        file = next(where.glob("*.parquet"))
        file.rename(tmp_path / "in" / f"{k:03}.parquet")
        os.utime(tmp_path / "in" / f"{k:03}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def sessions(rows, gap, cap):
    out = []
    for key in {k for k, _ in rows}:
        first = last = n = None
        for t in sorted(s for k, s in rows if k == key):
            if first is None or t - last > gap or t - first > cap:
                out += [] if first is None else [(key, first, last, n)]
                first, n = t, 0
            last, n = t, n + 1
        out.append((key, first, last, n))
    return sorted(out)


@pytest.mark.parametrize("late", ["0 seconds", "50 seconds"])
def test_sessions_of_a_stream_are_those_of_the_table(spark, tmp_path, late):
    rng = random.Random(9)
    slack = int(late.split()[0])
    rows, now = [], 0
    for _ in range(8):
        batch = [(rng.choice(["hot", "hot", "hot", "b", "c"]), now + rng.randrange(-slack, 120)) for _ in range(60)]
        now = max([now, *(s for _, s in batch)])
        rows.append([(k, s) for k, s in batch])
    # rows behind the watermark of the batches before are dropped by the engine
    kept, top = [], None
    for batch in rows:
        kept += [(k, s) for k, s in batch if top is None or s >= top - slack]
        top = max([s for _, s in batch] + ([top] if top is not None else []))
    end = [[("end", top + 5000)], [("end", top + 9000)]]
    got = run(capped_sessions(feed(spark, tmp_path, rows + end), "key", 20, 90, late), tmp_path, f"s{slack}")
    told = sorted((r.key, int((r.first_ts - T0).total_seconds()), int((r.last_ts - T0).total_seconds()), r.members) for r in got)
    want = [s for s in sessions(kept, 20, 90) if s[0] != "end"]
    assert [s for s in told if s[0] != "end"] == want and len(want) > 15


def objects(spark, rows):
    made = [("alert", i, T0 + timedelta(seconds=s), T0 + timedelta(seconds=s), "d", "sem", ["s"], [t], ["tcp/1"], [i], "{}") for i, s, t in rows]
    schema = (
        "object_type string, object_id string, start_ts timestamp, end_ts timestamp, alert_source string, alert_semantics string, "
        "sources array<string>, targets array<string>, services array<string>, member_ids array<string>, attributes string"
    )
    return scoring.with_pattern(spark.createDataFrame(made, schema))


def test_days_are_closed_once_and_late_objects_are_told(spark, tmp_path):
    day = 86400
    batches = [
        [("a", 0, "t"), ("b", 60, "u")],
        [("c", day + 5, "u"), ("d", 70, "t")],  # d comes before its day is closed
        [("e", 2 * day + 11, "t")],
        [("late", 100, "t"), ("f", 2 * day + 50, "u")],
        [("g", 4 * day, "t"), ("later", day + 7, "t")],
    ]
    first = objects(spark, batches[0])
    for rows in batches:
        objects(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "o"))
        stream = spark.readStream.schema(first.schema).parquet(str(tmp_path / "o"))
        q = score_closed_days(stream, str(tmp_path / "d"), str(tmp_path / "e"), late_seconds=10)
        q.processAllAvailable()
        q.stop()
    scored = {r.object_id: r.total for r in spark.read.parquet(str(tmp_path / "d" / "scores")).collect()}
    on_time = [r for rows in batches for r in rows if r[0] not in ("late", "later", "g")]
    want = {r.object_id: r.total for r in scoring.score(objects(spark, on_time)).collect()}
    assert scored == want
    assert {r.object_id for r in spark.read.parquet(str(tmp_path / "d" / "late")).collect()} == {"late", "later"}
    left = spark.read.parquet(str(tmp_path / "d" / "progress" / "batch=4")).collect()
    assert [(r.day, r.n) for r in left] == [("2024-01-05", 1)]

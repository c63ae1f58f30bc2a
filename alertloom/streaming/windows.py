"""Streaming forms: windowed counts, deduplication, gap-and-cap sessions, fixed windows and daily scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from alertloom.operators.scoring import score, window_start


def window_counts(alerts: DataFrame, key: str, window: str = "1 day", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Counts of a key in each UTC window, final once the watermark has passed its end."""
    return (
        alerts.withWatermark(ts, late)
        .groupBy(F.window(ts, window), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), key, "n")
    )


def distinct_alerts(alerts: DataFrame, ident: str = "alert_id", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Each alert id once within the watermark."""
    return alerts.withWatermark(ts, late).dropDuplicatesWithinWatermark([ident])


class _Sessions(StatefulProcessor):
    """Of each key: the open session (first, last, members) and the times that others may still come before, with their numbers.

    No row can come any more that is older than the key's latest time by the lateness, as the watermark of the next batch is at least that, so
    all older times are folded at once, and what waits is what came within the lateness."""

    def __init__(self, gap: int, cap: int, late: int | None) -> None:
        self.gap, self.cap, self.late = gap, cap, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "first long, last long, members long")
        self.waiting = handle.getListState("waiting", "t long, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        counts = Counter()
        for pdf in rows:
            counts.update(pdf["t"].tolist())
        return self._advance(key, counts, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._advance(key, Counter(), timerValues)

    def _advance(self, key: tuple, counts: Counter, timers: TimerValues) -> Iterator[pd.DataFrame]:
        sure = timers.getCurrentWatermarkInMs() * 1000
        for t, n in self.waiting.get():
            counts[t] += n
        if self.late is not None and counts:
            sure = max(sure, max(counts) - self.late)
        open_one = tuple(self.session.get()) if self.session.exists() else None
        out = []
        for t in sorted(t for t in counts if t < sure):
            n = counts.pop(t)
            if open_one and t < open_one[1]:  # a row that the stream has declared too late
                continue
            if open_one and t - open_one[1] <= self.gap and t - open_one[0] <= self.cap:
                open_one = (open_one[0], t, open_one[2] + n)
            else:
                out += [open_one] if open_one else []
                open_one = (t, t, n)
        if open_one and self._end(open_one) < sure:
            out.append(open_one)
            open_one = None
        if open_one:
            self.session.update(open_one)
        else:
            self.session.clear()
        if counts:
            self.waiting.put(sorted(counts.items()))
        else:
            self.waiting.clear()
        due = [self._end(open_one)] if open_one else []
        due += [max(counts)] if counts else []
        if due:
            # one timer a key: stale ones would only wake it for nothing
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(max(min(due) // 1000 + 1, timers.getCurrentWatermarkInMs() + 1))
        found = [(str(key[0]) if key[0] is not None else None, *s) for s in out]
        yield pd.DataFrame(found, columns=["key", "first_us", "last_us", "members"])

    def _end(self, session: tuple) -> int:
        return min(session[1] + self.gap, session[0] + self.cap)

    def close(self) -> None:
        pass


def capped_sessions(
    alerts: DataFrame, key: str, gap_seconds: float, cap_seconds: float, late: str | None = "0 seconds", ts: str = "ts"
) -> DataFrame:
    """key, first_ts, last_ts, members: sessions that end by gap or cap, emitted when no later member is possible. With late None the input already
    has its watermark, and times wait until that has passed them.

    State holds one open session of each key and the times within the lateness, so it doesn't grow with a flood. It is kept by transformWithState,
    which needs the session's RocksDB state store; this function chooses it."""
    spark = alerts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    slack = None if late is None else spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {late})").first()[0]
    timed = alerts if late is None else alerts.withWatermark(ts, late)
    rows = timed.select(F.col(key).cast("string").alias("key"), F.unix_micros(ts).alias("t"), ts)
    found = rows.groupBy("key").transformWithStateInPandas(
        _Sessions(int(gap_seconds * 1e6), int(cap_seconds * 1e6), slack), "key string, first_us long, last_us long, members long", "append", "EventTime"
    )
    return found.select(
        F.col("key").alias(key), F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"), "members"
    )


def first_member_windows(
    alerts: DataFrame, key: str, window_seconds: float, late: str | None = "0 seconds", ts: str = "ts"
) -> DataFrame:
    """key, first_ts, last_ts, members: windows from a key's first alert on, whatever the gaps inside. A window is
    emitted when the watermark has passed its end."""
    return capped_sessions(alerts, key, window_seconds, window_seconds, late, ts)


def score_closed_days(objects: DataFrame, path: str, checkpoint: str, late_seconds: int = 3600, ts: str = "start_ts") -> StreamingQuery:
    """Starts a stream that scores each UTC day once it is closed: the latest start seen is late_seconds past its end.

    Objects (with their pattern) are kept under path/objects by day and micro-batch, and scores under path/scores by day, so that a batch that is
    repeated replaces what it wrote. A batch reads the days that it closes and the state that the batch before left under path/progress: the latest start
    and the number of objects of each open day. Objects without a time, or whose day was closed before they came, go to path/late instead."""
    spark = objects.sparkSession

    def fold(batch: DataFrame, number: int) -> None:
        day = F.date_format(window_start(F.col(ts), 86400), "yyyy-MM-dd")
        rows = batch.withColumns({"day": day, "batch": F.lit(number)}).persist()
        try:
            seen, latest = _progress(spark, f"{path}/progress", number)
            on_time = F.coalesce(F.lit(latest is None) | (F.unix_seconds(window_start(F.col(ts), 86400)) + 86400 + late_seconds > F.lit(latest)), F.lit(False))
            by_batch = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            by_batch(rows.filter(on_time)).partitionBy("day", "batch").parquet(f"{path}/objects")
            by_batch(rows.filter(~on_time)).partitionBy("batch").parquet(f"{path}/late")
            told = rows.filter(on_time).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_seconds(ts)).alias("latest")).collect()  # a row a day
        finally:
            rows.unpersist()
        for r in told:
            seen[r["day"]] = seen.get(r["day"], 0) + r["n"]
            latest = r["latest"] if latest is None else max(latest, r["latest"])
        if latest is None:
            return
        ends = {d: int(datetime.fromisoformat(d).replace(tzinfo=timezone.utc).timestamp()) + 86400 for d in seen}
        due = sorted(d for d, end in ends.items() if end + late_seconds <= latest)
        if due:
            kept = spark.read.schema(rows.schema).option("basePath", f"{path}/objects")
            scores = score(kept.parquet(*[f"{path}/objects/day={d}" for d in due]).drop("batch"))
            by_batch(scores).partitionBy("day").parquet(f"{path}/scores")
        left = [(d, n, latest) for d, n in seen.items() if d not in due] or [(None, 0, latest)]
        spark.createDataFrame(left, "day string, n long, latest long").coalesce(1).write.mode("overwrite").parquet(f"{path}/progress/batch={number}")

    return objects.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).start()


def _progress(spark: SparkSession, path: str, number: int) -> tuple[dict[str, int], int | None]:
    """Objects of each open day and the latest start, as the last batch before this one left them: a row for each open day."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for before in range(number - 1, -1, -1):  # a batch without objects leaves none
        if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={before}/_SUCCESS")):
            rows = spark.read.parquet(f"{path}/batch={before}").collect()
            return {r["day"]: r["n"] for r in rows if r["day"] is not None}, rows[0]["latest"]
    return {}, None

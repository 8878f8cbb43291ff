"""Sessions of events on streams: by Spark's own session windows, and by a state of our own with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Keeps state in a store on local disk with a change log in the checkpoint folder, which timers and lists need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SESSION = "user_id long, start_us long, finish_us long, n long, total double, largest double"


def timed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """`events` with the time `at`, which a stream waits for by `late`."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    return rows.withWatermark("at", late) if rows.isStreaming else rows


def session_windows(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n, total of the sessions that a pause of at least `gap` ends. A stream appends a session once the watermark has passed its end."""
    # start and end are aggregates, not the window's own fields: a filter on these is pushed below the merging of windows and breaks sessions
    facts = F.min("at").alias("start"), (F.max("at") + F.expr(f"INTERVAL {gap}")).alias("end"), F.count("*").alias("n"), F.sum("value").alias("total")
    return timed(events, late).groupBy("user_id", F.session_window("at", gap)).agg(*facts).select("user_id", "start", "end", "n", "total")


def merged(sessions: list[tuple], gap: int) -> list[tuple]:
    """Sessions (start, finish, n, total, largest value), times in microseconds, joined where less than `gap` lies between."""
    out: list[tuple] = []
    for s in sorted(sessions):
        if out and s[0] < out[-1][1] + gap:
            start, finish, n, total, largest = out[-1]
            out[-1] = start, max(finish, s[1]), n + s[2], total + s[3], max(largest, s[4])
        else:
            out.append(s)
    return out


class SessionState(StatefulProcessor):
    """A user's open sessions, with a timer at the end of the first to end; events may come out of order, within the watermark.

    An event joins the sessions that it reaches, which may move the timer. The timer emits and forgets all that the watermark has ended by then and
    goes on to the next end, so state is held for the open sessions alone, however long the stream runs, and is read and written once
    a batch and once a timer, however many sessions a user has.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, finish long, n long, total double, largest double")

    def _end(self, session: tuple) -> int:
        """In milliseconds, as timers and watermarks count."""
        return -(-(session[1] + self.gap) // 1000)

    def _replace(self, before: list[tuple], after: list[tuple]) -> None:
        old, new = (min(map(self._end, x), default=None) for x in (before, after))
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        if after:
            self.open.put(after)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = [tuple(s) for s in self.open.get()]
        sessions = list(before)
        for r in rows:
            at = r["us"]
            value = r["value"] or 0.0
            sessions.append((at, at, 1, value, value))
            if len(sessions) > 10_000:  # what a user sends at once needs no more memory than the sessions that come of it
                sessions = merged(sessions, self.gap)
        self._replace(before, merged(sessions, self.gap))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        before = [tuple(s) for s in self.open.get()]
        ended = [s for s in before if self._end(s) <= now]
        self._replace(before, [s for s in before if self._end(s) > now])
        for start, finish, n, total, largest in ended:
            yield Row(user_id=key[0], start_us=start, finish_us=finish, n=n, total=total, largest=largest)

    def close(self) -> None:
        pass


def timer_sessions(events: DataFrame, gap_seconds: int, late: str = "1 hour") -> DataFrame:
    """SESSION rows of a stream of events, times as microseconds since 1970: sessions end by a timer `gap_seconds` after their last event.

    Null user_ids and times are dropped; a null value counts as 0. Run it with STATE_STORE.
    """
    rows = timed(events, late).filter("user_id is not null and at is not null").select("user_id", "at", "value", F.unix_micros("at").alias("us"))
    return rows.groupBy("user_id").transformWithState(SessionState(gap_seconds * 1_000_000), SESSION, "append", "eventTime")


def run_to_table(stream: DataFrame, sink: str, checkpoint: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Runs an appending stream over all that its source has now, with `conf` as it starts, and reads what it wrote."""
    spark, before = stream.sparkSession, {}
    for k, v in (conf or {}).items():
        before[k] = spark.conf.get(k, None)
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)

"""Monitoring as streams: sliding means, alarm sessions, alarms joined with episodes, and an alarm state machine."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.settings import DEFAULT, HOUR, Settings


def timed(events: DataFrame) -> DataFrame:
    """Event time as a timestamp with zone, which watermarks ask for."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def sliding(events: DataFrame, s: Settings = DEFAULT, late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n, mean_value of overlapping windows."""
    window = F.window("ts", f"{s.window_h} hours", f"{s.grid_h} hours")
    rows = timed(events).withWatermark("ts", late).groupBy(window, "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return rows.select("user_id", "window.start", "window.end", "n", "mean_value")


def alarm_sessions(events: DataFrame, s: Settings = DEFAULT, late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n: low values with gaps shorter than the grid."""
    low = timed(events).where(F.col("value") < s.low).withWatermark("ts", late)
    rows = low.groupBy(F.session_window("ts", f"{s.grid_h} hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", "w.start", "w.end", "n")


def alarms_before(alarms: DataFrame, onsets: DataFrame, s: Settings = DEFAULT, late: str = "1 hour") -> DataFrame:
    """Alarms (user_id, at) with the onsets (user_id, onset) inside their horizon."""
    a = alarms.select("user_id", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late).alias("a")
    o = onsets.select("user_id", F.col("onset").cast("timestamp").alias("onset")).withWatermark("onset", late).alias("o")
    horizon = F.expr(f"interval {s.alarm_horizon_h} hours")
    return a.join(o, (F.col("a.user_id") == F.col("o.user_id")) & (F.col("onset") > F.col("at")) & (F.col("onset") <= F.col("at") + horizon)).select("a.user_id", "at", "onset")


class AlarmMachine(StatefulProcessor):
    """One user's alarm: values wait until the watermark has passed them, and are then taken in order of time. An alarm
    is on from the value that makes a run of low values long enough until a value that is not low, or until no value came
    for the time of expiry; the state is then deleted."""

    def __init__(self, low: float, least: int, expiry_us: int) -> None:
        self.low, self.least, self.expiry = low, least, expiry_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "n int, last_us long")
        self.held = handle.getListState("held", "us long, event_id long, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = [(r.us, r.event_id, r.value) for r in rows]
        self.held.appendList(new)
        for ms in {us // 1000 + 1 for us, _, _ in new}:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.held.get()) if self.held.exists() else []
        ready, rest = [r for r in held if r[0] < now], [r for r in held if r[0] >= now]
        n, last = self.run.get() if self.run.exists() else (0, None)
        out = []
        for us, _, value in ready:
            if last is not None and us - last >= self.expiry:
                out += [(last + self.expiry, "off")] * (n >= self.least)
                n = 0
            if value < self.low:
                n += 1
                out += [(us, "on")] * (n == self.least)
            else:
                out += [(us, "off")] * (n >= self.least)
                n = 0
            last = us
        if ready:
            self.held.put(rest) if rest else self.held.clear()
            self.handle.registerTimer((last + self.expiry) // 1000 + 1)
        if last is not None and not rest and last + self.expiry <= now:
            out += [(last + self.expiry, "off")] * (n >= self.least)
            self.run.clear()
        elif ready:
            self.run.update((min(n, self.least), last))
        for us, state in out:
            yield Row(user_id=key[0], us=us, state=state)

    def close(self) -> None:
        pass


def alarm_states(events: DataFrame, s: Settings = DEFAULT, late: str = "1 hour") -> DataFrame:
    """user_id, at, state: a row whenever a user's run of low values reaches the least length, or ends after that. Values
    may come out of order by ``late``; those that come later are dropped. State lives in RocksDB and expires after
    ``s.window_h`` hours of event time without a value; null values don't count."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = timed(events).where("user_id IS NOT NULL AND value IS NOT NULL").withWatermark("ts", late).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"), "value")
    machine = AlarmMachine(s.low, s.min_run, s.window_h * HOUR)
    found = rows.groupBy("user_id").transformWithState(machine, "user_id long, us long, state string", "Append", "EventTime")
    return found.select("user_id", F.timestamp_micros("us").alias("at"), "state")

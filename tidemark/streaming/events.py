"""Streaming forms of the event operators.

Event times are cast to TIMESTAMP, as watermarks need; rows later than the
watermark are dropped, and the state of closed windows with them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

LATE = "10 minutes"


def read(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files: int = 1) -> DataFrame:
    """A stream of event files with a time that can carry a watermark."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files).load(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_stats(ops: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Statistics of each operation and window."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return ops.withWatermark("ts", late).groupBy(w.alias("w"), "operation").agg(
        F.count("*").alias("n"), F.count_if("success").alias("n_success"), F.avg("duration_ms").alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "operation", "n", "n_success", "avg_ms", "min_ms", "max_ms")


def violations(ops: DataFrame, max_ms: float, max_error_rate: float = 0.1, least: int = 10, window: str = "1 hour") -> DataFrame:
    """Windows in which an operation is slow or fails too often."""
    return windowed_stats(ops, window).where((F.col("n") >= least) & ((F.col("avg_ms") > max_ms) | (1 - F.col("n_success") / F.col("n") > max_error_rate)))


def daily_volume(rows: DataFrame, late: str = LATE) -> DataFrame:
    """(G1)"""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "n")


ALERTS = "rule string, event string, ts timestamp, value double"
_STATE = "start double, last double, active boolean, newest double"


def alerts(samples: DataFrame, minutes: float = 1, cooldown: float = 15, late: str = LATE, quiet: str = "1 hour") -> DataFrame:
    """Alerts and recoveries of each rule from samples (rule, ts, value, bad).

    A rule fires when it has been violated for ``minutes``, not again within
    ``cooldown``, and is resolved by the next good sample. State is one row per
    rule, dropped when the watermark is ``quiet`` past its newest sample.
    Within a batch samples are taken in order of time; a sample older than the
    newest one seen is left out.
    """
    hold, pause, gone = minutes * 60, cooldown * 60, pd.Timedelta(quiet).total_seconds()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, last, active, newest = state.get if state.exists else (None, None, False, float("-inf"))
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for ts, value, bad in zip(rows["ts"], rows["value"], rows["bad"], strict=True):
            at = ts.timestamp()
            if at < newest:
                continue
            newest = at
            if bad:
                if start is None:
                    start = at
                elif at - start >= hold and (last is None or at - last >= pause):
                    out.append((key[0], "fired", ts, value))
                    last, active = at, True
            else:
                start = None
                if active:
                    out.append((key[0], "resolved", ts, value))
                    active = False
        state.update((start, last, active, newest))
        mark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(int((newest + gone) * 1000), mark + 1))
        if out:
            yield pd.DataFrame(out, columns=["rule", "event", "ts", "value"])

    return samples.withWatermark("ts", late).groupBy("rule").applyInPandasWithState(step, ALERTS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


#: What keeps state with timers.
TIMER_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Streams that start meanwhile may have timers."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, TIMER_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Held(StatefulProcessor):
    """One rule. Samples wait until the watermark has passed them, so they are taken in order of their times whatever batch brought them."""

    def __init__(self, hold: int, pause: int, quiet: int):
        self.hold, self.pause, self.quiet = hold, pause, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, bad boolean")
        self.run = handle.getValueState("run", "start long, due long, sent long, active boolean, newest long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        yield from self._upto(key[0], timerValues.getCurrentWatermarkInMs(), [(r["at"], bool(r["bad"])) for r in rows])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield from self._upto(key[0], timerValues.getCurrentWatermarkInMs())

    def _upto(self, rule, mark_ms: int, new: Sequence[tuple[int, bool]] = ()) -> Iterator[Row]:
        """What happened up to the watermark, from samples that waited and new ones. Each call of the state waits for an answer, so there are a few of them a batch, whatever the number of samples."""
        mark = max(mark_ms, 0) * 1000
        start, due, sent, active, newest = self.run.get() if self.run.exists() else (None, None, None, False, 0)
        waiting = sorted([*((x[0], x[1]) for x in self.waiting.get()), *new]) if self.waiting.exists() else sorted(new)
        out = []

        def fire() -> None:
            nonlocal due, sent, active
            if sent is None or due - sent >= self.pause:
                out.append(("fired", due))
                sent, active = due, True
            due = None

        ready = [x for x in waiting if x[0] <= mark]
        for at, bad in ready:
            if due is not None and (due < at or due == at and bad):
                fire()
            newest = max(newest, at)
            if bad:
                if start is None:
                    start, due = at, at + self.hold
                    if due == at:
                        fire()
            else:
                start = due = None
                if active:
                    out.append(("resolved", at))
                    active = False
        if due is not None and due <= mark:
            fire()
        rest = waiting[len(ready) :]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not rest and due is None and newest + self.quiet <= mark:  # nothing to come, and nothing came for long
            self.run.clear()
            self.waiting.clear()
        else:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            self.run.update((start, due, sent, active, newest))
            wake = min([x for x in (rest[0][0] if rest else None, due) if x is not None], default=newest + self.quiet)
            self.handle.registerTimer(max(-(-wake // 1000), mark_ms + 1))
        for event, at in out:
            yield Row(rule=rule, event=event, at=at)

    def close(self) -> None:
        pass


def timed_alerts(samples: DataFrame, minutes: float = 1, cooldown: float = 15, late: str = LATE, quiet: str = "1 day") -> DataFrame:
    """Alerts and recoveries of each rule from samples (rule, ts, bad): rule, event, ts.

    As :func:`tidemark.operators.monitoring.held`: a rule fires ``minutes`` after
    its first violation unless a good sample came by then, also if no sample comes
    at all, as the watermark wakes it. One that comes due within ``cooldown`` of
    the last that was sent isn't sent. Needs :func:`timers` when it starts. State
    is what the watermark has not passed, and one row per rule, which goes when a
    rule that is not about to fire was ``quiet`` for that long; a violation that
    still lasts then, and the time of the last alert, are forgotten with it.
    """
    micros = lambda m: round(m * 60_000_000)
    processor = _Held(micros(minutes), micros(cooldown), int(pd.Timedelta(quiet) / pd.Timedelta(microseconds=1)))
    rows = samples.where("rule is not null").select("rule", "ts", F.unix_micros("ts").alias("at"), "bad").withWatermark("ts", late)
    out = rows.groupBy("rule").transformWithState(processor, "rule string, event string, at long", "Append", "EventTime")
    return out.select("rule", "event", F.timestamp_micros("at").alias("ts"))

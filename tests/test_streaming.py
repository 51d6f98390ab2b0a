"""Streams give what batches give on the same events."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import monitoring
from tidemark.streaming import events as E

T0 = datetime(2024, 1, 1)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_windowed_stats(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet")
    e.orderBy("ts").repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/e")
    stream = E.read(spark, f"{tmp_path}/e", e.schema, files=10)
    ops = lambda d: monitoring.as_operations(d)
    got = run(E.windowed_stats(ops(stream), "1 day"), "stats", "complete")
    want = ops(e).groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "operation").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("a"))
    a = {(r.start, r.operation): (r.n, round(r.avg_ms, 6)) for r in got.collect()}
    b = {(r.w.start, r.operation): (r.n, round(r.a, 6)) for r in want.collect()}
    assert a == b and a
    assert sum(r.n for r in run(E.daily_volume(E.read(spark, f"{tmp_path}/e", e.schema, files=10)), "daily", "complete").collect()) == e.count()


def test_stream_alerts(spark, tmp_path):
    rows = [("r", T0 + timedelta(minutes=m), 1.0, b) for m, b in ((0, True), (5, True), (10, True), (15, False), (18, True), (24, True), (30, False))]
    schema = "rule string, ts timestamp, value double, bad boolean"
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/s")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/s")
    got = run(E.alerts(stream, minutes=5, cooldown=15, late="1 hour"), "alerts").orderBy("ts").toPandas()
    at = lambda m: pd.Timestamp(T0 + timedelta(minutes=m))
    assert [(r.event, r.ts) for r in got.itertuples()] == [("fired", at(5)), ("resolved", at(15)), ("fired", at(24)), ("resolved", at(30))]


def timed(spark, folder, samples, parts, **settings):
    """The samples in files, the stream stopped and started again after every one."""
    schema, got = "rule string, ts timestamp, bad boolean", f"{folder}/out"
    n = -(-len(samples) // parts)
    for i in range(0, len(samples), n):
        spark.createDataFrame(samples[i : i + n], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = E.read(spark, f"{folder}/in", spark.createDataFrame([], schema).schema)
        write = lambda b, k: b.write.mode("overwrite").parquet(f"{got}/b={k}")
        with E.timers(spark):
            E.timed_alerts(stream, **settings).writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start().awaitTermination()
    return sorted((r.rule, r.event, r.ts) for r in spark.read.schema("rule string, event string, ts timestamp").parquet(f"{got}/b=*").collect())


def test_timed_alerts_with_restarts(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    a = [("a", at(m), bad) for m, bad in ((0, True), (3, True), (5, False), (10, True), (40, True), (55, False), (58, True), (70, False), (90, True), (94, False))]
    b = [("b", at(20), True), ("c", at(400), False)]  # no sample of b comes when it is due
    samples = sorted(a + b, key=lambda r: r[1])
    samples[1], samples[4] = samples[4], samples[1]  # out of order, but in time
    got = timed(spark, tmp_path, samples, 4, minutes=5, cooldown=60, late="2 hours")
    want = [("a", "fired", at(15)), ("a", "resolved", at(55)), ("b", "fired", at(25))]
    assert got == want
    s = spark.createDataFrame(samples, "rule string, ts timestamp_ntz, bad boolean")
    alerts = monitoring.held(s, 5, "rule", until=F.lit(at(280)).cast("timestamp_ntz"))
    assert sorted((r.rule, r.fired) for r in monitoring.cooled(alerts, 60, "rule").collect()) == [(k, t) for k, e, t in want if e == "fired"]


class _Kept:
    """A list or a value of the state; every call of it counts, as each waits for an answer."""

    def __init__(self, calls):
        self.calls, self.held = calls, None

    def exists(self):
        self.calls.append("exists")
        return self.held is not None

    def get(self):
        return self.held

    def put(self, x):
        self.calls.append("put")
        self.held = x

    update = put

    def appendValue(self, x):  # noqa: N802
        self.put([*(self.held or []), x])

    def clear(self):
        self.calls.append("clear")
        self.held = None


class _Handle:
    def __init__(self):
        self.calls, self.timers = [], []

    def getListState(self, name, schema):  # noqa: N802
        return _Kept(self.calls)

    getValueState = getListState  # noqa: N815

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.remove(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.append(t)


class _Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_timed_alerts_ask_the_state_a_few_times_a_batch():
    handle, second = _Handle(), 1_000_000
    p = E._Held(5 * second, 0, 10**12)
    p.init(handle)
    samples = [{"at": i * second, "bad": i % 10 > 0} for i in range(1, 1001)]
    assert list(p.handleInputRows(("r",), iter(samples), _Mark(0))) == [] and len(handle.calls) < 10
    got = [(r.event, r.at // second) for r in p.handleExpiredTimer(("r",), _Mark(1_000_000), None)]
    assert len(handle.calls) < 20
    assert got == sorted([("fired", k + 6) for k in range(0, 1000, 10)] + [("resolved", k) for k in range(10, 1001, 10)], key=lambda x: x[1])

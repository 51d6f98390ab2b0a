"""Operation statistics, thresholds and alerts over event tables. (I, batch)

Events have ts, operation, duration_ms, success and value.
"""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.operators.ranks import at_rank, between, met, ranked
from tidemark.session import kept


def as_operations(events: DataFrame) -> DataFrame:
    """An event log read as calls: the type is the operation, the value its duration, errors fail."""
    return events.select("event_id", "ts", F.col("event_type").alias("operation"), F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("success"), "value", "user_id", "props")


def ranks_of(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each distinct value of each key with ``upto``, how many rows are at or below it, and ``of``, how many there are."""
    return ranked(rows, value, (key,)).drop("c")


def operation_stats(ops: DataFrame, key: str = "operation") -> DataFrame:
    """Counts, rate, mean, median, least, largest, and nearest-rank p95 and p99.

    Rank int(p * n), n - 1 at most, from 0. Ranks are counted, so an operation
    with all the calls is many tasks.
    """
    stats = ops.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if("success").alias("n_success"), F.avg("duration_ms").alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms")
    )
    at = lambda p: at_rank("duration_ms", F.least(F.floor(F.col("of") * p), F.col("of") - 1))
    places = ranked(ops, "duration_ms", (key,)).groupBy(key).agg(between("duration_ms", 0.5).alias("median_ms"), at(0.95).alias("p95_ms"), at(0.99).alias("p99_ms"))
    out = met(stats, places, (key,), "left").withColumns({"n_error": F.col("n") - F.col("n_success"), "success_rate": F.col("n_success") / F.col("n")})
    return out.select(key, "n", "n_success", "avg_ms", "median_ms", "min_ms", "max_ms", "p95_ms", "p99_ms", "n_error", "success_rate")


def counter_key(name: str | Column, tags: str | Column) -> Column:
    """name[k=v,...] with sorted tags; the bare name without."""
    parts = F.array_sort(F.transform(F.map_entries(C.column(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.when(F.size(parts) > 0, F.concat(C.column(name), F.lit("["), F.array_join(parts, ","), F.lit("]"))).otherwise(C.column(name))


def counters(rows: DataFrame, key: Column, value: str) -> DataFrame:
    """(I2)"""
    return rows.groupBy(key.alias("counter")).agg(F.sum(value).alias("total"))


def gauges(rows: DataFrame, key: Column, value: str, ts: str = "ts") -> DataFrame:
    """Last value of each."""
    return rows.groupBy(key.alias("gauge")).agg(F.max_by(value, ts).alias("last_value"))


def trailing(rows: DataFrame, value: str, as_of: datetime | str, minutes: int = 60) -> DataFrame:
    """Mean, largest and least in the time before a moment."""
    since = C.moment(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return rows.where((F.col("ts") >= since) & (F.col("ts") <= C.moment(as_of))).agg(F.count("*").alias("n"), F.avg(value).alias("avg_value"), F.max(value).alias("max_value"), F.min(value).alias("min_value"))


def violated(value: Column, comparison: Column, threshold: Column) -> Column:
    """(I5)"""
    return F.when(comparison == "greater_than", value > threshold).when(comparison == "less_than", value < threshold).when(comparison == "equals", F.abs(value - threshold) < 0.001).otherwise(False)


def over_thresholds(samples: DataFrame, thresholds: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Samples above their metric's threshold; critical from 1.2 times it. (I4)

    thresholds: metric, threshold; Spark broadcasts it when it is small.
    """
    out = samples.join(thresholds.withColumnRenamed("metric", "_metric"), F.col(metric) == F.col("_metric")).where(F.col(value) > F.col("threshold")).drop("_metric")
    return out.withColumn("severity", F.when(F.col(value) < F.col("threshold") * 1.2, "warning").otherwise("critical"))


def _bucketed(samples: DataFrame, key: tuple[str, ...], unit: str) -> tuple[DataFrame, DataFrame]:
    """Samples with their bucket of time, and each bucket's first and last good one, with the last good one before and the first one after it.

    Only these summaries, a row a bucket, are put in order per key.
    """
    rows = samples.where("ts is not null").select(*key, "ts", "bad", F.date_trunc(unit, "ts").alias("_b"))
    good = F.when(~F.col("bad"), F.col("ts"))
    buckets = rows.groupBy(*key, "_b").agg(F.min(good).alias("_first"), F.max(good).alias("_last"))
    w = Window.partitionBy(*key).orderBy("_b")
    before, after = F.max("_last").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.min("_first").over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows, buckets.select(*key, "_b", before.alias("_before"), after.alias("_after"))


def sustained(samples: DataFrame, minutes: float, *key: str, unit: str = "hour") -> DataFrame:
    """Runs of violations (column ``bad``) that last, per key: start, end, rows, and when the alert fires.

    samples: ts, bad and the key. A run ends at the next good sample; a violation
    at the time of a good one belongs to the run after it. The alert fires at the
    first violation ``minutes`` after the run's first. Samples are put in order
    within buckets of time (``unit``) only, what crosses buckets is known from
    their summaries, so a key with most samples is as many tasks as it has buckets.
    """
    rows, buckets = _bucketed(samples, key, unit)
    good = F.max(F.when(~F.col("bad"), F.col("ts"))).over(Window.partitionBy(*key, "_b").orderBy("ts"))
    parts = rows.withColumn("_good", good).where("bad").groupBy(*key, "_b", "_good").agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"), F.count("*").alias("_n"))
    # a run is named by the good sample before it; where its bucket has none, by the last one of the buckets before
    parts = met(parts, buckets, (*key, "_b"), "left").select(*key, "_b", "_from", "_to", "_n", F.coalesce("_good", "_before").alias("_run"))
    pause = F.make_dt_interval(secs=F.lit(float(math.ceil(minutes * 60))))
    runs = parts.groupBy(*key, "_run").agg(F.min("_from").alias("start"), F.max("_to").alias("end"), F.sum("_n").alias("n")).withColumn("_due", F.col("start") + pause)
    runs = runs.where((F.col("end") >= F.col("_due")) & (F.col("end") > F.col("start")))
    # the first part of the run that reaches the time when it is due has the sample at which it fires
    reaches = (F.col("_to") >= F.col("_due")) & (F.col("_to") > F.col("start"))
    x = met(runs, parts, (*key, "_run")).where(reaches).groupBy(*key, "_run", "start", "end", "n", "_due").agg(F.min(F.struct("_b", "_from", "_to")).alias("x")).select(*key, "start", "end", "n", "_due", "x.*")
    whole = (F.col("_from") >= F.col("_due")) & (F.col("_from") > F.col("start"))
    at = (F.col("ts") >= F.col("_due")) & (F.col("ts") > F.col("start")) & (F.col("ts") <= F.col("_to"))
    inner = met(x.where(~whole), rows.where("bad"), (*key, "_b"), also=at).groupBy(*key, "start", "end", "n").agg(F.min("ts").alias("fired"))
    return x.where(whole).select(*key, "start", "end", "n", F.col("_from").alias("fired")).unionByName(inner)


def with_resolution(samples: DataFrame, alerts: DataFrame, *key: str, unit: str = "hour") -> DataFrame:
    """When each alert's rule recovered: the first good sample after it fired; null while it lasts.

    It is looked for in the bucket of time in which the alert fired, and else it
    is the first one of the buckets after, which their summaries tell.
    """
    rows, buckets = _bucketed(samples, key, unit)
    a = alerts.withColumn("_b", F.date_trunc(unit, "fired"))
    fired = a.select(*key, "_b", "fired").distinct()
    later = rows.where(~F.col("bad")).drop("bad")
    here = met(fired, later, (*key, "_b"), also=F.col("ts") > F.col("fired")).groupBy(*key, "fired").agg(F.min("ts").alias("_here"))
    out = met(met(a, here, (*key, "fired"), "left"), buckets, (*key, "_b"), "left")
    return out.select(*alerts.columns, F.coalesce("_here", "_after").alias("resolved"))


def held(samples: DataFrame, minutes: float, *key: str, until: Column | None = None, unit: str = "hour") -> DataFrame:
    """Alerts of violations that last, whether or not a sample comes when they are due: key, start, fired, resolved.

    Fired ``minutes`` after a run's first violation, unless a good sample came by
    then; only up to ``until`` where that is given, as what comes after isn't known.
    """
    rows, buckets = _bucketed(samples, key, unit)
    good = F.max(F.when(~F.col("bad"), F.col("ts"))).over(Window.partitionBy(*key, "_b").orderBy("ts"))
    parts = rows.withColumn("_good", good).where("bad").groupBy(*key, "_b", "_good").agg(F.min("ts").alias("_from"))
    runs = met(parts, buckets, (*key, "_b"), "left").groupBy(*key, F.coalesce("_good", "_before").alias("_run")).agg(F.min("_from").alias("start"))
    ends = with_resolution(samples, runs.select(*key, F.col("start").alias("fired")), *key, unit=unit)
    due = F.col("start") + F.make_dt_interval(secs=F.lit(float(minutes * 60)))
    out = ends.select(*key, F.col("fired").alias("start"), "resolved").withColumn("fired", due).where("resolved is null or resolved > fired")
    return (out if until is None else out.where(F.col("fired") <= until)).select(*key, "start", "fired", "resolved")


def performance_violations(stats: DataFrame, max_ms: float, max_error_rate: float = 0.1, least: int = 10) -> DataFrame:
    """Operations with enough calls that are slow on average or fail too often."""
    return stats.where((F.col("n") >= least) & ((F.col("avg_ms") > max_ms) | (1 - F.col("success_rate") > max_error_rate)))


def _successors(times: DataFrame, seconds: int, key: tuple[str, ...], ts: str) -> DataFrame:
    """The first alert at least so many seconds after each (column ``_to``), of those that have one.

    Times are cut into buckets of that length. Where an alert may be followed is a
    moment in the bucket after its own: both are put in order within buckets, and
    a bucket with nothing later looks to the first alert of those after it.
    """
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    bucket = lambda c: F.floor(F.timestamp_diff("SECOND", epoch, c) / seconds)
    due = F.col(ts) + F.make_dt_interval(secs=F.lit(float(seconds)))
    none = F.lit(None).cast("timestamp_ntz")
    both = times.select(*key, bucket(F.col(ts)).alias("_b"), F.col(ts).alias("_at"), F.col(ts).alias("_alert"), none.alias("_of")).unionByName(times.select(*key, bucket(due).alias("_b"), due.alias("_at"), none.alias("_alert"), F.col(ts).alias("_of")))
    here = F.min("_alert").over(Window.partitionBy(*key, "_b").orderBy("_at").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    firsts = both.groupBy(*key, "_b").agg(F.min("_alert").alias("_first"))
    after = firsts.select(*key, "_b", F.min("_first").over(Window.partitionBy(*key).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    asked = both.withColumn("_here", here).where("_of is not null")
    out = met(asked, after, (*key, "_b"), "left")
    return out.select(*key, F.col("_of").alias(ts), F.coalesce("_here", "_after").alias("_to")).where("_to is not null")


def cooled(alerts: DataFrame, minutes: float, *key: str, ts: str = "fired") -> DataFrame:
    """Alerts without those that come too soon after one that was sent: key and time of those that are. (I8)

    Whether one is sent depends on the last that was. Each alert points to the
    first that could follow it; pointers are joined to pointers, so that each round
    doubles their reach, and what is reached from a key's first alert is sent. The
    rounds are the logarithm of the most alerts that a key sends, and no task needs
    a key's alerts together. Alerts without time are never sent; without a pause all
    others are.
    """
    times = alerts.select(*key, F.col(ts).cast("timestamp_ntz").alias(ts)).where(F.col(ts).isNotNull())
    seconds = math.ceil(minutes * 60)
    if seconds <= 0:
        return times
    times = kept(times.distinct())
    jump = kept(_successors(times, seconds, key, ts))
    sent = times.groupBy(*key).agg(F.min(ts).alias(ts))
    while not jump.isEmpty():
        sent = kept(sent.unionByName(met(sent, jump, (*key, ts)).select(*key, F.col("_to").alias(ts))))
        far = jump.select(*key, F.col(ts).alias("_mid"), F.col("_to").alias("_far"))
        jump = kept(met(jump.withColumnRenamed("_to", "_mid"), far, (*key, "_mid")).select(*key, ts, F.col("_far").alias("_to")))
    return sent


def unsuppressed(alerts: DataFrame, intervals: DataFrame, ts: str = "fired", unit: str = "day") -> DataFrame:
    """Alerts outside their rule's suppression intervals (rule, from_ts, to_ts; the end is outside).

    Intervals are cut into bins of time. Bins that one covers whole are looked up,
    once however many intervals cover them; only the bins at its ends are compared.
    """
    i = intervals.where("from_ts < to_ts").select(F.col("rule").alias("_rule"), "from_ts", "to_ts")
    step = F.expr(f"interval 1 {unit}")
    stamp = alerts.schema[ts].dataType.simpleString()
    cut_ = lambda c: F.date_trunc(unit, c).cast(stamp)
    bins = i.withColumn("_bin", F.explode(F.sequence(cut_("from_ts"), cut_("to_ts"), step)))
    whole = (F.col("from_ts") <= F.col("_bin")) & (F.col("to_ts") >= F.col("_bin") + step)
    a = alerts.withColumn("_at", cut_(ts))
    here = (F.col("rule") == F.col("_rule")) & (F.col("_at") == F.col("_bin"))
    out = a.join(bins.where(whole).select("_rule", "_bin").distinct(), here, "left_anti")
    return out.join(bins.where(~whole), here & (F.col(ts) >= F.col("from_ts")) & (F.col(ts) < F.col("to_ts")), "left_anti").drop("_at")


def active_by_severity(alerts: DataFrame) -> DataFrame:
    """(I11)"""
    return alerts.where("resolved is null").groupBy("severity").agg(F.count("*").alias("n"))


def alert_history(alerts: DataFrame, k: int = 100) -> DataFrame:
    """The latest."""
    return alerts.orderBy(F.desc("fired"), "rule").limit(k)


def performance_alerts(stats: DataFrame, rules: DataFrame, operation: str = "operation", least: int = 10) -> DataFrame:
    """Performance rules (metric_name, max_duration_ms, max_error_rate) that operations with enough calls break, each rule for its own operation."""
    r = rules.where("enabled and kind = 'performance'")
    both = stats.join(r, stats[operation] == r["metric_name"]).where(F.col("n") >= least)
    return both.where((F.col("avg_ms") > F.col("max_duration_ms")) | (1 - F.col("success_rate") > F.col("max_error_rate"))).select("name", operation, r["severity"])


def threshold_alerts(samples: DataFrame, rules: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Samples that violate the threshold rules of their own metric."""
    r = rules.where("enabled and kind = 'threshold'").select("name", "metric_name", "comparison", "threshold", "severity")
    return samples.join(r, samples[metric] == r["metric_name"]).where(violated(F.col(value), F.col("comparison"), F.col("threshold"))).drop("metric_name")


def preset_rules(spark: SparkSession) -> DataFrame:
    """(I12)"""
    threshold = lambda name, metric, value, minutes, severity: (name, "threshold", metric, "greater_than", value, minutes, 15, severity, True, None, None)
    # fixed values
    rows = [
        threshold("high_cpu_usage", "cpu_percent", 80.0, 2, "warning"), threshold("high_memory_usage", "memory_percent", 85.0, 2, "warning"), threshold("high_disk_usage", "disk_usage_percent", 90.0, 1, "critical"),
        ("slow_ticket_search", "performance", "ticket_search", None, None, None, 15, "warning", True, 10000.0, 0.05), ("slow_data_analysis", "performance", "data_analysis", None, None, None, 15, "warning", True, 30000.0, 0.05),
        ("high_error_rate_authentication", "performance", "authentication", None, None, None, 15, "critical", True, float("inf"), 0.05),
    ]
    return spark.createDataFrame(rows, "name string, kind string, metric_name string, comparison string, threshold double, duration_minutes int, cooldown_minutes int, severity string, enabled boolean, max_duration_ms double, max_error_rate double")


def call_stats(ops: DataFrame, service: str = "operation") -> DataFrame:
    """(I13)"""
    return ops.groupBy(service).agg(F.count("*").alias("total_calls"), F.avg("duration_ms").alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"), (100.0 * F.count_if("success") / F.count("*")).alias("success_rate"))


def health(checks: DataFrame) -> DataFrame:
    """checks: name, ok. The overall status and what failed."""
    return checks.agg(F.when(F.bool_and("ok"), "healthy").otherwise("unhealthy").alias("status"), F.sort_array(F.collect_set(F.when(~F.col("ok"), F.col("name")))).alias("failed"))


def metric_summary(rows: DataFrame, key: str, value: str, ts: str = "ts") -> DataFrame:
    """(I15)"""
    return rows.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("avg_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.max_by(value, ts).alias("latest"))


def throughput(runs: DataFrame) -> DataFrame:
    """runs: n_rows, seconds. (I16)"""
    r = F.try_divide(F.col("n_rows"), F.col("seconds"))
    return runs.agg(F.count("*").alias("runs"), F.sum("n_rows").alias("total_rows"), F.avg("seconds").alias("avg_seconds"), F.avg(r).alias("avg_rows_per_s"), F.max(r).alias("max_rows_per_s"))


def audit_counts(log: DataFrame, line: str = "line") -> DataFrame:
    """Entries like ``action=login user=ann`` counted by both."""
    of = lambda name: F.regexp_extract(line, rf"\b{name}=([^\s,]+)", 1)
    return log.select(of("action").alias("action"), of("user").alias("user")).where("action <> ''").groupBy("action", "user").agg(F.count("*").alias("n"))

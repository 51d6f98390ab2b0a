"""Resolution time, status, severity, volume and team metrics. (E, F)

``H`` is the resolution time in hours. E uses rows with H > 0, F5, F10 and F11
those with H other than 0. Functions that tell several groups apart aggregate
once; bounds and totals that come from one row are joined as one row.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.operators import ranks
from tidemark.operators.cube import cubed, done, ends, is_cube, tally, weight

PERCENTILES = (50, 75, 90, 95, 99)


def with_hours(t: DataFrame) -> DataFrame:
    return t if is_cube(t) else t.withColumn("h", C.resolution_hours())


def analysis_frame(t: DataFrame, as_of: datetime | str) -> DataFrame:
    """The wide projection that metrics read. (C11)"""
    kept = ("id", "title", "status", "severity", "created_date", "updated_date", "resolved_date", "assignee", "resolver_group")
    return t.select(*kept, C.is_resolved().alias("is_resolved"), C.age_hours(as_of).alias("age_hours"), C.resolution_hours().alias("resolution_time_hours"))


def time_series(t: DataFrame, as_of: datetime | str) -> DataFrame:
    """The projection that trends read: rows with a creation time, unsorted."""
    return t.where("created_date is not null").select(
        C.day("created_date").alias("date"), F.col("created_date").alias("datetime"), F.col("id").alias("ticket_id"), "status", "severity", C.is_resolved().alias("is_resolved"),
        C.resolution_hours().alias("resolution_hours"), C.age_hours(as_of).alias("age_hours"), C.or_unassigned("assignee").alias("assignee"), C.or_unassigned("resolver_group").alias("resolver_group"),
    )


def positive(t: DataFrame) -> DataFrame:
    return with_hours(t).where("h > 0")


def quantile(h: str | Column, at: Column, accuracy: int) -> Column:
    """Quantiles from a sketch of bounded size."""
    return F.percentile_approx(h, at, accuracy)


def _five(rows: DataFrame, keys: tuple[str, ...], accuracy: int | None = None, sd: bool = False) -> DataFrame:
    """Mean, median, count, least and largest of each group: exact, by counting ranks, or with an accuracy from a sketch."""
    if accuracy is None:
        out = ranks.described(rows, "h", keys, {"median_hours": 0.5})
    else:
        out = rows.groupBy(*keys).agg(F.avg("h").alias("avg_hours"), quantile("h", F.lit(0.5), accuracy).alias("median_hours"), F.count("*").alias("n"), F.min("h").alias("min_hours"), F.max("h").alias("max_hours"), C.sd("h").alias("sd_hours"))
    return out.select(*keys, "avg_hours", "median_hours", "n", "min_hours", "max_hours", *["sd_hours"] * sd)


def _quantiles(rows: DataFrame, ps: dict[str, float], accuracy: int | None = None) -> DataFrame:
    """One row with n and the quantiles."""
    if accuracy is None:
        return ranks.described(rows, "h", (), ps).select("n", *ps)
    return rows.agg(F.count("h").alias("n"), *[quantile("h", F.lit(p), accuracy).alias(k) for k, p in ps.items()])


@cubed
def resolution_stats(t: DataFrame, accuracy: int | None = None) -> DataFrame:
    """(E1)"""
    return _five(positive(t), (), accuracy, sd=True)


@cubed
def resolution_percentiles(t: DataFrame, accuracy: int | None = None) -> DataFrame:
    """(E2)"""
    return _quantiles(positive(t), {f"p{p}": p / 100 for p in PERCENTILES}, accuracy).drop("n")


def resolution_by(t: DataFrame, key: Column, name: str, accuracy: int | None = None) -> DataFrame:
    rows = positive(t)
    return _five(rows.select(key.alias(name), "h", *weight(rows)), (name,), accuracy)


@cubed
def resolution_by_severity(t: DataFrame, accuracy: int | None = None) -> DataFrame:
    """(E3)"""
    return resolution_by(t, F.col("severity"), "severity", accuracy)


@cubed
def resolution_by_assignee(t: DataFrame, accuracy: int | None = None) -> DataFrame:
    """(E4)"""
    return resolution_by(t, C.or_unassigned("assignee"), "assignee", accuracy)


def resolution_by_day_name(t: DataFrame) -> DataFrame:
    """By the day of resolution. (E5)"""
    return positive(t).groupBy(C.day_name("resolved_date").alias("day_name")).agg(F.avg("h").alias("avg_hours"))


def resolution_by_hour(t: DataFrame) -> DataFrame:
    """By the hour of resolution."""
    return positive(t).groupBy(F.hour("resolved_date").alias("hour")).agg(F.avg("h").alias("avg_hours"))


def _bounds(rows: DataFrame, accuracy: int | None = None) -> DataFrame:
    q = _quantiles(rows, {"q1": 0.25, "q3": 0.75}, accuracy)
    iqr = F.col("q3") - F.col("q1")
    return q.where("n >= 4").select((F.col("q1") - 1.5 * iqr).alias("lower"), (F.col("q3") + 1.5 * iqr).alias("upper"), "n")


def outliers(t: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Rows beyond 1.5 interquartile ranges, with how far; none under four rows."""
    rows = positive(t).select("id", "h")
    b = rows.crossJoin(F.broadcast(_bounds(rows, accuracy)))  # one row
    b = b.where("h < lower or h > upper").withColumn("kind", F.when(F.col("h") < F.col("lower"), "fast").otherwise("slow"))
    return b.select("id", F.col("h").alias("hours"), "kind", F.greatest(F.col("lower") - F.col("h"), F.col("h") - F.col("upper")).alias("distance"))


@cubed
def outlier_summary(t: DataFrame, accuracy: int | None = None) -> DataFrame:
    """(E7)"""
    rows = positive(t)
    rows = rows.select("h", *weight(rows))
    out = (F.col("h") < F.col("lower")) | (F.col("h") > F.col("upper"))
    return rows.crossJoin(F.broadcast(_bounds(rows, accuracy))).groupBy("lower", "upper", "n").agg(tally(rows, out).alias("n_outliers")).withColumn("percentage", C.percent(F.col("n_outliers"), F.col("n")))


def outlier_list(t: DataFrame, k: int = 10) -> DataFrame:
    """The k farthest out."""
    return outliers(t).orderBy(F.desc("distance"), "id").limit(k)


@cubed
def resolution_rate(t: DataFrame) -> DataFrame:
    """(E8)"""
    return t.agg(tally(t).alias("total"), tally(t, done(t)).alias("resolved")).withColumn("rate", C.percent(F.col("resolved"), F.col("total")))


@cubed
def resolution_overview(t: DataFrame, accuracy: int | None = None) -> DataFrame:
    """E1, E2 and E8 in one row; nulls where nothing is resolved."""
    rows = positive(t)
    five = _five(rows, (), accuracy, sd=True) if accuracy is not None else None
    ps = {f"p{p}": p / 100 for p in PERCENTILES}
    hours = ranks.described(rows, "h", (), ps) if five is None else five.crossJoin(F.broadcast(_quantiles(rows, ps, accuracy).drop("n")))  # one row each
    return resolution_rate(t).crossJoin(F.broadcast(hours)).select("total", "resolved", "rate", "n", "avg_hours", F.when(F.col("n") > 0, F.coalesce("sd_hours", F.lit(0.0))).alias("sd_hours"), "min_hours", "max_hours", *ps)


@cubed
def distribution(t: DataFrame, key: str) -> DataFrame:
    """Counts and shares of a column's values, how many there are, and which is most common."""
    n = t.groupBy(key).agg(tally(t).alias("n"))
    every = Window.partitionBy()  # over one row a value
    return n.withColumns({"percentage": 100.0 * F.col("n") / F.sum("n").over(every), "n_values": F.count("*").over(every), "most_common": F.row_number().over(Window.orderBy(F.desc("n"), key)) == 1})


@cubed
def by_month(t: DataFrame, key: str) -> DataFrame:
    """(F2, F4)"""
    return t.groupBy(C.month_label("created_date").alias("month"), key).agg(tally(t).alias("n"))


@cubed
def hours_by_severity(t: DataFrame, accuracy: int | None = None) -> DataFrame:
    """All H but 0, negative ones too."""
    return _five(with_hours(t).where("h <> 0"), ("severity",), accuracy)


@cubed
def volume_summary(t: DataFrame) -> DataFrame:
    """(F6)"""
    first, last = ends(t)
    row = t.where("created_date is not null").agg(tally(t).alias("total"), first.alias("a"), last.alias("z"))
    days = F.greatest(F.lit(1), F.floor(C.hours_between("a", "z") / 24))
    over = lambda d: F.col("total") / F.greatest(F.lit(1.0), F.col("span_days") / d)
    return row.withColumn("span_days", days).select("total", "span_days", (F.col("total") / F.col("span_days")).alias("daily_average"), over(7.0).alias("weekly_average"), over(30.0).alias("monthly_average"))


@cubed
def volume(t: DataFrame) -> DataFrame:
    """Counts by day, week, month, hour and day name: one scan with grouping sets."""
    c = "created_date"
    cols = {"day": C.day(c).cast("string"), "week": C.week_label(c), "month": C.month_label(c), "hour": F.hour(c).cast("string"), "day_name": C.day_name(c)}
    # hourly counts come first: the five ways are sums of those
    base = t.where(F.col(c).isNotNull()).groupBy(F.date_trunc("hour", c).alias(c)).agg(tally(t).alias("n"))
    named = base.select("n", *[e.alias(k) for k, e in cols.items()])
    sets = named.groupingSets([[k] for k in cols], *cols).agg(F.sum("n").alias("n"))
    return sets.select(F.coalesce(*[F.when(F.col(k).isNotNull(), k) for k in cols]).alias("grain"), F.coalesce(*cols).alias("key"), "n")


@cubed
def daily(t: DataFrame) -> DataFrame:
    """day, n: the series that peaks, trends and anomalies derive from."""
    return t.where("created_date is not null").groupBy(C.day("created_date").alias("day")).agg(tally(t).alias("n"))


@cubed
def peaks(t: DataFrame, k: int = 10) -> DataFrame:
    """Days above the mean by more than a standard deviation, the highest k, and how many there are. (F8)"""
    d = daily(t)
    bound = d.agg((F.avg("n") + C.sd("n")).alias("bound"))
    above = d.crossJoin(F.broadcast(bound)).where("n > bound")
    return above.withColumn("n_peaks", F.count("*").over(Window.partitionBy())).orderBy(F.desc("n"), "day").limit(k).select("day", "n", "n_peaks")


@cubed
def monthly_growth(t: DataFrame) -> DataFrame:
    """Change to the month before, the mean change, and a label; none under two months."""
    m = t.where("created_date is not null").groupBy(C.month_label("created_date").alias("month")).agg(tally(t).alias("n"))
    before = F.lag("n").over(Window.orderBy("month"))
    g = m.withColumn("before", before).where("before > 0").withColumn("growth", (F.col("n") - F.col("before")) * 100.0 / F.col("before"))
    mean = F.avg("growth").over(Window.partitionBy())
    return g.withColumn("avg_growth", mean).withColumn("trend", F.when(F.col("avg_growth") > 0, "increasing").when(F.col("avg_growth") < 0, "decreasing").otherwise("stable"))


@cubed
def team(t: DataFrame, key: str, accuracy: int | None = None) -> DataFrame:
    """Totals, rate and hours of each assignee or group."""
    rows = with_hours(t).select(C.or_unassigned(key).alias(key), done(t).alias("done"), "h", *weight(t))
    n = rows.groupBy(key).agg(tally(t).alias("total"), tally(t, F.col("done")).alias("resolved"))
    hours = _five(rows.where("h <> 0"), (key,), accuracy).select(key, "avg_hours", "median_hours")
    return ranks.met(n, hours, (key,), "left").select(key, "total", "resolved", "avg_hours", "median_hours", C.percent(F.col("resolved"), F.col("total")).alias("rate"))


@cubed
def workload(t: DataFrame, key: str) -> DataFrame:
    """(F12)"""
    return t.groupBy(C.or_unassigned(key).alias(key)).agg(tally(t).alias("n"))


@cubed
def workload_stats(t: DataFrame, key: str) -> DataFrame:
    """(F13)"""
    return workload(t, key).agg(F.count("*").alias("n_groups"), F.avg("n").alias("avg_n"), F.max("n").alias("max_n"), F.min("n").alias("min_n"))


def date_range(t: DataFrame) -> DataFrame:
    """(F14)"""
    return t.agg(F.min("created_date").alias("first_created"), F.max("created_date").alias("last_created"))


def metadata(t: DataFrame, calculator: str) -> DataFrame:
    """(F15)"""
    return t.agg(F.lit(calculator).alias("calculator"), F.count("*").alias("sample_size"), F.min("created_date").alias("first_created"), F.max("created_date").alias("last_created"))


def to_long(df: DataFrame, metric: str, *keys: str) -> DataFrame:
    """metric, key, value: each value column of each row as text, keyed by the key columns."""
    values = [c for c in df.columns if c not in keys]
    name = F.concat_ws(".", F.lit(metric), *[F.col(k).cast("string") for k in keys])
    return df.select(name.alias("metric"), F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in values])).alias("x")).select("metric", "x.key", "x.value")


def add(long: DataFrame, *more: DataFrame) -> DataFrame:
    """(A18)"""
    return reduce(DataFrame.unionByName, more, long)


def metric_value(long: DataFrame, metric: str, key: str | None = None, default: str | None = None) -> DataFrame:
    """One row with the value of a metric, or the default."""
    rows = long.where((F.col("metric") == metric) & (F.lit(True) if key is None else F.col("key") == key))
    return rows.agg(F.coalesce(F.min("value"), F.lit(default)).alias("value"))

"""Trends and patterns over aggregated series. (G)

A series has one row a day, week or month; the windows without partition run
over such series only, never over tickets. Days without tickets are no rows
unless ``fill_gaps`` asks for them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.operators import metrics as M
from tidemark.operators.cube import cubed, done, mean, tally


def direction(slope: Column, points: Column) -> Column:
    return F.when(points < 2, "insufficient_data").when(slope > 0.1, "increasing").when(slope < -0.1, "decreasing").otherwise("stable")


def correlation(x: str, y: str) -> Column:
    """Pearson's, over rows where both are there; null where a side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)).cast("double"), F.when(both, F.col(y)).cast("double")
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def series(t: DataFrame, grain: str, date: str = "created_date") -> DataFrame:
    """period, n of a grain: day, week (Monday to Sunday) or month. (G1)"""
    label = {"day": C.day(date).cast("string"), "week": C.week_period(date), "month": C.month_label(date)}[grain]
    return t.where(F.col(date).isNotNull()).groupBy(label.alias("period")).agg(tally(t).alias("n"))


@cubed
def volume_trend(t: DataFrame) -> DataFrame:
    """Average volume by grain, and the days spanned. (G1)"""
    # one scan: days, and from these weeks, months and the span
    days = M.daily(t).select(C.day("day").cast("timestamp").alias("at"), "n")
    grains = F.array(*[F.struct(F.lit(g).alias("grain"), label.alias("period")) for g, label in (("day", F.to_date("at").cast("string")), ("week", C.week_period("at")), ("month", C.month_label("at")))])
    each = days.select("at", "n", F.explode(grains).alias("x")).groupBy("x.grain", "x.period").agg(F.sum("n").alias("n"), F.min("at").alias("a"), F.max("at").alias("z"))
    of = lambda g: F.struct(F.lit(g).alias("grain"), F.count_if(F.col("grain") == g).alias("periods"), F.avg(F.when(F.col("grain") == g, F.col("n"))).alias("avg_n"))
    row = each.agg(F.array(of("day"), of("week"), of("month")).alias("x"), (F.datediff(F.max("z"), F.min("a")) + 1).alias("span_days"))
    return row.select(F.explode("x").alias("x"), "span_days").select("x.*", "span_days")


def fill_gaps(d: DataFrame) -> DataFrame:
    """A row for each day between the first and the last."""
    days = d.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return days.join(d, "day", "left").fillna(0, ["n"])


def trend(s: DataFrame, period: str, value: str) -> DataFrame:
    """Least-squares slope over the rows' order, and the direction it means."""
    x = s.where(F.col(value).isNotNull()).withColumn("x", F.row_number().over(Window.orderBy(period)) - 1)
    row = x.agg(F.count("*").alias("points"), F.regr_slope(F.col(value), F.col("x")).alias("slope"))
    return row.withColumn("direction", direction(F.coalesce("slope", F.lit(0.0)), F.col("points")))


def volatility(s: DataFrame, value: str = "n") -> DataFrame:
    """(G3)"""
    return s.agg(F.coalesce(F.try_divide(F.stddev_samp(value), F.avg(value)), F.lit(0.0)).alias("volatility"))


def extremes(d: DataFrame, k: int = 5) -> DataFrame:
    """Days beyond a standard deviation of the mean: the first k of each kind, and how many there are."""
    b = d.agg(F.avg("n").alias("mean"), C.sd("n").alias("sd"))
    kind = F.when(F.col("n") > F.col("mean") + F.col("sd"), "peak").when(F.col("n") < F.col("mean") - F.col("sd"), "low")
    out = d.crossJoin(F.broadcast(b)).withColumn("kind", kind).where("kind is not null")
    by = Window.partitionBy("kind")
    out = out.withColumns({"n_kind": F.count("*").over(by), "nth": F.row_number().over(by.orderBy("day"))})
    return out.where(F.col("nth") <= k).select("kind", "day", "n", "n_kind")


def resolution_series(t: DataFrame, grain: str, date: str = "created_date") -> DataFrame:
    """Mean H of resolved rows by period of a date column."""
    h = M.with_hours(t).where("h is not null")
    label = {"week": C.week_period(date), "month": C.month_label(date)}[grain]
    return h.groupBy(label.alias("period")).agg(mean(t, F.col("h")).alias("avg_hours"), tally(t).alias("n"))


@cubed
def resolution_trend(t: DataFrame) -> DataFrame:
    """Direction of the weekly means, overall mean and rate."""
    weekly = trend(resolution_series(t, "week"), "period", "avg_hours").select("points", "slope", "direction")
    every = M.with_hours(t).agg(mean(t, F.col("h")).alias("overall_hours"), C.percent(tally(t, F.col("h").isNotNull()), tally(t)).alias("rate"))
    return weekly.crossJoin(F.broadcast(every))


def pivot(t: DataFrame, key: str, values: tuple[str, ...], by: str = "month") -> DataFrame:
    """Counts by period and value, 0 where there are none."""
    label = C.month_label("created_date") if by == "month" else C.week_period("created_date")
    return t.where("created_date is not null").groupBy(label.alias(by)).pivot(key, list(values)).agg(F.count(F.lit(1))).fillna(0)


@cubed
def status_change(t: DataFrame) -> DataFrame:
    """Mean month-to-month change of each status, months without it counting 0; changes from 0 are left out."""
    n = M.by_month(t, "status")
    grid = n.select("month").distinct().crossJoin(F.broadcast(n.select("status").distinct()))  # months by statuses
    g = grid.join(n, ["month", "status"], "left").fillna(0, ["n"]).withColumn("before", F.lag("n").over(Window.partitionBy("status").orderBy("month")))
    g = g.where("before > 0").groupBy("status").agg(F.avg((F.col("n") - F.col("before")) * 100.0 / F.col("before")).alias("avg_change"))
    return g.withColumn("label", F.when(F.col("avg_change") > 0, "increasing").when(F.col("avg_change") < 0, "decreasing").otherwise("stable"))


@cubed
def seasonality(t: DataFrame) -> DataFrame:
    """Counts by day name, hour, month name and quarter, with the peak and the low of each."""
    c = "created_date"
    cols = {"day_name": C.day_name(c), "hour": F.hour(c).cast("string"), "month_name": C.month_name(c), "quarter": C.quarter_label(c)}
    hours = t.where(F.col(c).isNotNull()).groupBy(F.date_trunc("hour", c).alias(c)).agg(tally(t).alias("n"))
    s = hours.select("n", *[e.alias(k) for k, e in cols.items()]).groupingSets([[k] for k in cols], *cols).agg(F.sum("n").alias("n"))
    s = s.select(F.coalesce(*[F.when(F.col(k).isNotNull(), k) for k in cols]).alias("grain"), F.coalesce(*cols).alias("key"), "n")
    w = Window.partitionBy("grain")
    return s.withColumns({"is_peak": F.row_number().over(w.orderBy(F.desc("n"), "key")) == 1, "is_low": F.row_number().over(w.orderBy("n", "key")) == 1})


def autocorrelation(d: DataFrame, lag: int = 7, least: int = 14) -> DataFrame:
    """Correlation of daily volume with itself some rows later; 0 under the least number of days or where constant."""
    w = d.withColumn("later", F.lead("n", lag).over(Window.orderBy("day")))
    row = w.agg(F.count("*").alias("days"), correlation("n", "later").alias("r"))
    r = F.when(F.col("days") < least, 0.0).otherwise(F.coalesce("r", F.lit(0.0)))
    return row.select("days", r.alias("correlation")).withColumn("cycle", F.when(F.col("correlation") > 0.7, "high").when(F.col("correlation") > 0.5, "moderate").otherwise("none"))


@cubed
def weekly_consistency(t: DataFrame, least: int = 14) -> DataFrame:
    """How even the days of the week are, and the pattern that means; no row under the least number of tickets."""
    n = t.where("created_date is not null").groupBy(F.weekday("created_date").alias("dow")).agg(tally(t).alias("n"))
    row = n.agg(F.sum("n").alias("tickets"), F.count("*").alias("days"), F.try_divide(F.stddev_samp("n"), F.avg("n")).alias("cv")).where(F.col("tickets") >= least)
    row = row.withColumn("consistency", F.when(F.col("days") < 2, 0.0).otherwise(1 - F.least(F.col("cv") / 2, F.lit(1.0))))
    return row.select("tickets", "consistency", F.when(F.col("consistency") > 0.7, "strong").when(F.col("consistency") > 0.4, "moderate").otherwise("weak").alias("pattern"))


def anomalies(s: DataFrame, key: str, value: str, k: int | None = 10) -> DataFrame:
    """Rows more than two standard deviations from the mean, the k farthest, and how many; extreme beyond three."""
    b = s.where(F.col(value).isNotNull()).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count("*").alias("rows")).where("rows >= 3 and sd > 0")
    z = s.crossJoin(F.broadcast(b)).withColumn("z", F.abs(F.col(value) - F.col("mean")) / F.col("sd")).where("z > 2")
    z = z.withColumns({"severity": F.when(F.col("z") > 3, "extreme").otherwise("moderate")})
    total = z.agg(F.count("*").alias("n_anomalies"))
    out = z.select(key, value, "z", "severity")
    out = out if k is None else out.orderBy(F.desc("z"), key).limit(k)
    return out.crossJoin(F.broadcast(total))


def _n_far(t: DataFrame) -> DataFrame:
    """How many resolved tickets have hours more than two standard deviations from the mean, as :func:`anomalies` finds them: counted from equal hours, so that nothing is read twice."""
    same = M.with_hours(t).where("h is not null").groupBy("h").agg(tally(t).alias("c"))
    x, n = F.col("h") * F.col("c"), F.sum("c")
    row = same.agg(n.alias("rows"), (F.sum(x) / n).alias("mean"), (F.sum(x * F.col("h")) - F.sum(x) * F.sum(x) / n).alias("v"))
    row = row.select("rows", "mean", F.sqrt(F.greatest("v", F.lit(0.0)) / F.nullif(F.col("rows") - 1, F.lit(0))).alias("sd")).where("rows >= 3 and sd > 0")
    far = F.abs(F.col("h") - F.col("mean")) / F.col("sd") > 2
    return same.crossJoin(F.broadcast(row)).agg(F.coalesce(F.sum(F.when(far, F.col("c"))), F.lit(0)).alias("n"))


@cubed
def weekly_growth(t: DataFrame) -> DataFrame:
    """Week-to-week growth, its mean, and the class of it."""
    w = series(t, "week").withColumn("before", F.lag("n").over(Window.orderBy("period")))
    g = w.where("before > 0").withColumn("growth", (F.col("n") - F.col("before")) * 100.0 / F.col("before"))
    m = F.col("avg_growth")
    label = F.when(m > 5, "strong_growth").when(m > 0, "moderate_growth").when(m > -5, "stable").otherwise("declining")
    return g.withColumn("avg_growth", F.avg("growth").over(Window.partitionBy())).withColumn("class", label)


@cubed
def daily_frame(t: DataFrame) -> DataFrame:
    """Volume, mean H and resolved of each day."""
    h = M.with_hours(t).where("created_date is not null")
    return h.groupBy(C.day("created_date").alias("day")).agg(tally(t).alias("volume"), mean(t, F.col("h")).alias("avg_hours"), tally(t, done(t)).alias("resolved"))


@cubed
def volume_hours_correlation(t: DataFrame, strict: bool = False) -> DataFrame:
    """Correlation of daily volume and mean H over days that have both; strict: null if any day lacks H."""
    row = daily_frame(t).agg(F.count("*").alias("days"), F.count("avg_hours").alias("paired"), correlation("volume", "avg_hours").alias("r"))
    ok = (F.col("days") > 3) & ((F.col("days") == F.col("paired")) | F.lit(not strict))
    r, size = F.col("correlation"), F.abs("correlation")
    row = row.select("days", "paired", F.when(ok, F.col("r")).alias("correlation"))
    return row.withColumns(
        {
            "strength": F.when(size >= 0.8, "very_strong").when(size >= 0.6, "strong").when(size >= 0.4, "moderate").when(size >= 0.2, "weak").when(size.isNotNull(), "very_weak"),
            # fixed values: the sentences
            "meaning": F.when(r > 0.3, "Higher ticket volume tends to correlate with longer resolution times")
            .when(r < -0.3, "Higher ticket volume tends to correlate with shorter resolution times")
            .when(r.isNotNull(), "No significant correlation between ticket volume and resolution times"),
        }
    )


def forecast(s: DataFrame, period: str, value: str, ahead: int = 5) -> DataFrame:
    """The fitted line continued, not below 0; none under three points."""
    x = s.withColumn("x", F.row_number().over(Window.orderBy(period)) - 1)
    fit = x.agg(F.count("*").alias("points"), F.regr_slope(F.col(value), F.col("x")).alias("slope"), F.regr_intercept(F.col(value), F.col("x")).alias("intercept")).where("points >= 3")
    steps = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("step"))
    return steps.select("step", F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * (F.col("points") - 1 + F.col("step"))).alias("forecast"), "slope", "intercept")


def latest(s: DataFrame, series_col: str, ts: str, value: str) -> DataFrame:
    """Latest value, least and largest of each series."""
    return s.groupBy(series_col).agg(F.max_by(value, ts).alias("latest"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))


@cubed
def trend_summary(t: DataFrame) -> DataFrame:
    """Findings, recommendations and health, from the directions of volume and resolution."""
    v = trend(M.daily(t), "day", "n").select(F.col("direction").alias("volume"))
    r = trend(resolution_series(t, "week"), "period", "avg_hours").select(F.col("direction").alias("resolution"))
    vol, res = F.col("volume"), F.col("resolution")
    # fixed values: the sentences
    finding = [(vol == "increasing", "Ticket volume is increasing over time"), (vol == "decreasing", "Ticket volume is decreasing over time"), (res == "increasing", "Resolution times are increasing"), (res == "decreasing", "Resolution times are improving")]
    advice = [(vol == "increasing", "Monitor capacity and consider workload distribution"), (res == "increasing", "Review resolution processes for potential improvements")]
    some = lambda pairs: F.array_compact(F.array(*[F.when(c, F.lit(s)) for c, s in pairs]))
    return v.crossJoin(F.broadcast(r)).withColumns({"findings": some(finding), "recommendations": some(advice), "health": F.when((vol == "stable") | res.isin("stable", "decreasing"), "good").otherwise("needs_attention")})


@cubed
def pattern_summary(t: DataFrame) -> DataFrame:
    """Patterns and anomalies counted, and what needs attention."""
    d = M.daily(t)
    cyc = autocorrelation(d).select((F.col("cycle") != "none").cast("int").alias("pattern_count"))
    volume_anomalies = anomalies(d, "day", "n", None).agg(F.count("*").alias("a"))
    hour_anomalies = _n_far(t).select(F.col("n").alias("b"))
    week = weekly_consistency(t).agg(F.max("pattern").alias("weekly"))
    growth = weekly_growth(t).agg(F.max("class").alias("growth"))
    row = cyc
    for one in (volume_anomalies, hour_anomalies, week, growth):  # one row each
        row = row.crossJoin(F.broadcast(one))
    row = row.withColumn("anomaly_count", F.col("a") + F.col("b"))
    some = lambda pairs: F.array_compact(F.array(*[F.when(c, F.lit(s)) for c, s in pairs]))
    strong = F.col("growth") == "strong_growth"
    # fixed values: the sentences
    return row.select(
        "pattern_count", "anomaly_count",
        some([(F.col("weekly") == "strong", "Strong weekly pattern detected"), (strong, "Strong growth trend identified")]).alias("key_patterns"),
        some([(strong, "Monitor capacity for growing ticket volume"), (F.col("anomaly_count") > 5, "High number of anomalies detected - investigate unusual patterns")]).alias("attention_areas"),
    )

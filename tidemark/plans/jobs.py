"""Whole analyses, and what is done with their results."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import clean, quality, sla, trends
from tidemark.operators import metrics as M
from tidemark.operators.cube import cube, cubed
from tidemark.plans.registry import Registry, distributions, statistics
from tidemark.session import kept

METRICS = Registry(
    resolution_overview=M.resolution_overview, resolution_by_severity=M.resolution_by_severity, resolution_by_assignee=M.resolution_by_assignee, outlier_summary=M.outlier_summary,
    status_distribution=cubed(lambda t: M.distribution(t, "status")), severity_distribution=cubed(lambda t: M.distribution(t, "severity")), volume_summary=M.volume_summary, volume=M.volume, peaks=M.peaks,
    monthly_growth=M.monthly_growth, team_assignee=cubed(lambda t: M.team(t, "assignee")), team_group=cubed(lambda t: M.team(t, "resolver_group")), workload_stats=cubed(lambda t: M.workload_stats(t, "assignee")),
)
TRENDS = Registry(
    volume_trend=trends.volume_trend, resolution_trend=trends.resolution_trend, seasonality=trends.seasonality, weekly_growth=trends.weekly_growth, correlation=trends.volume_hours_correlation,
    summary=trends.trend_summary, patterns=trends.pattern_summary,
)
STATISTICS = Registry(statistics=statistics, distributions=distributions)
#: Columns that name a row of a result.
KEYS = ("severity", "assignee", "resolver_group", "status", "grain", "key", "day", "month", "period")


LONG = "metric string, key string, value string"
#: Results of an analysis that run side by side.
AT_ONCE = 4


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as texts, so that every value has a text."""
    arrays = [f.name for f in df.schema if f.dataType.simpleString().startswith("array")]
    return df.withColumns({c: F.array_join(c, "; ") for c in arrays}) if arrays else df


def long_form(name: str, df: DataFrame) -> DataFrame:
    return M.to_long(_flat(df), name, *[k for k in KEYS if k in df.columns])


def analyze(t: DataFrame, as_of: datetime | str, metrics: Registry | None = METRICS, trend: Registry | None = TRENDS) -> DataFrame:
    """All metrics, trends and quality of the lightly valid rows, in the long form.

    The rows are scanned twice, for a cube that is kept in the shared folder and
    for their quality; all else follows from the cube, some results at a time.
    Operators of one's own that don't take cubes scan the rows themselves. Each
    result is kept in the shared folder, whatever its size; the driver sees none
    of them. A result that can't be planned or run gives a row with key ``error``;
    the others stand.
    """
    rows = clean.lightly_valid(t).select("id", "status", "severity", "created_date", "updated_date", "resolved_date", "title", "assignee", "resolver_group")
    spark = t.sparkSession
    cells = kept(cube(rows))

    def one(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        try:
            return kept(long_form(name, make()))
        except PySparkException as e:
            return spark.createDataFrame([(name, "error", str(e).splitlines()[0])], LONG)

    wanted = [(f"{kind}.{n}", lambda r=r, n=n: r.calculate(n, cells if r.takes_cube(n) else rows)) for kind, r in (("metric", metrics), ("trend", trend)) if r for n in r.names()]
    wanted += [("quality", lambda: quality.assess(rows, as_of)), ("insights", lambda: quality.insights(cells))]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return reduce(DataFrame.unionByName, pool.map(lambda x: one(*x), wanted))


def combine(*reports: DataFrame) -> DataFrame:
    """(J8)"""
    return reduce(DataFrame.unionByName, reports)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both values of each metric and, where both are numbers, their difference."""
    x, y = a.withColumnRenamed("value", "a"), b.withColumnRenamed("value", "b")
    return x.join(y, ["metric", "key"], "full").withColumn("difference", F.col("b").try_cast("double") - F.col("a").try_cast("double"))


def aggregate(*reports: DataFrame) -> DataFrame:
    """Sums of the metrics that are numbers."""
    return combine(*reports).groupBy("metric", "key").agg(F.sum(F.col("value").try_cast("double")).alias("value"), F.count("*").alias("n_reports"))


def convert(df: DataFrame, path: str, fmt: str) -> None:
    """The long form in another format: parquet, json, csv or orc."""
    if fmt not in ("parquet", "json", "csv", "orc"):
        raise ValueError(f"no such format: {fmt}")
    w = df.write.mode("overwrite")
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)


def period_and_grid(t: DataFrame, as_of: datetime | str) -> DataFrame:
    """Teams over 7, 30 and 90 days."""
    return sla.grid(t, {"7d": 7, "30d": 30, "90d": 90}, as_of)

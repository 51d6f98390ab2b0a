"""Registered queries that write, read back or run whole analyses, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import _SHOW, AS_OF, ORACLES, QUERIES, VIEW, _q, rounded
from tidemark.operators import metrics as M
from tidemark.operators import ranks, sketches, validation
from tidemark.operators.criteria import Criteria, named_range, search
from tidemark.plans import jobs, registry
from tidemark.session import shared_folder
from tidemark.sources import tickets as S


def add(name: str, run: Callable[[DataFrame, str], DataFrame], sql: str, source: str = "tickets") -> None:
    """Registers a query over a table and a new shared folder."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = S.order_tickets(spark, sf_dir) if source == "tickets" else spark.read.parquet(f"{sf_dir}/{source}.parquet")
        return rounded(run(table, shared_folder(spark)))

    QUERIES[name] = query
    ORACLES[name] = f"WITH {VIEW}{sql}"


def _dirty(t: DataFrame) -> DataFrame:
    """Tickets, some with statuses and severities that there aren't."""
    n = F.substring("id", 2, 10).cast("int")
    return t.withColumns({"status": F.when(n % 7 == 0, "Lost").when(n % 11 == 0, None).otherwise(F.col("status")), "severity": F.when(n % 5 == 0, "HIGH").when(n % 13 == 0, None).otherwise(F.col("severity"))})


_DIRTY = """, x AS (SELECT id, CAST(substr(id, 2) AS INTEGER) AS n, status, severity FROM t),
    y AS (SELECT id, CASE WHEN n % 7 = 0 THEN 'Lost' WHEN n % 11 = 0 THEN NULL ELSE status END AS status, CASE WHEN n % 5 = 0 THEN 'HIGH' WHEN n % 13 = 0 THEN NULL ELSE severity END AS severity FROM x),
    z AS (SELECT *, coalesce(status, '') NOT IN ('Open', 'In Progress', 'Resolved', 'Closed') AS bad_status, severity = 'HIGH' AS bad_severity FROM y)"""


def _records(t: DataFrame, at: str) -> DataFrame:
    _dirty(t).write.parquet(at)
    return S.read_tickets(t.sparkSession, at).select("id", "status", "severity")


def _rejects(t: DataFrame, at: str) -> DataFrame:
    _dirty(t).write.parquet(at)
    return S.rejected_tickets(t.sparkSession, at).select("id", "status", "severity", "wrong")


add("a6_records", _records, f"{_DIRTY} SELECT id, status, coalesce(severity, 'SEV_5') AS severity FROM z WHERE NOT bad_status AND NOT coalesce(bad_severity, false)")
add(
    "a6_rejects",
    _rejects,
    f"{_DIRTY} SELECT id, status, severity, concat_ws('|', CASE WHEN bad_status THEN 'status' END, CASE WHEN bad_severity THEN 'severity' END) AS wrong FROM z WHERE bad_status OR bad_severity",
)

_LONG_SQL = " SELECT 'n.' || severity AS metric, 'n' AS key, CAST(count(*) AS VARCHAR) AS value FROM t GROUP BY severity"


def _counts(t: DataFrame) -> DataFrame:
    return M.to_long(M.distribution(t, "severity").select("severity", "n"), "n", "severity")


def _json(t: DataFrame, at: str) -> DataFrame:
    S.write_json(_counts(t), at)
    return t.sparkSession.read.schema(jobs.LONG).json(at)


def _csv(t: DataFrame, at: str) -> DataFrame:
    names = t.sparkSession.createDataFrame([("n.SEV_1", "how many", "", "x"), ("n.SEV_2", "how many more", "", "x")], "name string, description string, unit string, category string")
    S.write_csv(_counts(t), names, at)
    return t.sparkSession.read.option("header", True).csv(at, nullValue="-")


def _exported(t: DataFrame, at: str) -> DataFrame:
    S.export_raw(t, at)
    back = t.sparkSession.read.parquet(at)
    return back.where("month >= '1997-01' and month < '1998-01'").select(*_SHOW, F.col("month").cast("string").alias("month"), F.element_at("tags", 1).alias("tag"), F.col("metadata")["priority"].alias("priority"))


def _chunks(t: DataFrame, at: str) -> DataFrame:
    t.repartition(5, "id").write.json(f"{at}/in")
    rows = S.read_chunks(t.sparkSession, f"{at}/in", files=2).select("id", "status", "created_date")
    rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return t.sparkSession.read.parquet(f"{at}/out")


def _converted(t: DataFrame, at: str) -> DataFrame:
    parts = []
    for fmt in ("parquet", "json", "csv", "orc"):
        jobs.convert(_counts(t), f"{at}/{fmt}", fmt)
        read = t.sparkSession.read.schema(jobs.LONG)
        back = (read.option("header", True) if fmt == "csv" else read).format(fmt).load(f"{at}/{fmt}")
        parts.append(back.withColumn("format", F.lit(fmt)))
    return jobs.combine(*parts)


add("a14_json", _json, _LONG_SQL)
add(
    "a15_csv",
    _csv,
    """ SELECT 'n.' || severity || '.n' AS "Metric", CAST(count(*) AS VARCHAR) AS "Value", CASE severity WHEN 'SEV_1' THEN 'how many' WHEN 'SEV_2' THEN 'how many more' ELSE '' END AS "Description" FROM t GROUP BY severity""",
)
add(
    "a16_export",
    _exported,
    """ SELECT id, status, severity, assignee, created_date, updated_date, resolved_date, month, lower(description) AS tag, description AS priority
    FROM t WHERE month >= '1997-01' AND month < '1998-01'""",
)
add("a17_chunks", _chunks, " SELECT id, status, created_date FROM t")
add("j9_convert", _converted, f" SELECT x.*, f.format FROM ({_LONG_SQL}) x, (VALUES ('parquet'), ('json'), ('csv'), ('orc')) f(format)")


def _ranges(t: DataFrame, _: str) -> DataFrame:
    names = ("today", "yesterday", "week", "month", "quarter")
    of = lambda n: search(t, Criteria(created_after=named_range(n, _LATE)[0], created_before=named_range(n, _LATE)[1], limit=None)).select(F.lit(n).alias("range"), "id")
    return jobs.combine(*map(of, names))


_LATE = AS_OF.replace(year=1997, month=6, day=20, hour=17)
add(
    "b13_ranges",
    _ranges,
    """, r AS (SELECT * FROM (VALUES ('today', TIMESTAMP '1997-06-20', TIMESTAMP '1997-06-20 17:00:00'), ('yesterday', TIMESTAMP '1997-06-19', TIMESTAMP '1997-06-19 23:59:59.999999'),
    ('week', TIMESTAMP '1997-06-13 17:00:00', TIMESTAMP '1997-06-20 17:00:00'), ('month', TIMESTAMP '1997-05-21 17:00:00', TIMESTAMP '1997-06-20 17:00:00'), ('quarter', TIMESTAMP '1997-03-22 17:00:00', TIMESTAMP '1997-06-20 17:00:00')) v("range", a, z))
    SELECT "range", id FROM t JOIN r ON created_date BETWEEN a AND z""",
)


def _checked(t: DataFrame, _: str) -> DataFrame:
    """Which criteria are refused before a plan is made, beside how many rows the others find."""
    wanted = [("all", Criteria(limit=None)), ("none", Criteria(limit=0)), ("before", Criteria(limit=5, offset=-1)), ("backwards", Criteria(created_after=AS_OF, created_before=_LATE))]
    parts = []
    for name, c in wanted:
        try:
            parts.append(search(t, c).agg(F.lit(name).alias("criteria"), F.lit(True).alias("accepted"), F.count("*").alias("n")))
        except ValueError:
            parts.append(t.agg(F.lit(name).alias("criteria"), F.lit(False).alias("accepted"), F.lit(0).cast("long").alias("n")))
    return jobs.combine(*parts)


add("b16_checked", _checked, " SELECT 'all' AS criteria, true AS accepted, count(*) AS n FROM t UNION ALL SELECT x, false, 0 FROM (VALUES ('none'), ('before'), ('backwards')) v(x)")

_SAID = "text || CASE doc_id % 6 WHEN 0 THEN ' <script>alert(1)</script>' WHEN 1 THEN ' x UNION SELECT y' WHEN 2 THEN ' ../../etc/passwd' WHEN 3 THEN ' $(id)' WHEN 4 THEN ' javascript:void(0)' ELSE '' END"
_INJECTED = ", ".join(f"CASE WHEN regexp_matches(x, '(?is){_q(p)}') THEN 'injection_{i + 1}' END" for i, p in enumerate(validation.INJECTION))
add(
    "d19_injection",
    lambda d, _: d.select("doc_id", validation.matches(F.expr(_SAID), validation.INJECTION).alias("found")),
    f" SELECT doc_id, concat_ws('|', {_INJECTED}) AS found FROM (SELECT doc_id, {_SAID} AS x FROM documents)",
    "documents",
)

#: Every result of a whole analysis, and the query whose SQL gives the same.
_PARTS = {
    "metric.resolution_overview": "e9_overview", "metric.resolution_by_severity": "e3_resolution_by_severity", "metric.resolution_by_assignee": "e4_resolution_by_assignee", "metric.outlier_summary": "e7_outlier_summary",
    "metric.status_distribution": "f1_status", "metric.severity_distribution": "f3_severity", "metric.volume_summary": "f6_volume_summary", "metric.volume": "f7_volume", "metric.peaks": "f8_peaks", "metric.monthly_growth": "f9_growth",
    "metric.team_assignee": "f10_assignee", "metric.team_group": "f11_group", "metric.workload_stats": "f13_workload_stats_assignee", "trend.volume_trend": "g1_volume_trend", "trend.resolution_trend": "g5_resolution_trend",
    "trend.seasonality": "g10_seasonality", "trend.weekly_growth": "g16_weekly_growth", "trend.correlation": "g18_correlation", "trend.summary": "g21_summary", "trend.patterns": "g22_patterns", "quality": "k1_k5_quality", "insights": "k7_k8_insights",
}
_KEYS = {
    "severity": ("metric.resolution_by_severity", "metric.severity_distribution"), "assignee": ("metric.resolution_by_assignee", "metric.team_assignee"), "resolver_group": ("metric.team_group",), "status": ("metric.status_distribution",),
    "grain": ("metric.volume", "trend.volume_trend", "trend.seasonality"), "key": ("metric.volume", "trend.seasonality"), "day": ("metric.peaks",), "month": ("metric.monthly_growth",), "period": ("trend.weekly_growth",),
}
#: Values that no query's SQL gives.
_UNTOLD = ("key_patterns", "attention_areas")


def _part_sql(part: str) -> str:
    keys = [k for k in jobs.KEYS if part in _KEYS.get(k, ())]
    rest = f"COLUMNS(* EXCLUDE ({', '.join(keys)}))" if keys else "COLUMNS(*)"
    name = " || ".join([f"'{part}'", *[f"coalesce('.' || CAST(\"{k}\" AS VARCHAR), '')" for k in keys]])
    inner = f"SELECT {''.join(f'CAST({k} AS VARCHAR) AS {k}, ' for k in keys)}CAST({rest} AS VARCHAR) FROM ({ORACLES[_PARTS[part]]})"
    exclude = f"(* EXCLUDE ({', '.join(keys)}))" if keys else "(*)"
    return f"SELECT {name} AS metric, name_ AS key, value_ AS value FROM (SELECT * FROM ({inner}) UNPIVOT INCLUDE NULLS (value_ FOR name_ IN (COLUMNS{exclude})))"


def _told(long: DataFrame) -> DataFrame:
    """Numbers to six digits, other values as they are."""
    n = F.col("value").try_cast("double")
    return long.where(~F.col("key").isin(*_UNTOLD)).select("metric", "key", n.alias("number"), F.when(n.isNull(), F.replace("value", F.lit("; "), F.lit("|"))).alias("value"))


def _told_sql(parts: list[str]) -> str:
    every = " UNION ALL ".join(map(_part_sql, parts))
    return f"SELECT metric, key, round(TRY_CAST(value AS DOUBLE), 6) AS number, CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN value END AS value FROM ({every})"


def _analysis(name: str, kinds: tuple[str, ...], **settings: object) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        long = jobs.analyze(S.order_tickets(spark, sf_dir), AS_OF, **settings)
        return rounded(_told(long.where(" or ".join(f"metric like '{k}%'" for k in kinds))))

    QUERIES[name] = query
    ORACLES[name] = _told_sql([p for p in _PARTS if p.startswith(kinds)])


_analysis("j1_analyze", ("metric", "trend", "insights"))
_analysis("j2_metrics", ("metric", "trend"), trend=None)
ORACLES["j2_metrics"] = _told_sql([p for p in _PARTS if p.startswith("metric")])
_analysis("j2_trends", ("metric", "trend"), metrics=None)
ORACLES["j2_trends"] = _told_sql([p for p in _PARTS if p.startswith("trend")])


def _failing(t: DataFrame, _: str) -> DataFrame:
    """One metric can't be planned, one can't be run; the third stands."""
    some = registry.Registry(rate=M.resolution_rate, unplanned=lambda t: t.select("no_such_column"), unrun=lambda t: t.select(F.assert_true(F.col("id").isNull()).alias("x")))
    return jobs.analyze(t, AS_OF, some, None).where("metric like 'metric%'").select("metric", "key", F.when(F.col("key") != "error", F.col("value").cast("double")).alias("number"))


add(
    "j3_partial",
    _failing,
    """ SELECT 'metric.rate' AS metric, key, round(CASE key WHEN 'total' THEN n WHEN 'resolved' THEN r ELSE 100.0 * r / n END, 6) AS number
    FROM (SELECT count(*) AS n, count(*) FILTER (done) AS r FROM t), (VALUES ('total'), ('resolved'), ('rate')) v(key)
    UNION ALL SELECT 'metric.' || x, 'error', NULL FROM (VALUES ('unplanned'), ('unrun')) w(x)""",
)


# sketches of each day, kept in the shared folder, merged over ranges; their quantiles' ranks are counted in the rows


def _sketched(t: DataFrame, at: str, first: str, last: str, key: Callable[[str], Column], name: str) -> DataFrame:
    """Of each group of a range: exact counts and ends, and of three quantiles whether their true ranks are within the bound."""
    sketches.daily(t, "severity").write.parquet(f"{at}/days")
    days = sketches.between(t.sparkSession.read.parquet(f"{at}/days"), first, last)
    q = sketches.told(sketches.merged(days, key("day").alias(name)), 50, 90, 99)
    rows = M.positive(t).where(F.to_date("created_date").between(first, last)).select(key("created_date").alias(name), "h")
    truth = rows.join(q, name).groupBy(name).agg(*[(F.count_if(F.col("h") < F.col(p)) / F.count("*")).alias(f"low_{p}") for p in ("p50", "p90", "p99")], *[(F.count_if(F.col("h") <= F.col(p)) / F.count("*")).alias(f"high_{p}") for p in ("p50", "p90", "p99")])
    # a value that several rows have has all their ranks
    ok = {f"{p}_within": (F.col(f"low_{p}") <= x + F.greatest(F.lit(sketches.rank_error()), 1 / F.col("n"))) & (F.col(f"high_{p}") >= x - F.greatest(F.lit(sketches.rank_error()), 1 / F.col("n"))) for p, x in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))}
    return q.join(truth, name).select(name, "n", "avg_hours", "min_hours", "max_hours", *[c.alias(k) for k, c in ok.items()])


def _sketched_sql(key: str, name: str, first: str, last: str) -> str:
    return f""" SELECT {key} AS {name}, count(*) AS n, round(avg(h), 6) AS avg_hours, round(min(h), 6) AS min_hours, round(max(h), 6) AS max_hours, true AS p50_within, true AS p90_within, true AS p99_within
    FROM p WHERE CAST(created_date AS DATE) BETWEEN DATE '{first}' AND DATE '{last}' GROUP BY 1"""


add("e2_sketches", lambda t, at: _sketched(t, at, "1996-02-01", "1999-11-30", lambda c: F.col("severity"), "severity"), _sketched_sql("severity", "severity", "1996-02-01", "1999-11-30"))
add("g5_sketches", lambda t, at: _sketched(t, at, "1995-01-01", "2001-12-31", lambda c: F.date_format(c, "yyyy-MM"), "month"), _sketched_sql("month", "month", "1995-01-01", "2001-12-31"))


def _periods(t: DataFrame, at: str) -> DataFrame:
    """The same days in two ranges that overlap, and both as one: counts add up, as sketches are merged and not rows."""
    sketches.daily(t, "severity").write.parquet(f"{at}/days")
    days = t.sparkSession.read.parquet(f"{at}/days")
    parts = {"early": (None, "1997-12-31"), "late": ("1997-01-01", None), "all": (None, None)}
    out = [sketches.told(sketches.merged(sketches.between(days, *x).withColumn("period", F.lit(k)), "period"), 50) for k, x in parts.items()]
    exact = {k: ranks.described(M.positive(t).where(F.lit(True) if x[0] is None else F.to_date("created_date") >= x[0]).where(F.lit(True) if x[1] is None else F.to_date("created_date") <= x[1]), "h", (), {"low": 0.49, "high": 0.51}).select(F.lit(k).alias("period"), "low", "high") for k, x in parts.items()}
    rows = [q.join(exact[k], "period") for q, k in zip(out, parts, strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select("period", "n", "avg_hours", F.col("p50").between(F.col("low"), F.col("high")).alias("median_within"))


add(
    "j4_sketches", _periods,
    " SELECT period, count(*) AS n, round(avg(h), 6) AS avg_hours, true AS median_within FROM p, (VALUES ('early', DATE '1900-01-01', DATE '1997-12-31'), ('late', DATE '1997-01-01', DATE '2100-01-01'), ('all', DATE '1900-01-01', DATE '2100-01-01')) v(period, a, z) WHERE CAST(created_date AS DATE) BETWEEN a AND z GROUP BY 1",
)

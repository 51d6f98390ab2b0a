"""Registered queries over the driver's tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import clean, monitoring, privacy, quality, sla, trends, validation
from tidemark.operators import metrics as M
from tidemark.operators.criteria import Criteria, last_days, named_range, search, top
from tidemark.plans import jobs, registry
from tidemark.session import shared_folder
from tidemark.sources import tickets as S
from tidemark.streaming import events as stream

AS_OF = datetime(2001, 8, 2)
EVENTS_AS_OF = datetime(2024, 1, 30)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VIEW = """
t0 AS (SELECT concat('T', lpad(CAST(o.o_orderkey AS VARCHAR), 7, '0')) AS id, concat('Order ', CAST(o.o_orderkey AS VARCHAR)) AS title, o.o_orderpriority AS description,
  CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 4 = 0 THEN 'Closed' WHEN o.o_orderstatus = 'F' THEN 'Resolved' WHEN o.o_orderstatus = 'P' THEN 'In Progress' ELSE 'Open' END AS status,
  concat('SEV_', substr(o.o_orderpriority, 1, 1)) AS severity, o.o_orderdate + INTERVAL '1' HOUR * (o.o_orderkey % 24) AS created_date, l.first_ship AS updated_date,
  CASE WHEN o.o_orderstatus = 'F' THEN l.last_ship + INTERVAL '1' HOUR * (o.o_custkey % 24) END AS resolved_date,
  CASE WHEN o.o_custkey % 10 <> 0 THEN concat('user', CAST(o.o_custkey % 50 AS VARCHAR)) END AS assignee, c.c_mktsegment AS resolver_group
  FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey),
t AS (SELECT *, status IN ('Resolved', 'Closed') AND resolved_date IS NOT NULL AS done,
  CASE WHEN status IN ('Resolved', 'Closed') AND resolved_date IS NOT NULL THEN date_diff('microsecond', created_date, resolved_date) / 3.6e9 END AS h,
  date_diff('microsecond', created_date, TIMESTAMP '2001-08-02') / 3.6e9 AS age, coalesce(nullif(assignee, ''), 'Unassigned') AS who, coalesce(nullif(resolver_group, ''), 'Unassigned') AS team,
  strftime(created_date, '%Y-%m') AS month, CAST(date_trunc('week', created_date) AS DATE) AS monday FROM t0),
p AS (SELECT * FROM t WHERE h > 0),
d AS (SELECT CAST(created_date AS DATE) AS dy, count(*) AS n FROM t GROUP BY 1),
w AS (SELECT CAST(monday AS VARCHAR) || '/' || CAST(monday + 6 AS VARCHAR) AS period, count(*) AS n FROM t GROUP BY 1),
ops AS (SELECT *, event_type AS operation, value AS duration_ms, event_type <> 'error' AS success FROM events),
ed AS (SELECT CAST(ts AS DATE) AS dy, count(*) AS n FROM events GROUP BY 1)
"""


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, dates and times as text, so that engines can be compared."""
    out = []
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        out.append((F.round(c, 6) if kind == "double" else c.cast("string") if kind == "date" else F.array_join(c, "|") if kind == "array<string>" else c).alias(f.name))
    return df.select(*out)


def add(name: str, run: Callable[[DataFrame], DataFrame], sql: str | None, source: str = "tickets") -> None:
    """Registers a query over tickets or one of the tables."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = S.order_tickets(spark, sf_dir) if source == "tickets" else spark.read.parquet(f"{sf_dir}/{source}.parquet")
        return rounded(run(table))

    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = f"WITH {VIEW} {sql}" if not sql.startswith(",") else f"WITH {VIEW}{sql}"


FIVE = "round(avg(h), 6) AS avg_hours, round(quantile_cont(h, 0.5), 6) AS median_hours, count(*) AS n, round(min(h), 6) AS min_hours, round(max(h), 6) AS max_hours"
PS = ", ".join(f"round(quantile_cont(h, {n / 100}), 6) AS p{n}" for n in M.PERCENTILES)

# sources
_RAW = lambda e: e.select(
    F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("title"), F.lit(None).cast("string").alias("description"), F.element_at(F.array(*map(F.lit, ["new", "work in progress", " Resolved", "odd"])), (F.col("event_id") % 4 + 1).cast("int")).alias("status"),
    F.element_at(F.array(*map(F.lit, ["sev1", "HIGH", "severity_3", "?"])), (F.col("event_id") % 4 + 1).cast("int")).alias("severity"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createDate"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("lastUpdatedDate"), F.lit("nonsense").alias("lastResolvedDate"),
    F.lit(None).cast("string").alias("assignee"), F.lit(None).cast("array<string>").alias("tags"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("externalId"),
    F.struct(F.struct(F.col("event_type").alias("assignedGroup"), *[F.lit(None).cast("string").alias(c) for c in ("impact", "urgency", "category", "subcategory")]).alias("tt")).alias("extensions"),
)
add("a1_a5_raw", lambda e: S.map_raw(_RAW(e)).select("id", "title", "description", "status", "severity", "created_date", "updated_date", "resolved_date", "resolver_group", F.col("metadata")["source"].alias("source"), F.size("metadata").alias("n_metadata"), F.size("tags").alias("n_tags")),
    "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS title, '' AS description, CASE event_id % 4 WHEN 1 THEN 'In Progress' WHEN 2 THEN 'Resolved' ELSE 'Open' END AS status, CASE event_id % 4 WHEN 0 THEN 'SEV_1' WHEN 1 THEN 'SEV_2' WHEN 2 THEN 'SEV_3' ELSE 'SEV_5' END AS severity, date_trunc('second', ts) AS created_date, date_trunc('second', ts) AS updated_date, CAST(NULL AS TIMESTAMP) AS resolved_date, event_type AS resolver_group, 's' AS source, CAST(2 AS INTEGER) AS n_metadata, CAST(0 AS INTEGER) AS n_tags FROM events", "events")
add("a8_rejects", lambda e: S.rejected_raw(_RAW(e).withColumn("title", F.when(F.col("title") != "click", F.col("title")))).select("id", "missing"), "SELECT CAST(event_id AS VARCHAR) AS id, 'title' AS missing FROM events WHERE event_type = 'click'", "events")
add("a7_records", lambda t: S.to_records(t.select("id", "status", "severity", "assignee")), """SELECT '{"id":"' || id || '","status":"' || status || '","severity":"' || severity || '","assignee":' || coalesce('"' || assignee || '"', 'null') || '}' AS record FROM t""")
add("a8_search", lambda t: search(t, Criteria(statuses=["Open", "In Progress"], severities=["SEV_1"], limit=100)).select("id", "status", "created_date"), "SELECT id, status, created_date FROM t WHERE status IN ('Open', 'In Progress') AND severity = 'SEV_1' ORDER BY created_date, id LIMIT 100")
add("a9_by_id", lambda t: S.by_id(t, "T0000007").select("id", "status", "severity", "assignee"), "SELECT id, status, severity, assignee FROM t WHERE id = 'T0000007'")
add("a10_details", lambda t: S.details(t, AS_OF).select("id", "is_resolved", "age_days", "resolution_hours"), "SELECT id, done AS is_resolved, CAST(floor(age / 24) AS BIGINT) AS age_days, round(h, 6) AS resolution_hours FROM t")
add("a11_count_by_status", S.count_by_status, "SELECT status, count(*) AS n FROM t GROUP BY 1")
add("a12_page", lambda t: S.page(t, 100, 200)[0].select("id", "created_date"), "SELECT id, created_date FROM t ORDER BY created_date, id LIMIT 100 OFFSET 200")
add("a18_metric_value", lambda t: M.metric_value(M.to_long(S.count_by_status(t), "status", "status"), "status.Open", "n", "0"), "SELECT CAST(count(*) AS VARCHAR) AS value FROM t WHERE status = 'Open'")

# predicates
_ids = lambda c: (lambda t: search(t, c).select("id"))
add("b1_b2_status_severity", _ids(Criteria(statuses=["Closed"], severities=["SEV_2", "SEV_3"], limit=None)), "SELECT id FROM t WHERE status = 'Closed' AND severity IN ('SEV_2', 'SEV_3')")
add("b3_b4_assignee_group", _ids(Criteria(assignees=["user7", "user13"], resolver_groups=["BUILDING", "MACHINERY"], limit=None)), "SELECT id FROM t WHERE assignee IN ('user7', 'user13') AND resolver_group IN ('BUILDING', 'MACHINERY')")
add("b5_created_range", _ids(Criteria(created_after=datetime(1997, 1, 1), created_before=datetime(1997, 3, 1), limit=None)), "SELECT id FROM t WHERE created_date BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-01'")
add("b6_updated_range", _ids(Criteria(updated_after=datetime(1997, 1, 1), updated_before=datetime(1997, 3, 1), limit=None)), "SELECT id FROM t WHERE updated_date BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-01'")
add("b7_all_tags", _ids(Criteria(tags=["1-urgent", "BUILDING"], limit=None)), "SELECT id FROM t WHERE lower(description) = '1-urgent' AND resolver_group = 'BUILDING'")
add("b8_phrase", _ids(Criteria(phrase="order 12", limit=None)), "SELECT id FROM t WHERE contains(lower(title), 'order 12') OR contains(lower(description), 'order 12')")
add("b9_ids", _ids(Criteria(ids=["T0000001", "T0000100", "X"], limit=None)), "SELECT id FROM t WHERE id IN ('T0000001', 'T0000100', 'X')")
add("b10_exclude_resolved", _ids(Criteria(exclude_resolved=True, limit=None)), "SELECT id FROM t WHERE status NOT IN ('Resolved', 'Closed')")
add("b11_exclude_automated", lambda t: search(t, Criteria(automated=F.col("assignee").rlike("^user4"), limit=None)).select("id"), "SELECT id FROM t WHERE NOT coalesce(regexp_matches(assignee, '^user4'), false)")
add("b12_last_days", lambda t: last_days(t, AS_OF, 90).select("id"), "SELECT id FROM t WHERE created_date >= TIMESTAMP '2001-08-02' - INTERVAL 90 DAY")
add("b13_quarter", lambda t: search(t, Criteria(created_after=named_range("quarter", AS_OF)[0], created_before=named_range("quarter", AS_OF)[1], limit=None)).select("id"), "SELECT id FROM t WHERE created_date BETWEEN TIMESTAMP '2001-08-02' - INTERVAL 90 DAY AND TIMESTAMP '2001-08-02'")
add("b15_limit_offset", _ids(Criteria(severities=["SEV_5"], limit=50, offset=25)), "SELECT id FROM t WHERE severity = 'SEV_5' ORDER BY created_date, id LIMIT 50 OFFSET 25")
add("b19_top", lambda t: top(M.workload(t, "assignee"), "n", 10, "assignee"), "SELECT who AS assignee, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")

# scalars
add("c1_c3_hours", lambda t: t.select("id", C.is_resolved().alias("is_resolved"), C.resolution_hours().alias("hours"), C.age_hours(AS_OF).alias("age")), "SELECT id, done AS is_resolved, round(h, 6) AS hours, round(age, 6) AS age FROM t")
add(
    "c4_c9_calendar",
    lambda t: t.select("id", C.day("created_date").alias("day"), C.week_label("created_date").alias("week_label"), C.week_period("created_date").alias("week_period"), C.month_label("created_date").alias("month"), C.quarter_label("created_date").alias("quarter"), C.month_name("created_date").alias("month_name"), F.hour("created_date").alias("hour"), C.day_name("created_date").alias("day_name"), F.weekday("created_date").alias("dow")),
    "SELECT id, CAST(CAST(created_date AS DATE) AS VARCHAR) AS day, strftime(created_date, '%Y-W%U') AS week_label, CAST(monday AS VARCHAR) || '/' || CAST(monday + 6 AS VARCHAR) AS week_period, month, 'Q' || quarter(created_date) AS quarter, strftime(created_date, '%B') AS month_name, CAST(hour(created_date) AS INTEGER) AS hour, strftime(created_date, '%A') AS day_name, CAST(isodow(created_date) - 1 AS INTEGER) AS dow FROM t",
)
add("c10_unassigned", lambda t: t.select("id", C.or_unassigned("assignee").alias("assignee")), "SELECT id, who AS assignee FROM t")
add("c11_analysis_frame", lambda t: M.analysis_frame(t, AS_OF), "SELECT id, title, status, severity, created_date, updated_date, resolved_date, assignee, resolver_group, done AS is_resolved, round(age, 6) AS age_hours, round(h, 6) AS resolution_time_hours FROM t")
add("c12_time_series", lambda t: M.time_series(t, AS_OF), "SELECT CAST(CAST(created_date AS DATE) AS VARCHAR) AS date, created_date AS datetime, id AS ticket_id, status, severity, done AS is_resolved, round(h, 6) AS resolution_hours, round(age, 6) AS age_hours, who AS assignee, team AS resolver_group FROM t")
add("c15_category", lambda t: M.to_long(M.resolution_rate(t), "rate").unionByName(M.to_long(S.count_by_status(t), "status", "status")).select("metric", "key", C.metric_category(F.concat_ws("_", "metric", "key")).alias("category")),
    "SELECT 'rate' AS metric, k AS key, CASE k WHEN 'total' THEN 'volume_metrics' WHEN 'resolved' THEN 'resolution_metrics' ELSE 'other_metrics' END AS category FROM (SELECT unnest(['total', 'resolved', 'rate']) AS k) UNION ALL SELECT DISTINCT 'status.' || status, 'n', CASE WHEN status = 'Resolved' THEN 'resolution_metrics' ELSE 'status_metrics' END FROM t")
add("c16_to_long", lambda t: M.to_long(M.distribution(t, "severity").select("severity", "n"), "severity", "severity"), "SELECT 'severity.' || severity AS metric, 'n' AS key, CAST(count(*) AS VARCHAR) AS value FROM t GROUP BY severity")
add("c17_id_format", lambda t: t.select("id", C.id_is_valid("id").alias("valid"), C.id_is_valid(F.concat("id", F.lit("-X"))).alias("bad")), "SELECT id, true AS valid, false AS bad FROM t")

# cleaning
_ISSUES = "list_filter([CASE WHEN updated_date < created_date THEN 'updated_date_before_created_date' END, CASE WHEN resolved_date < created_date THEN 'resolved_date_before_created_date' END, CASE WHEN created_date > TIMESTAMP '2001-08-02' THEN 'future_created_date' END], lambda x: x IS NOT NULL)"
_FIXED = "CASE WHEN updated_date IS NULL OR updated_date < created_date THEN created_date ELSE updated_date END AS updated_date, CASE WHEN resolved_date < created_date THEN created_date ELSE resolved_date END AS resolved_date"
_SHOW = ("id", "status", "severity", "assignee", "created_date", "updated_date", "resolved_date")
add("d1_issues", lambda t: clean.checked(t, AS_OF).select("id", "issues", "is_valid"), f"SELECT id, array_to_string({_ISSUES}, '|') AS issues, len({_ISSUES}) = 0 AS is_valid FROM t")
add("d2_issue_counts", lambda t: clean.issue_counts(t, AS_OF), f"SELECT issue, count(*) AS n FROM (SELECT unnest({_ISSUES}) AS issue FROM t) GROUP BY 1")
add("d3_light", lambda t: clean.lightly_valid(t).select("id"), "SELECT id FROM t")
add("d4_d7_clean", lambda t: clean.clean(t.withColumns({"status": F.concat(F.lit(" "), F.upper("status")), "assignee": F.concat("assignee", F.lit("@x.org")), "title": F.concat(F.lit("  a\t\n"), "title", F.lit("\x01 "))})).select("id", "status", "severity", "title", "assignee"),
    "SELECT id, status, severity, 'a ' || title AS title, assignee FROM t")
add("d8_d10_repair", lambda t: clean.repair(t, AS_OF).select(*_SHOW), f"SELECT id, status, severity, assignee, created_date, {_FIXED} FROM t")
add("d11_require", lambda t: clean.require(t, ["id", "updated_date", "assignee"]).select("id", "updated_date", "assignee"), "SELECT id, updated_date, coalesce(assignee, '') AS assignee FROM t WHERE updated_date IS NOT NULL")
add("d12_process", lambda t: clean.process(t, AS_OF).select(*_SHOW), f"SELECT id, status, severity, assignee, created_date, {_FIXED} FROM t WHERE len({_ISSUES}) = 0")
add("d13_repair_first", lambda t: clean.repair_first(t, AS_OF).select(*_SHOW), f"SELECT id, status, severity, assignee, created_date, {_FIXED} FROM t")
add("d14_clean_raw", lambda d: clean.clean_raw(d.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("description"), F.lit("Done ").alias("status"), F.lit("urgent").alias("severity"))).select("id", "title", F.length("description").alias("n"), "status", "severity"),
    "SELECT doc_id AS id, source AS title, CAST(length(regexp_replace(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g'), '[\\x00-\\x1f\\x7f]|[\\x{80}-\\x{9f}]', '', 'g')) AS INTEGER) AS n, 'Resolved' AS status, 'SEV_1' AS severity FROM documents", "documents")
add("d15_prune", lambda t: clean.prune(t.select("id", F.concat(F.lit(" "), F.coalesce("assignee", F.lit(" "))).alias("assignee"))), "SELECT id, assignee FROM t")
add("d16_field_errors", lambda t: t.select("id", validation.field_errors("id", "ticket_id").alias("id_errors"), validation.field_errors("title", "safe_text").alias("title_errors"), validation.field_errors(F.coalesce("assignee", F.lit("")), "assignee").alias("who_errors")),
    "SELECT id, '' AS id_errors, '' AS title_errors, CASE WHEN assignee IS NULL THEN 'empty|bad_format' ELSE '' END AS who_errors FROM t")
add("d17_raw_errors", lambda d: d.select(F.col("event_id"), F.concat(F.lit("EV-"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("title"), F.lit("Open").alias("status"), F.lit(None).cast("string").alias("assignee"), F.col("props").alias("description"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("createDate"), F.lit("x").alias("lastUpdatedDate"), F.lit("").alias("lastResolvedDate")).select("event_id", validation.raw_errors().alias("errors")),
    "SELECT event_id, 'lastUpdatedDate:bad_format' AS errors FROM events", "events")
add("d18_batches", lambda d: validation.batches_valid(d.select(F.col("event_type"), F.concat(F.lit("EV-"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("title"), F.lit("Open").alias("status"), F.lit(None).cast("string").alias("assignee"), F.lit("").alias("description"), F.when(F.col("event_type") == "click", "x").otherwise("").alias("createDate"), F.lit("").alias("lastUpdatedDate"), F.lit("").alias("lastResolvedDate")), "event_type"),
    "SELECT event_type, event_type <> 'click' AS all_valid, count(*) AS n FROM events GROUP BY event_type", "events")


def _danger_sql(column: str) -> str:
    tests = ", ".join("CASE WHEN regexp_matches({}, '(?is){}') THEN '{}' END".format(column, p.replace("'", "''"), n.replace("'", "''")) for n, p in validation.DANGERS.items())
    return f"list_filter([{tests}], lambda x: x IS NOT NULL)"


_VERDICT = "CASE WHEN len(bad) > 0 THEN 'INVALID' WHEN regexp_matches(text, '[<>{{}}$`\\\\;|&]') THEN 'SUSPICIOUS' ELSE 'VALID' END".replace("{{", "{").replace("}}", "}")
add("d19_dangers", lambda d: d.select("doc_id", validation.matches("text", validation.DANGERS).alias("dangers"), validation.verdict("text").alias("verdict")), f"SELECT doc_id, array_to_string(bad, '|') AS dangers, {_VERDICT} AS verdict FROM (SELECT doc_id, text, {_danger_sql('text')} AS bad FROM documents)", "documents")
add("d20_sanitize", lambda d: d.select("conv_id", "turn", validation.sanitized("text", "search_term").alias("term"), validation.sanitized("text", "username").alias("username")),
    "SELECT conv_id, turn, substr(trim(regexp_replace(x, '[<>{}$`\\\\;|&]', '', 'g')), 1, 500) AS term, substr(regexp_replace(x, '[^a-zA-Z0-9._-]', '', 'g'), 1, 100) AS username FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(trim(text), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '\\s+', ' ', 'g') AS x FROM conversations)", "conversations")
add("d21_report", lambda d: validation.report(d, "text"), f"SELECT verdict, count(*) AS n FROM (SELECT {_VERDICT} AS verdict FROM (SELECT text, {_danger_sql('text')} AS bad FROM documents)) GROUP BY 1", "documents")
add("d21_dangers", lambda d: validation.danger_counts(d, "text"), f"SELECT danger, count(*) AS n FROM (SELECT unnest({_danger_sql('text')}) AS danger FROM documents) GROUP BY 1", "documents")
add("d22_worst", lambda d: d.select("doc_id", validation.worst(validation.verdict("text"), validation.verdict("source")).alias("verdict"), validation.in_context(validation.verdict(F.concat("source", F.lit("<"))), F.lit("external_api")).alias("outside")), f"SELECT doc_id, {_VERDICT} AS verdict, 'INVALID' AS outside FROM (SELECT doc_id, text, {_danger_sql('text')} AS bad FROM documents)", "documents")

# resolution time
add("e1_resolution_stats", M.resolution_stats, f"SELECT {FIVE}, round(coalesce(stddev_samp(h), 0), 6) AS sd_hours FROM p")
add("e2_percentiles", M.resolution_percentiles, f"SELECT {PS} FROM p")
add("e3_resolution_by_severity", M.resolution_by_severity, f"SELECT severity, {FIVE} FROM p GROUP BY 1")
add("e4_resolution_by_assignee", M.resolution_by_assignee, f"SELECT who AS assignee, {FIVE} FROM p GROUP BY 1")
add("e5_by_day_name", M.resolution_by_day_name, "SELECT strftime(resolved_date, '%A') AS day_name, round(avg(h), 6) AS avg_hours FROM p GROUP BY 1")
add("e6_by_hour", M.resolution_by_hour, "SELECT CAST(hour(resolved_date) AS INTEGER) AS hour, round(avg(h), 6) AS avg_hours FROM p GROUP BY 1")
_BOUND = ", b AS (SELECT q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper, n FROM (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3, count(*) AS n FROM {f}))"
add("e7_outlier_summary", M.outlier_summary, _BOUND.format(x="h", f="p") + " SELECT round(lower, 6) AS lower, round(upper, 6) AS upper, n, count(*) FILTER (h < lower OR h > upper) AS n_outliers, round(100.0 * count(*) FILTER (h < lower OR h > upper) / n, 6) AS percentage FROM p, b GROUP BY lower, upper, n")
add("e7_outlier_list", lambda t: M.outlier_list(t.withColumn("resolved_date", F.when(F.substring("id", 6, 3) == "012", F.timestamp_add("DAY", F.lit(4000), F.col("resolved_date"))).otherwise(F.col("resolved_date")))),
    ", q AS (SELECT id, h + CASE WHEN substr(id, 6, 3) = '012' THEN 96000 ELSE 0 END AS h FROM t), qp AS (SELECT * FROM q WHERE h > 0)" + _BOUND.format(x="h", f="qp") + " SELECT id, round(h, 6) AS hours, CASE WHEN h < lower THEN 'fast' ELSE 'slow' END AS kind, round(greatest(lower - h, h - upper), 6) AS distance FROM qp, b WHERE h < lower OR h > upper ORDER BY greatest(lower - h, h - upper) DESC, id LIMIT 10")
add("e8_rate", M.resolution_rate, "SELECT count(*) AS total, count(*) FILTER (done) AS resolved, round(100.0 * count(*) FILTER (done) / count(*), 6) AS rate FROM t")
add("e9_overview", M.resolution_overview, f", r AS (SELECT count(*) AS total, count(*) FILTER (done) AS resolved FROM t) SELECT total, resolved, round(100.0 * resolved / total, 6) AS rate, x.* FROM r, (SELECT count(*) AS n, round(avg(h), 6) AS avg_hours, round(stddev_samp(h), 6) AS sd_hours, round(min(h), 6) AS min_hours, round(max(h), 6) AS max_hours, {PS} FROM p) x")

# status, severity, volume, team
for name, key in (("f1_status", "status"), ("f3_severity", "severity")):
    add(name, lambda t, k=key: M.distribution(t, k), f"SELECT {key}, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percentage, count(*) OVER () AS n_values, row_number() OVER (ORDER BY count(*) DESC, {key}) = 1 AS most_common FROM t GROUP BY {key}")
for name, key in (("f2_status_month", "status"), ("f4_severity_month", "severity")):
    add(name, lambda t, k=key: M.by_month(t, k), f"SELECT month, {key}, count(*) AS n FROM t GROUP BY ALL")
add("f5_hours_by_severity", M.hours_by_severity, f"SELECT severity, {FIVE} FROM t WHERE h <> 0 GROUP BY 1")
add("f6_volume_summary", M.volume_summary, "SELECT total, span_days, round(total / span_days, 6) AS daily_average, round(total / greatest(1.0, span_days / 7.0), 6) AS weekly_average, round(total / greatest(1.0, span_days / 30.0), 6) AS monthly_average FROM (SELECT count(*) AS total, greatest(1, CAST(floor(date_diff('microsecond', min(created_date), max(created_date)) / 3.6e9 / 24) AS BIGINT)) AS span_days FROM t)")
add("f7_volume", M.volume, "SELECT 'day' AS grain, CAST(dy AS VARCHAR) AS key, n FROM d UNION ALL SELECT 'week', strftime(created_date, '%Y-W%U'), count(*) FROM t GROUP BY 2 UNION ALL SELECT 'month', month, count(*) FROM t GROUP BY 2 UNION ALL SELECT 'hour', CAST(hour(created_date) AS VARCHAR), count(*) FROM t GROUP BY 2 UNION ALL SELECT 'day_name', strftime(created_date, '%A'), count(*) FROM t GROUP BY 2")
add("f8_peaks", M.peaks, "SELECT CAST(dy AS VARCHAR) AS day, n, count(*) OVER () AS n_peaks FROM d, (SELECT avg(n) + coalesce(stddev_samp(n), 0) AS bound FROM d) WHERE n > bound ORDER BY n DESC, dy LIMIT 10")
_GROW = "round((n - before) * 100.0 / before, 6) AS growth, round(avg((n - before) * 100.0 / before) OVER (), 6) AS avg_growth"
add("f9_growth", M.monthly_growth, f"SELECT month, n, before, {_GROW}, CASE WHEN avg((n - before) * 100.0 / before) OVER () > 0 THEN 'increasing' WHEN avg((n - before) * 100.0 / before) OVER () < 0 THEN 'decreasing' ELSE 'stable' END AS trend FROM (SELECT month, n, lag(n) OVER (ORDER BY month) AS before FROM (SELECT month, count(*) AS n FROM t GROUP BY 1)) WHERE before > 0")
for name, key, col in (("f10_assignee", "assignee", "who"), ("f11_group", "resolver_group", "team")):
    add(name, lambda t, k=key: M.team(t, k), f"SELECT {col} AS {key}, count(*) AS total, count(*) FILTER (done) AS resolved, round(avg(h) FILTER (h <> 0), 6) AS avg_hours, round(quantile_cont(h, 0.5) FILTER (h <> 0), 6) AS median_hours, round(100.0 * count(*) FILTER (done) / count(*), 6) AS rate FROM t GROUP BY 1")
for name, key, col in (("assignee", "assignee", "who"), ("group", "resolver_group", "team")):
    add(f"f12_workload_{name}", lambda t, k=key: M.workload(t, k), f"SELECT {col} AS {key}, count(*) AS n FROM t GROUP BY 1")
    add(f"f13_workload_stats_{name}", lambda t, k=key: M.workload_stats(t, k), f"SELECT count(*) AS n_groups, round(avg(n), 6) AS avg_n, max(n) AS max_n, min(n) AS min_n FROM (SELECT {col}, count(*) AS n FROM t GROUP BY 1)")
add("f14_date_range", M.date_range, "SELECT min(created_date) AS first_created, max(created_date) AS last_created FROM t")
add("f15_metadata", lambda t: M.metadata(t, "volume"), "SELECT 'volume' AS calculator, count(*) AS sample_size, min(created_date) AS first_created, max(created_date) AS last_created FROM t")

# trends
_DIR = "CASE WHEN points < 2 THEN 'insufficient_data' WHEN slope > 0.1 THEN 'increasing' WHEN slope < -0.1 THEN 'decreasing' ELSE 'stable' END"
_SLOPE = "SELECT count(*) AS points, regr_slope({v}, x) AS slope FROM (SELECT {v}, row_number() OVER (ORDER BY {k}) - 1 AS x FROM {f})"
_WH = "(SELECT CAST(monday AS VARCHAR) || '/' || CAST(monday + 6 AS VARCHAR) AS period, avg(h) AS hh FROM t WHERE h IS NOT NULL GROUP BY 1)"
add("g1_volume_trend", trends.volume_trend, "SELECT x.*, s.span_days FROM (SELECT 'day' AS grain, count(*) AS periods, round(avg(n), 6) AS avg_n FROM d UNION ALL SELECT 'week', count(*), round(avg(n), 6) FROM w UNION ALL SELECT 'month', count(*), round(avg(n), 6) FROM (SELECT month, count(*) AS n FROM t GROUP BY 1)) x, (SELECT CAST(date_diff('day', CAST(min(created_date) AS DATE), CAST(max(created_date) AS DATE)) + 1 AS INTEGER) AS span_days FROM t) s")
add("g1_weekly", lambda t: trends.series(t, "week"), "SELECT * FROM w")
add("g2_direction", lambda t: trends.trend(M.daily(t), "day", "n"), f"SELECT points, round(slope, 6) AS slope, {_DIR} AS direction FROM ({_SLOPE.format(v='n', k='dy', f='d')})")
add("g3_volatility", lambda t: trends.volatility(M.daily(t)), "SELECT round(stddev_samp(n) / avg(n), 6) AS volatility FROM d")
add("g4_extremes", lambda t: trends.extremes(M.daily(t)), "SELECT kind, CAST(dy AS VARCHAR) AS day, n, n_kind FROM (SELECT *, count(*) OVER (PARTITION BY kind) AS n_kind, row_number() OVER (PARTITION BY kind ORDER BY dy) AS nth FROM (SELECT dy, n, CASE WHEN n > m + s THEN 'peak' WHEN n < m - s THEN 'low' END AS kind FROM d, (SELECT avg(n) AS m, coalesce(stddev_samp(n), 0) AS s FROM d)) WHERE kind IS NOT NULL) WHERE nth <= 5")
add("g5_resolution_trend", trends.resolution_trend, f"SELECT points, round(slope, 6) AS slope, {_DIR} AS direction, overall_hours, rate FROM ({_SLOPE.format(v='hh', k='period', f=_WH)}), (SELECT round(avg(h), 6) AS overall_hours, round(100.0 * count(h) / count(*), 6) AS rate FROM t)")
add("g5_by_month", lambda t: trends.resolution_series(t, "month"), "SELECT month AS period, round(avg(h), 6) AS avg_hours, count(*) AS n FROM t WHERE h IS NOT NULL GROUP BY 1")
add("g6_by_resolved_month", lambda t: trends.resolution_series(t, "month", "resolved_date"), "SELECT strftime(resolved_date, '%Y-%m') AS period, round(avg(h), 6) AS avg_hours, count(*) AS n FROM t WHERE h IS NOT NULL GROUP BY 1")
_PIVOT = lambda key, values, by, k: f"SELECT {k} AS {by}, " + ", ".join(f"count(*) FILTER ({key} = '{v}') AS \"{v}\"" for v in values) + " FROM t GROUP BY 1"
add("g7_status_pivot", lambda t: trends.pivot(t, "status", S.STATUSES[:4]), _PIVOT("status", S.STATUSES[:4], "month", "month"))
_SEV = ("SEV_1", "SEV_2", "SEV_3", "SEV_4", "SEV_5")
add("g8_severity_pivot", lambda t: trends.pivot(t, "severity", _SEV), _PIVOT("severity", _SEV, "month", "month"))
add("g9_status_change", trends.status_change, ", g AS (SELECT a.month, b.status, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT month FROM t) a CROSS JOIN (SELECT DISTINCT status FROM t) b LEFT JOIN (SELECT month, status, count(*) AS n FROM t GROUP BY ALL) c ON a.month = c.month AND b.status = c.status), l AS (SELECT status, n, lag(n) OVER (PARTITION BY status ORDER BY month) AS before FROM g) SELECT status, round(avg((n - before) * 100.0 / before), 6) AS avg_change, CASE WHEN avg((n - before) * 100.0 / before) > 0 THEN 'increasing' WHEN avg((n - before) * 100.0 / before) < 0 THEN 'decreasing' ELSE 'stable' END AS label FROM l WHERE before > 0 GROUP BY 1")
add("g10_seasonality", trends.seasonality, ", s AS (SELECT 'day_name' AS grain, strftime(created_date, '%A') AS key, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'hour', CAST(hour(created_date) AS VARCHAR), count(*) FROM t GROUP BY 2 UNION ALL SELECT 'month_name', strftime(created_date, '%B'), count(*) FROM t GROUP BY 2 UNION ALL SELECT 'quarter', 'Q' || quarter(created_date), count(*) FROM t GROUP BY 2) SELECT grain, key, n, row_number() OVER (PARTITION BY grain ORDER BY n DESC, key) = 1 AS is_peak, row_number() OVER (PARTITION BY grain ORDER BY n, key) = 1 AS is_low FROM s")
_ED = lambda e: e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
add("g11_autocorrelation", lambda e: trends.autocorrelation(_ED(e)), "SELECT days, round(r, 6) AS correlation, CASE WHEN r > 0.7 THEN 'high' WHEN r > 0.5 THEN 'moderate' ELSE 'none' END AS cycle FROM (SELECT count(*) AS days, coalesce(CASE WHEN count(*) >= 14 THEN corr(CAST(n AS DOUBLE), CAST(later AS DOUBLE)) END, 0) AS r FROM (SELECT n, lead(n, 7) OVER (ORDER BY dy) AS later FROM ed))", "events")
add("g12_consistency", trends.weekly_consistency, "SELECT tickets, round(c, 6) AS consistency, CASE WHEN c > 0.7 THEN 'strong' WHEN c > 0.4 THEN 'moderate' ELSE 'weak' END AS pattern FROM (SELECT CAST(sum(n) AS BIGINT) AS tickets, 1 - least(stddev_samp(n) / avg(n) / 2, 1.0) AS c FROM (SELECT isodow(created_date) AS k, count(*) AS n FROM t GROUP BY 1)) WHERE tickets >= 14")
_Z = "SELECT {k}, {v}, abs({v} - m) / s AS z FROM {f}, (SELECT avg({v}) AS m, stddev_samp({v}) AS s, count(*) AS c FROM {f}) WHERE c >= 3 AND s > 0 AND abs({v} - m) / s > 2"
add("g14_anomalies", lambda t: trends.anomalies(M.daily(t), "day", "n"), f", z AS ({_Z.format(k='dy', v='n', f='d')}) SELECT CAST(dy AS VARCHAR) AS day, n, round(z, 6) AS z, CASE WHEN z > 3 THEN 'extreme' ELSE 'moderate' END AS severity, (SELECT count(*) FROM z) AS n_anomalies FROM z ORDER BY z DESC, dy LIMIT 10")
add("g15_hour_anomalies", lambda t: trends.anomalies(M.with_hours(t).where("h is not null").select("id", "h"), "id", "h", None), f", hh AS (SELECT id, h FROM t WHERE h IS NOT NULL), z AS ({_Z.format(k='id', v='h', f='hh')}) SELECT id, round(h, 6) AS h, round(z, 6) AS z, CASE WHEN z > 3 THEN 'extreme' ELSE 'moderate' END AS severity, (SELECT count(*) FROM z) AS n_anomalies FROM z")
add("g16_weekly_growth", trends.weekly_growth, f"SELECT period, n, before, {_GROW}, CASE WHEN a > 5 THEN 'strong_growth' WHEN a > 0 THEN 'moderate_growth' WHEN a > -5 THEN 'stable' ELSE 'declining' END AS class FROM (SELECT *, avg((n - before) * 100.0 / before) OVER () AS a FROM (SELECT period, n, lag(n) OVER (ORDER BY period) AS before FROM w) WHERE before > 0)")
add("g17_daily_frame", trends.daily_frame, "SELECT CAST(CAST(created_date AS DATE) AS VARCHAR) AS day, count(*) AS volume, round(avg(h), 6) AS avg_hours, count(*) FILTER (done) AS resolved FROM t GROUP BY 1")
add("g18_correlation", trends.volume_hours_correlation, ", f AS (SELECT CAST(created_date AS DATE) AS dy, CAST(count(*) AS DOUBLE) AS v, avg(h) AS a FROM t GROUP BY 1), r AS (SELECT count(*) AS days, count(a) AS paired, corr(v, a) FILTER (a IS NOT NULL) AS c FROM f) SELECT days, paired, round(c, 6) AS correlation, CASE WHEN abs(c) >= 0.8 THEN 'very_strong' WHEN abs(c) >= 0.6 THEN 'strong' WHEN abs(c) >= 0.4 THEN 'moderate' WHEN abs(c) >= 0.2 THEN 'weak' ELSE 'very_weak' END AS strength, CASE WHEN c > 0.3 THEN 'Higher ticket volume tends to correlate with longer resolution times' WHEN c < -0.3 THEN 'Higher ticket volume tends to correlate with shorter resolution times' ELSE 'No significant correlation between ticket volume and resolution times' END AS meaning FROM r")
add("g20_forecast", lambda e: trends.forecast(_ED(e), "day", "n"), "SELECT CAST(step AS INTEGER) AS step, round(greatest(0, i + s * (c - 1 + step)), 6) AS forecast, round(s, 6) AS slope, round(i, 6) AS intercept FROM (SELECT count(*) AS c, regr_slope(n, x) AS s, regr_intercept(n, x) AS i FROM (SELECT n, row_number() OVER (ORDER BY dy) - 1 AS x FROM ed)), (SELECT unnest(range(1, 6)) AS step)", "events")
add("g21_summary", trends.trend_summary, f", v AS (SELECT {_DIR} AS volume FROM ({_SLOPE.format(v='n', k='dy', f='d')})), r AS (SELECT {_DIR} AS resolution FROM ({_SLOPE.format(v='hh', k='period', f=_WH)})) SELECT volume, resolution, concat_ws('|', CASE volume WHEN 'increasing' THEN 'Ticket volume is increasing over time' WHEN 'decreasing' THEN 'Ticket volume is decreasing over time' END, CASE resolution WHEN 'increasing' THEN 'Resolution times are increasing' WHEN 'decreasing' THEN 'Resolution times are improving' END) AS findings, concat_ws('|', CASE volume WHEN 'increasing' THEN 'Monitor capacity and consider workload distribution' END, CASE resolution WHEN 'increasing' THEN 'Review resolution processes for potential improvements' END) AS recommendations, CASE WHEN volume = 'stable' OR resolution IN ('stable', 'decreasing') THEN 'good' ELSE 'needs_attention' END AS health FROM v, r")
add("g22_patterns", lambda t: trends.pattern_summary(t).select("pattern_count", "anomaly_count"), f", hh AS (SELECT id, h FROM t WHERE h IS NOT NULL), l AS (SELECT n, lead(n, 7) OVER (ORDER BY dy) AS later FROM d) SELECT CAST(CASE WHEN coalesce(corr(CAST(n AS DOUBLE), CAST(later AS DOUBLE)), 0) > 0.5 THEN 1 ELSE 0 END AS INTEGER) AS pattern_count, (SELECT count(*) FROM ({_Z.format(k='dy', v='n', f='d')})) + (SELECT count(*) FROM ({_Z.format(k='id', v='h', f='hh')})) AS anomaly_count FROM l")
add("g23_status_week", lambda t: trends.pivot(t, "status", S.STATUSES[:4], "week"), _PIVOT("status", S.STATUSES[:4], "week", "CAST(monday AS VARCHAR) || '/' || CAST(monday + 6 AS VARCHAR)"))
add("g24_fit", lambda t: trends.forecast(M.daily(t), "day", "n", 1).select("slope", "intercept"), "SELECT round(regr_slope(n, x), 6) AS slope, round(regr_intercept(n, x), 6) AS intercept FROM (SELECT n, row_number() OVER (ORDER BY dy) - 1 AS x FROM d)")
add("g25_latest", lambda e: trends.latest(e.withColumn("at", F.struct("ts", "event_id")), "event_type", "at", "value"), "SELECT event_type, round(arg_max(value, (ts, event_id)), 6) AS latest, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value FROM events GROUP BY 1", "events")

# quality
_KT = "SELECT count(*) AS total, count(updated_date) + 2 * count(resolved_date) AS checks, count(*) FILTER (updated_date < created_date) + count(*) FILTER (resolved_date < created_date) + count(*) FILTER (resolved_date IS NOT NULL AND status NOT IN ('Resolved', 'Closed')) AS ci, count(*) FILTER (created_date > TIMESTAMP '2001-08-02') + count(*) FILTER (floor(date_diff('microsecond', created_date, resolved_date) / 3.6e9 / 24) > 730) AS vi, count(*) FILTER (created_date >= TIMESTAMP '2001-08-02' - INTERVAL 30 DAY) AS recent, count(assignee) AS wa, count(resolver_group) AS wg FROM t"
add("k1_k5_quality", lambda t: quality.assess(t, AS_OF).select("total", "checks", "consistency_issues", "validity_issues", "recent", "assignee_percent", "resolver_group_percent", "completeness", "consistency", "validity", "timeliness", "score", "issues"),
    f"SELECT total, checks, ci AS consistency_issues, vi AS validity_issues, recent, round(100.0 * wa / total, 6) AS assignee_percent, round(100.0 * wg / total, 6) AS resolver_group_percent, 100.0::DOUBLE AS completeness, round(b, 6) AS consistency, round(c, 6) AS validity, round(e, 6) AS timeliness, round((100 + b + c + e) / 4, 6) AS score, concat_ws('|', CASE WHEN b < 90 THEN 'Data consistency issues - conflicting field values' END, CASE WHEN c < 90 THEN 'Data validity issues - invalid or unreasonable values' END, CASE WHEN e < 50 THEN 'Data timeliness issues - mostly old data' END) AS issues FROM (SELECT *, 100.0 * (checks - ci) / checks AS b, 100.0 * (total - vi) / total AS c, 100.0 * recent / total AS e FROM ({_KT}))")
add("k6_light", quality.light, "SELECT count(*) AS total, count(*) AS complete_records, 0::BIGINT AS missing_id, 0::BIGINT AS missing_created_date, 0::BIGINT AS missing_status, 100.0::DOUBLE AS quality_score FROM t")
add("k7_k8_insights", quality.insights, "SELECT round(a, 6) AS avg_hours, round(r, 6) AS rate, total, concat_ws('|', CASE WHEN a > 48 THEN format('Average resolution time is high at {:.1f} hours', a) END, CASE WHEN a < 4 THEN format('Excellent average resolution time of {:.1f} hours', a) END, CASE WHEN r > 90 THEN format('High resolution rate of {:.1f}%', r) END, CASE WHEN r < 50 THEN format('Low resolution rate of {:.1f}% needs attention', r) END) AS insights, concat_ws('|', CASE WHEN a > 72 THEN 'Consider reviewing resolution processes to reduce average resolution time' END, CASE WHEN total > 1000 THEN 'High ticket volume detected - consider workload distribution analysis' END) AS recommendations FROM (SELECT avg(h) FILTER (h > 0) AS a, 100.0 * count(*) FILTER (done) / count(*) AS r, count(*) AS total FROM t)")

# privacy
_q = lambda p: privacy.any_engine(p).replace("'", "''")


def _fold_sql(column: str, pairs: list[tuple[str, str]]) -> str:
    for p, r in pairs:
        column = f"regexp_replace({column}, '{_q(p)}', '{_q(r)}', 'g')"
    return column


_PII = [(p, f"[{n.upper()}_REDACTED]") for n, p in privacy.PII.items()]
_RULES = [(r.regex(), r.replacement) for r in privacy.RULES]
_KINDS = ", ".join(f"CASE WHEN regexp_matches(text, '{_q(p)}') THEN '{n}' END" for n, p in privacy.PII.items())
_COUNTS = ", ".join(f"CAST(len(regexp_extract_all(text, '{_q(p)}')) AS INTEGER) AS n_{n}" for n, p in privacy.PII.items())
add("l1_detect", lambda d: d.select("doc_id", privacy.detected("text").alias("kinds")), f"SELECT doc_id, concat_ws('|', {_KINDS}) AS kinds FROM documents", "documents")
add("l2_counts", lambda d: d.select("doc_id", *[c.alias(f"n_{k}") for k, c in privacy.counts("text").items()]), f"SELECT doc_id, {_COUNTS} FROM documents", "documents")
add("l3_redact_pii", lambda d: d.select("doc_id", privacy.redact_pii("text").alias("text")), f"SELECT doc_id, {_fold_sql('text', _PII)} AS text FROM documents", "documents")
add("l4_redact_rules", lambda d: d.select("doc_id", privacy.redact("text", "high").alias("text")), f"SELECT doc_id, {_fold_sql('text', [(r.regex(), r.replacement) for r in privacy.applied(privacy.RULES, 'high')])} AS text FROM documents", "documents")
add("l5_l6_records", lambda d: privacy.redact_records(d.select("conv_id", "turn", F.col("role").alias("auth_token"), F.struct("text", F.col("role").alias("email")).alias("s"), F.array("text").alias("a"), F.create_map(F.lit("password"), F.col("text"), F.lit("note"), F.col("text")).alias("m"))).select("conv_id", "turn", "auth_token", F.col("s.text").alias("s_text"), F.col("s.email").alias("s_email"), F.col("a")[0].alias("a_text"), F.col("m")["password"].alias("m_password"), F.col("m")["note"].alias("m_note")),
    f"SELECT conv_id, turn, '[REDACTED]' AS auth_token, x AS s_text, '[REDACTED]' AS s_email, x AS a_text, '[REDACTED]' AS m_password, x AS m_note FROM (SELECT conv_id, turn, {_fold_sql('text', _RULES)} AS x FROM conversations)", "conversations")
add("l7_redact_either", lambda d: d.select("doc_id", privacy.redact_either("text").alias("text")), f"SELECT doc_id, CASE WHEN concat_ws('|', {_KINDS}) <> '' THEN {_fold_sql('text', _PII)} ELSE {_fold_sql('text', _RULES)} END AS text FROM documents", "documents")
_HAS = lambda *k: "(" + " OR ".join(f"regexp_matches(text, '{_q(privacy.PII[n])}')" for n in k) + ")"
_HITS = " + ".join(f"CAST(regexp_matches(text, '{_q(r.regex())}') AS INTEGER)" for r in privacy.RULES)
add("l8_report", lambda d: privacy.report(d.select("doc_id", "text"), "text").select("doc_id", "n_pii", "rules_hit", "risk", "recommendations"),
    f"SELECT doc_id, CAST({' + '.join(f'n_{n}' for n in privacy.PII)} AS INTEGER) AS n_pii, CAST({_HITS} AS INTEGER) AS rules_hit, CASE WHEN {_HAS('ssn', 'credit_card', 'aws_secret_key', 'api_key')} THEN 'CRITICAL' WHEN {_HAS('email', 'phone_us', 'phone_international', 'aws_access_key')} THEN 'HIGH' WHEN concat_ws('|', {_KINDS}) <> '' THEN 'MEDIUM' ELSE 'LOW' END AS risk, coalesce(nullif(concat_ws('|', CASE WHEN {_HAS('ssn')} THEN 'Remove Social Security Numbers immediately' END, CASE WHEN {_HAS('credit_card')} THEN 'Remove credit card numbers immediately' END, CASE WHEN {_HAS('aws_secret_key', 'api_key')} THEN 'Rotate compromised API keys/secrets' END, CASE WHEN {_HAS('email', 'phone_us', 'phone_international')} THEN 'Consider masking contact information' END), ''), 'No critical PII detected, but continue monitoring') AS recommendations FROM (SELECT doc_id, text, {_COUNTS} FROM documents)", "documents")
add("l8_risk", lambda d: privacy.report(d.select("doc_id", "text"), "text").groupBy("risk").agg(F.count("*").alias("n")), f"SELECT CASE WHEN {_HAS('ssn', 'credit_card', 'aws_secret_key', 'api_key')} THEN 'CRITICAL' WHEN {_HAS('email', 'phone_us', 'phone_international', 'aws_access_key')} THEN 'HIGH' WHEN concat_ws('|', {_KINDS}) <> '' THEN 'MEDIUM' ELSE 'LOW' END AS risk, count(*) AS n FROM documents GROUP BY 1", "documents")
_MORE = privacy.Rule(r"[A-Z]{6,}", "[CAPS]", "high", False)
add("l9_custom", lambda d: d.select("doc_id", privacy.redact("text", "critical", []).alias("a"), privacy.fold("text", [(_MORE.regex(), _MORE.replacement)]).alias("b")), f"SELECT doc_id, {_fold_sql('text', [(r.regex(), r.replacement) for r in privacy.applied(privacy.RULES, 'critical')])} AS a, {_fold_sql('text', [(_MORE.regex(), _MORE.replacement)])} AS b FROM documents", "documents")
add("l10_errors", lambda d: d.select("conv_id", "turn", privacy.redact_error(F.concat(F.lit('File "x.py", line 12 at /a/tidemark/b '), "text")).alias("text")), f"""SELECT conv_id, turn, {_fold_sql("('File " + '"x.py", line 12 at /a/tidemark/b ' + "' || text)", [*_RULES, *privacy.ERROR_RULES])} AS text FROM conversations""", "conversations")
add("l11_logs", lambda d: d.select("doc_id", privacy.redact_log("text").alias("text"), privacy.redact_log("text", True).alias("debug")), f"SELECT doc_id, {_fold_sql('text', list(privacy.KEY_VALUE_RULES))} AS text, {_fold_sql('text', [*privacy.KEY_VALUE_RULES, *privacy.LOG_RULES])} AS debug FROM documents", "documents")

# monitoring
_O = lambda f: (lambda e: f(monitoring.as_operations(e)))
_NR = "list_sort(list(duration_ms))[CAST(least(floor(count(*) * {p}), count(*) - 1) AS BIGINT) + 1]"
_I1 = f"SELECT operation, count(*) AS n, count(*) FILTER (success) AS n_success, round(avg(duration_ms), 6) AS avg_ms, round(quantile_cont(duration_ms, 0.5), 6) AS median_ms, round(min(duration_ms), 6) AS min_ms, round(max(duration_ms), 6) AS max_ms, round({_NR.format(p=0.95)}, 6) AS p95_ms, round({_NR.format(p=0.99)}, 6) AS p99_ms, count(*) FILTER (NOT success) AS n_error, round(count(*) FILTER (success) / count(*), 6) AS success_rate FROM ops GROUP BY 1"
add("i1_operation_stats", _O(monitoring.operation_stats), _I1, "events")
_TAGS = lambda: F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
add("i2_counters", lambda e: monitoring.counters(e, monitoring.counter_key(F.lit("events"), _TAGS()), "value"), "SELECT 'events[k=' || json_extract_string(props, '$.k') || ',type=' || event_type || ']' AS counter, round(sum(value), 6) AS total FROM events GROUP BY 1", "events")
add("i2_gauges", lambda e: monitoring.gauges(e.withColumn("at", F.struct("ts", "event_id")), F.col("event_type"), "value", "at"), "SELECT event_type AS gauge, round(arg_max(value, (ts, event_id)), 6) AS last_value FROM events GROUP BY 1", "events")
add("i3_trailing", lambda e: monitoring.trailing(e, "value", EVENTS_AS_OF, 24 * 60), "SELECT count(*) AS n, round(avg(value), 6) AS avg_value, round(max(value), 6) AS max_value, round(min(value), 6) AS min_value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-29' AND TIMESTAMP '2024-01-30'", "events")


def _thresholds(e: DataFrame) -> DataFrame:
    rows = e.sparkSession.createDataFrame([("click", 80.0), ("view", 90.0), ("error", 50.0)], "metric string, threshold double")
    return monitoring.over_thresholds(e.select("event_id", F.col("event_type").alias("metric"), "value"), rows).select("event_id", "metric", "value", "threshold", "severity")


add("i4_thresholds", _thresholds, "SELECT event_id, event_type AS metric, round(value, 6) AS value, threshold, CASE WHEN value < threshold * 1.2 THEN 'warning' ELSE 'critical' END AS severity FROM events JOIN (VALUES ('click', 80.0::DOUBLE), ('view', 90.0::DOUBLE), ('error', 50.0::DOUBLE)) v(m, threshold) ON event_type = m WHERE value > threshold", "events")
add("i5_comparison", lambda e: e.select("event_id", *[monitoring.violated(F.col("value"), F.lit(c), F.lit(50.0)).alias(c) for c in ("greater_than", "less_than", "equals")]), "SELECT event_id, value > 50 AS greater_than, value < 50 AS less_than, abs(value - 50) < 0.001 AS equals FROM events", "events")
_BAD = lambda e: e.groupBy("event_type", "ts").agg((F.max("value") > 10).alias("bad"))
_RUNS = ", s AS (SELECT event_type, ts, max(value) > 10 AS bad FROM events GROUP BY ALL), g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY ts) AS run FROM s), r AS (SELECT *, min(ts) OVER (PARTITION BY event_type, run) AS start FROM g WHERE bad), f AS (SELECT event_type, start, max(ts) AS \"end\", count(*) AS n, min(ts) FILTER (ts > start AND date_diff('microsecond', start, ts) // 1000000 / 60 >= 30) AS fired FROM r GROUP BY event_type, run, start HAVING fired IS NOT NULL)"
add("i6_sustained", lambda e: monitoring.sustained(_BAD(e), 30, "event_type"), _RUNS + " SELECT * FROM f", "events")
add("i7_performance", _O(lambda o: monitoring.performance_violations(monitoring.operation_stats(o), 20.0).select("operation", "n")), "SELECT operation, count(*) AS n FROM ops GROUP BY 1 HAVING count(*) >= 10 AND (avg(duration_ms) > 20 OR count(*) FILTER (NOT success) / count(*) > 0.1)", "events")
add("i8_cooldown", lambda e: monitoring.cooled(monitoring.sustained(_BAD(e), 30, "event_type"), 24 * 60, "event_type"), None, "events")
ORACLES["i8_cooldown"] = f"WITH RECURSIVE {VIEW}{_RUNS}, k AS (SELECT event_type, min(fired) AS fired FROM f GROUP BY 1 UNION ALL SELECT k.event_type, (SELECT min(f.fired) FROM f WHERE f.event_type = k.event_type AND date_diff('microsecond', k.fired, f.fired) // 1000000 >= 86400) FROM k WHERE k.fired IS NOT NULL) SELECT event_type, fired FROM k WHERE fired IS NOT NULL"
add("i9_resolution", lambda e: monitoring.with_resolution(_BAD(e), monitoring.sustained(_BAD(e), 30, "event_type"), "event_type").select("event_type", "start", "fired", "resolved"), _RUNS + " SELECT event_type, start, fired, min(ts) AS resolved FROM (SELECT f.*, s.ts FROM f LEFT JOIN s ON s.event_type = f.event_type AND NOT s.bad AND s.ts > f.fired) GROUP BY ALL", "events")


def _suppressed(e: DataFrame) -> DataFrame:
    alerts = monitoring.sustained(_BAD(e), 30, "event_type").withColumnRenamed("event_type", "rule")
    gaps = e.sparkSession.sql("SELECT 'click' AS rule, TIMESTAMP_NTZ '2024-01-05' AS from_ts, TIMESTAMP_NTZ '2024-01-20' AS to_ts")
    return monitoring.unsuppressed(alerts, gaps).select("rule", "fired")


add("i10_suppression", _suppressed, _RUNS + " SELECT event_type AS rule, fired FROM f WHERE NOT (event_type = 'click' AND fired >= TIMESTAMP '2024-01-05' AND fired < TIMESTAMP '2024-01-20')", "events")
_ALERTS = lambda e: monitoring.with_resolution(_BAD(e), monitoring.sustained(_BAD(e), 30, "event_type"), "event_type").withColumnsRenamed({"event_type": "rule"}).withColumn("severity", F.when(F.col("rule") == "error", "critical").otherwise("warning"))
add("i11_history", lambda e: monitoring.alert_history(_ALERTS(e), 20).select("rule", "fired", "severity"), _RUNS + " SELECT event_type AS rule, fired, CASE WHEN event_type = 'error' THEN 'critical' ELSE 'warning' END AS severity FROM f ORDER BY fired DESC, event_type LIMIT 20", "events")
add("i11_active", lambda e: monitoring.active_by_severity(_ALERTS(e)), _RUNS + " SELECT CASE WHEN event_type = 'error' THEN 'critical' ELSE 'warning' END AS severity, count(*) AS n FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.event_type = f.event_type AND NOT s.bad AND s.ts > f.fired) GROUP BY 1", "events")
_AS_PRESET = {"error": "ticket_search", "click": "data_analysis", "view": "authentication", "purchase": "cpu_percent", "signup": "memory_percent"}
_PRESET_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _AS_PRESET.items()) + " ELSE event_type END"


def _presets(e: DataFrame) -> DataFrame:
    """The preset rules over events that go by the presets' metrics."""
    rules = monitoring.preset_rules(e.sparkSession)
    named = e.withColumn("event_type", C.lookup(F.col("event_type"), _AS_PRESET, F.col("event_type")))
    ops = monitoring.as_operations(e).withColumn("operation", C.lookup(F.col("operation"), _AS_PRESET, F.col("operation")))
    slow = monitoring.performance_alerts(monitoring.operation_stats(ops), rules).select("name", F.col("operation").alias("metric"), F.lit(1).cast("long").alias("n"))
    over = monitoring.threshold_alerts(named.select(F.col("event_type").alias("metric"), "value"), rules).groupBy("name", "metric").agg(F.count("*").alias("n"))
    return slow.unionByName(over)


add(
    "i12_presets",
    _presets,
    f""", ev AS (SELECT *, {_PRESET_SQL} AS metric FROM events),
    om AS (SELECT metric, count(*) AS n, avg(value) AS ms, count(*) FILTER (event_type = 'error') / count(*) AS bad FROM ev GROUP BY 1)
    SELECT name, metric, CAST(1 AS BIGINT) AS n
    FROM om JOIN (VALUES ('slow_ticket_search', 'ticket_search', 10000.0), ('slow_data_analysis', 'data_analysis', 30000.0), ('high_error_rate_authentication', 'authentication', CAST('inf' AS DOUBLE))) v(name, metric, most) USING (metric)
    WHERE n >= 10 AND (ms > most OR bad > 0.05)
    UNION ALL
    SELECT name, metric, count(*) FROM ev JOIN (VALUES ('high_cpu_usage', 'cpu_percent', 80.0), ('high_memory_usage', 'memory_percent', 85.0), ('high_disk_usage', 'disk_usage_percent', 90.0)) v(name, metric, most) USING (metric)
    WHERE value > most GROUP BY name, metric""",
    "events",
)
add("i13_call_stats", _O(monitoring.call_stats), "SELECT operation, count(*) AS total_calls, round(avg(duration_ms), 6) AS avg_ms, round(min(duration_ms), 6) AS min_ms, round(max(duration_ms), 6) AS max_ms, round(100.0 * count(*) FILTER (success) / count(*), 6) AS success_rate FROM ops GROUP BY 1", "events")
add("i14_health", lambda e: monitoring.health(e.groupBy(F.col("event_type").alias("name")).agg((F.avg("value") < 20).alias("ok"))), "SELECT CASE WHEN bool_and(ok) THEN 'healthy' ELSE 'unhealthy' END AS status, coalesce(string_agg(name, '|' ORDER BY name) FILTER (NOT ok), '') AS failed FROM (SELECT event_type AS name, avg(value) < 20 AS ok FROM events GROUP BY 1)", "events")
add("i15_summary", lambda e: monitoring.metric_summary(e.withColumn("at", F.struct("ts", "event_id")), "event_type", "value", "at"), "SELECT event_type, count(value) AS n, round(avg(value), 6) AS avg_value, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, round(arg_max(value, (ts, event_id)), 6) AS latest FROM events GROUP BY 1", "events")
add("i16_throughput", lambda e: monitoring.throughput(e.groupBy("user_id").agg(F.count("*").alias("n_rows"), F.sum("value").alias("seconds"))), "SELECT count(*) AS runs, CAST(sum(n) AS BIGINT) AS total_rows, round(avg(s), 6) AS avg_seconds, round(avg(n / nullif(s, 0)), 6) AS avg_rows_per_s, round(max(n / nullif(s, 0)), 6) AS max_rows_per_s FROM (SELECT user_id, count(*) AS n, sum(value) AS s FROM events GROUP BY 1)", "events")
add("i17_audit", lambda e: monitoring.audit_counts(e.select(F.format_string("action=%s, user=u%d", "event_type", "user_id").alias("line"))), "SELECT event_type AS action, 'u' || user_id AS user, count(*) AS n FROM events GROUP BY ALL", "events")

# jobs
add("j4_periods", lambda t: sla.compare_periods(t, AS_OF, 365),
    ", q AS (SELECT *, created_date > TIMESTAMP '2001-08-02' - INTERVAL 365 DAY AND created_date <= TIMESTAMP '2001-08-02' AS a, created_date > TIMESTAMP '2001-08-02' - INTERVAL 730 DAY AND created_date <= TIMESTAMP '2001-08-02' - INTERVAL 365 DAY AS b FROM t), m AS (SELECT count(*) FILTER (a) AS ct, count(*) FILTER (b) AS pt, count(*) FILTER (a AND done) AS cr, count(*) FILTER (b AND done) AS pr, avg(h) FILTER (a AND h > 0) AS ch, avg(h) FILTER (b AND h > 0) AS ph FROM q) SELECT ct AS current_total, pt AS previous_total, cr AS current_resolved, pr AS previous_resolved, round(ch, 6) AS current_hours, round(ph, 6) AS previous_hours, round(coalesce((ct - pt) * 100.0 / nullif(pt, 0), 0), 6) AS total_change, round(coalesce((cr - pr) * 100.0 / nullif(pr, 0), 0), 6) AS resolved_change, round(coalesce((ch - ph) * 100.0 / nullif(ph, 0), 0), 6) AS hours_change FROM m")
_GRID = lambda r: ", r AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in r.items()) + ') v("range", days)) SELECT team, "range", count(*) AS total, count(*) FILTER (done) AS resolved, round(avg(h) FILTER (h > 0), 6) AS avg_hours FROM t JOIN r ON age / 24 >= 0 AND age / 24 <= days GROUP BY ALL'
add("j5_grid", lambda t: sla.grid(t, {"1y": 365, "2y": 730, "4y": 1460}, AS_OF), _GRID({"1y": 365, "2y": 730, "4y": 1460}))
add("j6_runs", lambda t: sla.run_summary(t.groupBy(C.or_unassigned("resolver_group").alias("team"), "severity").agg((F.count("*") > 600).alias("ok"))), "SELECT count(*) AS total, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, count(DISTINCT team) AS teams, round(100.0 * count(*) FILTER (ok) / count(*), 6) AS rate FROM (SELECT team, severity, count(*) > 600 AS ok FROM t GROUP BY ALL)")
add("j7_windows", lambda t: jobs.period_and_grid(t, AS_OF), _GRID({"7d": 7, "30d": 30, "90d": 90}))
_LONG = lambda key: (lambda t: M.to_long(M.distribution(t, key).select(key, "n"), "n", key))
add("j8_combine", lambda t: jobs.combine(_LONG("status")(t), _LONG("severity")(t)), "SELECT 'n.' || status AS metric, 'n' AS key, CAST(count(*) AS VARCHAR) AS value FROM t GROUP BY status UNION ALL SELECT 'n.' || severity, 'n', CAST(count(*) AS VARCHAR) FROM t GROUP BY severity")
add("j8_compare", lambda t: jobs.compare(_LONG("severity")(t), _LONG("severity")(t.where("status = 'Open'"))), "SELECT 'n.' || severity AS metric, 'n' AS key, CAST(count(*) AS VARCHAR) AS a, CAST(nullif(count(*) FILTER (status = 'Open'), 0) AS VARCHAR) AS b, CAST(nullif(count(*) FILTER (status = 'Open'), 0) - count(*) AS DOUBLE) AS difference FROM t GROUP BY severity")
add("j8_aggregate", lambda t: jobs.aggregate(_LONG("severity")(t), _LONG("severity")(t)), "SELECT 'n.' || severity AS metric, 'n' AS key, CAST(2 * count(*) AS DOUBLE) AS value, 2::BIGINT AS n_reports FROM t GROUP BY severity")
_SLA = "CASE severity WHEN 'SEV_1' THEN 4 WHEN 'SEV_2' THEN 24 WHEN 'SEV_3' THEN 72 WHEN 'SEV_4' THEN 168 WHEN 'SEV_5' THEN 720 ELSE 24 END"
_X = f", x AS (SELECT *, coalesce(h, age) AS hours, {_SLA} AS sla FROM t)"
add("j12_sla", lambda t: sla.compliance(t, AS_OF, 720), _X + " SELECT count(*) AS total, count(*) FILTER (hours <= 720) AS compliant, round(100.0 * count(*) FILTER (hours <= 720) / count(*), 6) AS rate FROM x")
add("j13_sla_by_severity", lambda t: sla.compliance_by_severity(t, AS_OF), _X + " SELECT severity, CAST(sla AS INTEGER) AS sla_hours, count(*) AS total, count(*) FILTER (hours <= sla) AS compliant, round(count(*) FILTER (hours <= sla) / count(*), 6) AS rate FROM x GROUP BY severity, sla")
add("j14_breaches", lambda t: sla.breach_summary(t, AS_OF), _X + " SELECT count(*) AS n, round(avg(hours - sla), 6) AS avg_over, round(max(hours - sla), 6) AS max_over, arg_max(id, (hours - sla, id)) AS worst_id FROM x WHERE hours > sla")
add("j14_by_assignee", lambda t: sla.breaches_by_assignee(t, AS_OF), _X + " SELECT who AS assignee, count(*) AS n FROM x WHERE hours > sla GROUP BY 1")
_VEL = ", y AS (SELECT {k} greatest(0, ceil(age / (24 * {d})) - 1) AS back FROM t WHERE done), z AS (SELECT {k} " + ", ".join(f"count(*) FILTER (back = {i}) AS sprint_{i}" for i in range(6)) + " FROM y WHERE back <= 5 {g}), v AS (SELECT *, (sprint_1 + sprint_2 + sprint_3 + sprint_4 + sprint_5) / 5 AS m, (sprint_1 + sprint_2 + sprint_3) / 3 AS rec, (sprint_4 + sprint_5) / 2 AS old FROM z)"
_TREND = "CASE WHEN rec > old * 1.1 THEN 'improving' WHEN rec < old * 0.9 THEN 'declining' ELSE 'stable' END"
add("j15_velocity", lambda t: sla.velocity(t, AS_OF, 180), _VEL.format(k="", d=180, g="") + f" SELECT sprint_0, sprint_1, sprint_2, sprint_3, sprint_4, sprint_5, round(m, 6) AS average, {_TREND} AS trend, round(CASE WHEN m > 0 THEN greatest(0, least(1, 1 - sqrt(((sprint_1 - m)^2 + (sprint_2 - m)^2 + (sprint_3 - m)^2 + (sprint_4 - m)^2 + (sprint_5 - m)^2) / 5) / m)) ELSE 0 END, 6) AS consistency FROM v")
add("j16_dashboard", lambda t: sla.dashboard(t, AS_OF), _X + _VEL.format(k="team,", d=14, g="GROUP BY team") + f" SELECT a.*, coalesce(sprint_0, 0) AS current_velocity, round(coalesce(m, 0), 6) AS average_velocity, CASE WHEN m IS NOT NULL THEN {_TREND} END AS velocity_trend FROM (SELECT team AS resolver_group, count(*) AS total, count(*) FILTER (done) AS resolved, round(count(*) FILTER (hours <= sla) / count(*), 6) AS sla_rate, round(avg(h), 6) AS avg_hours FROM x GROUP BY 1) a LEFT JOIN v ON v.team = a.resolver_group")
add("j17_registry", lambda t: jobs.METRICS.calculate("resolution_by_severity", t), ORACLES["e3_resolution_by_severity"].split("WITH ", 1)[1].replace(VIEW, "", 1).strip())
add("j18_trend_registry", lambda t: jobs.TRENDS.calculate("seasonality", t), ORACLES["g10_seasonality"].split("WITH ", 1)[1].replace(VIEW, "", 1).strip())
add("j19_statistics", lambda e: registry.statistics(e, "value", "user_id"), "SELECT 'value' AS \"column\", count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS min, round(quantile_cont(value, 0.5), 6) AS median, round(max(value), 6) AS max FROM events UNION ALL SELECT 'user_id', count(user_id), round(avg(user_id), 6), round(stddev_samp(user_id), 6), min(user_id), quantile_cont(user_id, 0.5), max(user_id) FROM events", "events")
add("j19_distributions", lambda t: registry.distributions(t, "status", "severity"), "SELECT 'status' AS \"column\", status AS value, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM t GROUP BY 2")


def _streamed(spark: SparkSession, sf_dir: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The events as a stream, read to its end: the last state of an aggregate, as its batches write it to the shared folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, as a stream's source is a folder or a pattern of files
    rows = stream.read(spark, f"{sf_dir}/events.parque[t]", schema, files=8)
    at = shared_folder(spark)
    result = of(rows)
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/rows")
    result.writeStream.foreachBatch(write).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{at}/state").start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{at}/rows")


def _stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily statistics of each operation."""
    rows = _streamed(spark, sf_dir, lambda e: stream.windowed_stats(monitoring.as_operations(e), "1 day"))
    return rounded(rows.select(F.to_date("start").alias("day"), "operation", "n", "n_success", "avg_ms", "min_ms", "max_ms"))


def _stream_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each operation over the last two days, every day."""
    rows = _streamed(spark, sf_dir, lambda e: stream.windowed_stats(monitoring.as_operations(e), "2 days", "1 day"))
    return rounded(rows.select(F.to_date("end").alias("day"), "operation", "n", "avg_ms", "max_ms"))


def _stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_streamed(spark, sf_dir, stream.daily_volume))


QUERIES["g1_stream_daily"] = _stream_daily
ORACLES["g1_stream_daily"] = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1"
QUERIES["i3_stream_trailing"] = _stream_trailing
ORACLES["i3_stream_trailing"] = f"""WITH {VIEW}
    SELECT CAST(CAST(ts AS DATE) + k AS VARCHAR) AS day, operation, count(*) AS n, round(avg(duration_ms), 6) AS avg_ms, round(max(duration_ms), 6) AS max_ms
    FROM ops, (VALUES (1), (2)) v(k) GROUP BY ALL"""
QUERIES["i1_stream_stats"] = _stream_stats
ORACLES["i1_stream_stats"] = f"WITH {VIEW} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, operation, count(*) AS n, count(*) FILTER (success) AS n_success, round(avg(duration_ms), 6) AS avg_ms, round(min(duration_ms), 6) AS min_ms, round(max(duration_ms), 6) AS max_ms FROM ops GROUP BY ALL"

from tidemark import catalog_broken, catalog_io, catalog_streams  # noqa: E402, F401  (adds the rows that break rules, those that write and read back, and those of streams)

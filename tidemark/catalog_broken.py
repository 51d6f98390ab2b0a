"""Registered queries whose rows break the rules, derived from the tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import AS_OF, ORACLES, QUERIES, VIEW, _danger_sql, _q, rounded
from tidemark.functions import columns as C
from tidemark.operators import clean, quality, trends, validation
from tidemark.plans import jobs
from tidemark.sources import tickets as S

#: How a good ticket becomes a broken one; read by both engines.
_BREAKS = {
    "id": "CASE n % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE id END",
    "status": "CASE n % 11 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN ' DONE' ELSE status END",
    "severity": "CASE n % 13 WHEN 0 THEN NULL WHEN 1 THEN 'Urgent' ELSE severity END",
    "created_date": "CASE n % 5 WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP '2030-01-01 00:00:00' ELSE created_date END",
    "updated_date": "CASE n % 3 WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP '1990-01-01 00:00:00' ELSE updated_date END",
}
_BROKEN = f"""
k AS (SELECT *, CAST(substr(id, 2) AS INTEGER) AS n FROM t0),
b AS (SELECT title, assignee, resolved_date, {", ".join(f"{e} AS {c}" for c, e in _BREAKS.items())} FROM k),
i AS (SELECT *, concat_ws('|', CASE WHEN id IS NULL OR id = '' THEN 'missing_or_invalid_id' END, CASE WHEN created_date IS NULL THEN 'missing_or_invalid_created_date' END,
    CASE WHEN status IS NULL OR status = '' THEN 'missing_status' END, CASE WHEN updated_date < created_date THEN 'updated_date_before_created_date' END,
    CASE WHEN resolved_date < created_date THEN 'resolved_date_before_created_date' END, CASE WHEN created_date > TIMESTAMP '2001-08-02' THEN 'future_created_date' END) AS issues FROM b),
c AS (SELECT * REPLACE (least(created_date, CASE WHEN created_date IS NOT NULL THEN TIMESTAMP '2001-08-02' END) AS created_date) FROM i),
f AS (SELECT * REPLACE (coalesce(CASE WHEN updated_date < created_date THEN created_date ELSE updated_date END, created_date) AS updated_date,
    CASE WHEN resolved_date < created_date THEN created_date ELSE resolved_date END AS resolved_date, coalesce(nullif(status, ''), 'Open') AS status, coalesce(severity, 'SEV_3') AS severity) FROM c),
s AS (SELECT * REPLACE (CASE status WHEN ' DONE' THEN 'Resolved' ELSE status END AS status, CASE severity WHEN 'Urgent' THEN 'SEV_1' ELSE severity END AS severity) FROM f)"""
_SHOWN = ("title", "id", "status", "severity", "created_date", "updated_date", "resolved_date")


def _broken(t: DataFrame) -> DataFrame:
    """Tickets, some without id, status, severity or creation, some from the future, some updated too early."""
    n = t.withColumn("n", F.substring("id", 2, 10).cast("int"))
    return n.select(*[F.expr(_BREAKS[c].replace("TIMESTAMP", "TIMESTAMP_NTZ")).alias(c) if c in _BREAKS else F.col(c) for c in t.columns])


def add(name: str, run: Callable[[DataFrame], DataFrame], sql: str, source: str = "tickets") -> None:
    """Registers a query over broken tickets or one of the tables."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = _broken(S.order_tickets(spark, sf_dir)) if source == "tickets" else spark.read.parquet(f"{sf_dir}/{source}.parquet")
        return rounded(run(table))

    QUERIES[name] = query
    ORACLES[name] = f"WITH {VIEW}, {_BROKEN} {sql}" if source == "tickets" else sql


# cleaning
_ALL = ", ".join(_SHOWN)
add("d1_broken", lambda t: clean.checked(t, AS_OF).select("title", "issues", "is_valid"), "SELECT title, issues, issues = '' AS is_valid FROM i")
add("d2_broken", lambda t: clean.issue_counts(t, AS_OF), "SELECT issue, count(*) AS n FROM (SELECT unnest(string_split(issues, '|')) AS issue FROM i WHERE issues <> '') GROUP BY 1")
add("d3_broken", lambda t: clean.lightly_valid(t).select("title", "id"), "SELECT title, id FROM b WHERE id <> '' AND created_date IS NOT NULL AND status <> ''")
add("d8_d10_broken", lambda t: clean.repair(t, AS_OF).select(*_SHOWN), f"SELECT {_ALL} FROM f")
add("d11_broken", lambda t: clean.require(t, ["id", "created_date", "status", "severity"]).select(*_SHOWN), f"SELECT {_ALL} FROM (SELECT * REPLACE (coalesce(status, 'Open') AS status, coalesce(severity, 'SEV_3') AS severity) FROM b WHERE id IS NOT NULL AND created_date IS NOT NULL)")
add("d12_broken", lambda t: clean.process(t, AS_OF).select(*_SHOWN), f"SELECT {_ALL} FROM s WHERE issues = ''")
add("d13_broken", lambda t: clean.repair_first(t, AS_OF).select(*_SHOWN), f"SELECT {_ALL} FROM s WHERE id <> '' AND created_date IS NOT NULL")
add(
    "d15_nested",
    lambda t: clean.prune(t.select("title", F.array(F.lit(" a "), F.lit("  "), "id", "status").alias("tags"), F.create_map(F.lit("id"), "id", F.lit("status"), "status").alias("more"))).select(
        "title", "tags", F.size("more").alias("n"), F.col("more")["id"].alias("id"), F.col("more")["status"].alias("status")
    ),
    "SELECT title, concat_ws('|', 'a', id, status) AS tags, CAST(id IS NOT NULL AS INTEGER) + CAST(status IS NOT NULL AS INTEGER) AS n, id, status FROM (SELECT title, nullif(trim(id), '') AS id, nullif(trim(status), '') AS status FROM b)",
)
add(
    "k6_broken",
    quality.light,
    """SELECT *, complete_records * 100.0::DOUBLE / total AS quality_score FROM (SELECT count(*) AS total, count(*) FILTER (id <> '' AND created_date IS NOT NULL AND status <> '') AS complete_records,
    count(*) FILTER (coalesce(id, '') = '') AS missing_id, count(*) FILTER (created_date IS NULL) AS missing_created_date, count(*) FILTER (coalesce(status, '') = '') AS missing_status FROM b)""",
)

# formats and verdicts
_ID = "CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN repeat('A', 60) WHEN 3 THEN 'T;1' WHEN 4 THEN 'T-' || CAST(event_id AS VARCHAR(20)) WHEN 5 THEN ' abcde7 ' WHEN 6 THEN 'Q12 or' ELSE 'TOOLONGNAME' || CAST(event_id AS VARCHAR(20)) END"
_TITLE = "CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN repeat('ab ', 200) WHEN 2 THEN repeat('a', 1200) WHEN 3 THEN '<script>x</script>' ELSE '' END"
_STATUS = "CASE event_id % 3 WHEN 0 THEN 'In Progress' WHEN 1 THEN 'Open!' ELSE NULL END"
_WHO = "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'user.1' ELSE 'no such user' END"
_WHEN = "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '2024-01-02' WHEN 3 THEN '2024-01-02T03:04:05Z' WHEN 4 THEN '2024-01-02T03:04:05.123+01:00' ELSE '02.01.2024' END"
_FIELDS = {"id": _ID, "title": _TITLE, "status": _STATUS, "assignee": _WHO, "createDate": _WHEN}


def _errors_sql(x: str, kind: str, before: str = "") -> str:
    """The errors of a field as a list in SQL."""
    bad = " OR ".join(f"regexp_matches({x}, '(?is){_q(p)}')" for p in validation.INJECTION)
    tests = [(f"trim(coalesce({x}, '')) = ''", "empty"), (f"length({x}) > {validation.LENGTHS.get(kind, 1000)}", "too_long")]
    if kind in validation.FORMATS:
        tests.append((f"NOT regexp_matches(coalesce({x}, ''), '{_q(validation.FORMATS[kind])}')", "bad_format"))
    return ", ".join(f"CASE WHEN {t} THEN '{before}{n}' END" for t, n in [*tests, (bad, "dangerous")])


_EVENTS = f"SELECT event_id, {', '.join(f'{e} AS {c}' for c, e in _FIELDS.items())} FROM events"
_wrong = lambda e: e.select("event_id", *[F.expr(x).alias(c) for c, x in _FIELDS.items()])
add("c17_forms", lambda e: _wrong(e).select("event_id", C.id_is_valid("id").alias("valid")), f"SELECT event_id, coalesce(regexp_matches(upper(trim(id)), '^[A-Z]{{1,5}}-?[0-9]{{1,10}}$|^[TP][0-9]{{6,10}}$|^V[0-9]{{10}}$'), false) AS valid FROM ({_EVENTS})", "events")
add(
    "d16_broken",
    lambda e: _wrong(e).select("event_id", *[validation.field_errors(c, k).alias(f"{c}_errors") for c, k in (("id", "ticket_id"), ("title", "safe_text"), ("assignee", "assignee"))]),
    f"SELECT event_id, {', '.join(f'concat_ws(chr(124), {_errors_sql(c, k)}) AS {c}_errors' for c, k in (('id', 'ticket_id'), ('title', 'safe_text'), ('assignee', 'assignee')))} FROM ({_EVENTS})",
    "events",
)
_DATED = f"regexp_matches(\"createDate\", '{validation.FORMATS['datetime_iso']}') OR regexp_matches(\"createDate\", '{validation.FORMATS['date_iso']}')"
add(
    "d17_broken",
    lambda e: _wrong(e).select("*", F.lit("x").alias("description"), F.lit("").alias("lastUpdatedDate"), F.lit(None).cast("string").alias("lastResolvedDate")).select("event_id", validation.raw_errors().alias("errors")),
    f"""SELECT event_id, concat_ws('|', {_errors_sql('id', 'ticket_id', 'id:')}, {_errors_sql('title', 'title', 'title:')}, {_errors_sql('status', 'status', 'status:')},
    CASE WHEN assignee <> '' THEN nullif(concat_ws('|', {_errors_sql('assignee', 'assignee', 'assignee:')}), '') END, CASE WHEN "createDate" <> '' AND NOT ({_DATED}) THEN 'createDate:bad_format' END) AS errors FROM ({_EVENTS})""",
    "events",
)
_SAYS = {"a": "source || CASE doc_id % 4 WHEN 0 THEN ' < x' WHEN 1 THEN ' drop table x' ELSE '' END", "b": "source || CASE doc_id % 5 WHEN 0 THEN ' > y' WHEN 1 THEN ' $(id)' ELSE '' END", "origin": "CASE doc_id % 2 WHEN 0 THEN 'external_api' ELSE 'user' END"}
_rank_sql = lambda c: f"CASE WHEN len({_danger_sql(c)}) > 0 THEN 3 WHEN regexp_matches({c}, '{validation.SUSPICIOUS}') THEN 2 ELSE 1 END"


def _told(d: DataFrame) -> DataFrame:
    d = d.select("doc_id", *[F.expr(x).alias(c) for c, x in _SAYS.items()])
    d = d.select("doc_id", "origin", validation.worst(validation.verdict("a"), validation.verdict("b")).alias("verdict"))
    return d.select("doc_id", "verdict", validation.in_context(F.col("verdict"), F.col("origin")).alias("outside"))


add(
    "d22_contexts",
    _told,
    f"""SELECT doc_id, v[r] AS verdict, v[CASE WHEN r = 2 AND origin = 'external_api' THEN 3 ELSE r END] AS outside
    FROM (SELECT doc_id, origin, ['VALID', 'SUSPICIOUS', 'INVALID'] AS v, greatest({_rank_sql('a')}, {_rank_sql('b')}) AS r FROM (SELECT doc_id, {', '.join(f'{e} AS {c}' for c, e in _SAYS.items())} FROM documents))""",
    "documents",
)


# patterns
def _few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly patterns of the earliest ids and of all; too few tickets have none."""
    t = S.order_tickets(spark, sf_dir).withColumn("n", F.substring("id", 2, 10).cast("int"))
    of = lambda k: trends.weekly_consistency(t.where(F.col("n") < k)).select(F.lit(k).alias("below"), "tickets", "consistency", "pattern")
    return rounded(jobs.combine(*map(of, (10, 100, 1000, 10**9))))


QUERIES["g12_few"] = _few
ORACLES["g12_few"] = f"""WITH {VIEW}, k AS (SELECT *, CAST(substr(id, 2) AS INTEGER) AS n FROM t),
    w1 AS (SELECT below, isodow(created_date) AS dow, count(*) AS n FROM k JOIN (VALUES (10), (100), (1000), (1000000000)) v(below) ON k.n < below GROUP BY ALL),
    w2 AS (SELECT below, CAST(sum(n) AS BIGINT) AS tickets, 1 - least(stddev_samp(n) / avg(n) / 2, 1.0) AS x FROM w1 GROUP BY 1)
    SELECT below, tickets, round(x, 6) AS consistency, CASE WHEN x > 0.7 THEN 'strong' WHEN x > 0.4 THEN 'moderate' ELSE 'weak' END AS pattern FROM w2 WHERE tickets >= 14"""


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trends.pattern_summary(S.order_tickets(spark, sf_dir)))


QUERIES["g22_told"] = _patterns
ORACLES["g22_told"] = f"""SELECT pattern_count, anomaly_count, concat_ws('|', CASE WHEN pattern = 'strong' THEN 'Strong weekly pattern detected' END, CASE WHEN class = 'strong_growth' THEN 'Strong growth trend identified' END) AS key_patterns,
    concat_ws('|', CASE WHEN class = 'strong_growth' THEN 'Monitor capacity for growing ticket volume' END, CASE WHEN anomaly_count > 5 THEN 'High number of anomalies detected - investigate unusual patterns' END) AS attention_areas
    FROM ({ORACLES['g22_patterns']}) p, (SELECT max(pattern) AS pattern FROM ({ORACLES['g12_consistency']})) w, (SELECT max(class) AS class FROM ({ORACLES['g16_weekly_growth']})) g"""

"""Reading, mapping and writing tickets. (A)"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import columns as C

_TIMES = ("created_date", "updated_date", "resolved_date")
TICKETS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "title", "description", "status", "severity")]
    + [T.StructField(n, T.TimestampNTZType()) for n in _TIMES]
    + [T.StructField(n, T.StringType()) for n in ("assignee", "resolver_group")]
    + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)
#: The nested payload.
RAW = (
    "id string, title string, description string, status string, severity string, createDate string, lastUpdatedDate string, lastResolvedDate string, assignee string, tags array<string>, source string, externalId string, "
    "extensions struct<tt: struct<assignedGroup: string, impact: string, urgency: string, category: string, subcategory: string>>"
)

#: Statuses, severities, and their synonyms at ingest.
STATUSES = ("Open", "In Progress", "Resolved", "Closed", "Pending", "Assigned", "Researching", "Work In Progress")
SEVERITIES = ("SEV_1", "SEV_2", "SEV_2.5", "SEV_3", "SEV_4", "SEV_5")
STATUS_SYNONYMS = {
    "OPEN": "Open", "NEW": "Open", "ASSIGNED": "In Progress", "IN_PROGRESS": "In Progress", "WORK_IN_PROGRESS": "In Progress", "RESEARCHING": "In Progress",
    "PENDING": "In Progress", "RESOLVED": "Resolved", "CLOSED": "Closed", "CANCELLED": "Closed", "CANCELED": "Closed",
}
SEVERITY_SYNONYMS = {f"{form}{i}": f"SEV_{i}" for i in range(1, 6) for form in ("SEV_", "SEV", "SEVERITY_")} | {"CRITICAL": "SEV_1", "HIGH": "SEV_2", "MEDIUM": "SEV_3", "LOW": "SEV_4", "LOWEST": "SEV_5"}


def map_status(c: str | Column) -> Column:
    """Known synonyms, else Open. (A4)"""
    return C.lookup(F.upper(F.replace(F.trim(C.column(c)), F.lit(" "), F.lit("_"))), STATUS_SYNONYMS, F.lit("Open"))


def map_severity(c: str | Column) -> Column:
    """Known synonyms, else SEV_5. (A5)"""
    return C.lookup(F.upper(F.trim(C.column(c))), SEVERITY_SYNONYMS, F.lit("SEV_5"))


def parse_time(c: str | Column) -> Column:
    """ISO time to UTC; text without an offset is UTC, what can't be read is null. (A3)"""
    return F.try_to_timestamp(F.nullif(C.column(c), F.lit(""))).cast("timestamp_ntz")


def map_raw(raw: DataFrame) -> DataFrame:
    """Payload rows to tickets; rows without id, title or status are left out (see rejected_raw). (A1, A2)"""
    tt = lambda f: F.col(f"extensions.tt.{f}")
    metadata = {
        "resolver_group": tt("assignedGroup"), "impact": tt("impact"), "urgency": tt("urgency"), "category": tt("category"),
        "subcategory": tt("subcategory"), "source": F.col("source"), "external_id": F.col("externalId"),
    }
    return raw.where("id is not null and title is not null and status is not null").select(
        "id", "title", F.coalesce("description", F.lit("")).alias("description"), map_status("status").alias("status"), map_severity("severity").alias("severity"),
        parse_time("createDate").alias("created_date"), parse_time("lastUpdatedDate").alias("updated_date"), parse_time("lastResolvedDate").alias("resolved_date"),
        "assignee", tt("assignedGroup").alias("resolver_group"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.map_filter(F.create_map(*[x for k, v in metadata.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull()).alias("metadata"),
    )


def rejected_raw(raw: DataFrame) -> DataFrame:
    """Payload rows that can't be mapped, with the fields they lack."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("id", "title", "status")]))
    return raw.withColumn("missing", missing).where(F.size("missing") > 0)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW).json(path)


def _accepted() -> Column:
    return F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)) & F.coalesce("severity", F.lit("SEV_5")).isin(*SEVERITIES)


def read_tickets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Canonical records; those with an unknown status or severity are left out (see rejected_tickets)."""
    t = spark.read.schema(TICKETS).format(fmt).load(path)
    return t.where(_accepted()).withColumns(
        {"severity": F.coalesce("severity", F.lit("SEV_5")), "description": F.coalesce("description", F.lit("")), "tags": F.coalesce("tags", F.array().cast("array<string>"))}
    )


def rejected_tickets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Records that read_tickets leaves out, with the fields that are wrong."""
    wrong = F.array_compact(F.array(F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status"), F.when(~F.coalesce("severity", F.lit("SEV_5")).isin(*SEVERITIES), "severity")))
    return spark.read.schema(TICKETS).format(fmt).load(path).where(~_accepted()).withColumn("wrong", wrong)


def read_jdbc(spark: SparkSession, url: str, table: str, predicate: Column | None = None, **options: str) -> DataFrame:
    """A relational table with the predicate pushed down; give partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    t = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return t if predicate is None else t.where(predicate)


def read_chunks(spark: SparkSession, path: str, files: int = 100, fmt: str = "json", schema: T.StructType | str = TICKETS) -> DataFrame:
    """A stream over a folder, some files at a time."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files).load(path)


def to_records(t: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return t.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def by_id(t: DataFrame, wanted: str) -> DataFrame:
    return t.where(F.col("id") == wanted)


def details(t: DataFrame, as_of: datetime | str) -> DataFrame:
    """All columns with age and resolution hours. (A10)"""
    return t.withColumns({"is_resolved": C.is_resolved(), "age_days": C.age_days(as_of), "resolution_hours": C.resolution_hours()})


def count_by_status(t: DataFrame) -> DataFrame:
    return t.groupBy("status").agg(F.count("*").alias("n"))


def page(t: DataFrame, size: int = 100, offset: int = 0) -> tuple[DataFrame, Callable[[], int | None]]:
    """A page by creation time and id, and a function that gives the offset of the next, None after a page that isn't full.

    The function looks at one row only, the page's last, and that only when it is
    called; :func:`page_with_token` gives both from one run.
    """
    rows = t.orderBy("created_date", "id").offset(offset).limit(size)
    return rows, lambda: None if t.orderBy("created_date", "id").offset(offset + size - 1).limit(1).isEmpty() else offset + size


def page_with_token(t: DataFrame, size: int = 100, offset: int = 0) -> tuple[list[Row], int | None]:
    """The rows of a page, at most ``size``, on the driver, and the offset of the next: one run for both."""
    rows = t.orderBy("created_date", "id").offset(offset).limit(size).collect()
    return rows, offset + size if len(rows) == size else None


def page_after(t: DataFrame, size: int = 100, created_date: datetime | str | None = None, after_id: str | None = None) -> DataFrame:
    """The page after the last key seen: its cost doesn't grow with its depth, as the key is a pushed filter and no rows are skipped."""
    if created_date is not None:
        at = C.moment(created_date)
        t = t.where((F.col("created_date") > at) | (F.col("created_date") == at) & (F.col("id") > F.lit(after_id)))
    return t.orderBy("created_date", "id").limit(size)


def write_json(long: DataFrame, path: str) -> None:
    """The long form of an analysis as JSON lines."""
    long.write.mode("overwrite").json(path)


def write_csv(long: DataFrame, catalog: DataFrame, path: str) -> None:
    """Metric, Value and Description, from the long form and a metric catalogue."""
    rows = long.join(catalog, long["metric"] == catalog["name"], "left")
    rows.select(F.concat_ws(".", long["metric"], F.nullif("key", F.lit(""))).alias("Metric"), F.col("value").alias("Value"), F.coalesce("description", F.lit("")).alias("Description")).write.mode("overwrite").option("header", True).csv(path)


def export_raw(t: DataFrame, path: str) -> None:
    """The rows beside the analysis, by month so that later reads prune."""
    t.withColumn("month", C.month_label("created_date")).write.mode("overwrite").partitionBy("month").parquet(path)


def order_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets as a view over orders, line items and customers."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    shipped = read("lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    o = read("orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(read("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    finished = F.col("o_orderstatus") == "F"
    later = lambda t, n: F.timestamp_add("HOUR", n.cast("int"), t)
    return o.select(
        F.concat(F.lit("T"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.col("o_orderpriority").alias("description"),
        F.when(finished & (F.col("o_orderkey") % 4 == 0), "Closed").when(finished, "Resolved").when(F.col("o_orderstatus") == "P", "In Progress").otherwise("Open").alias("status"),
        F.concat(F.lit("SEV_"), F.substring("o_orderpriority", 1, 1)).alias("severity"),
        later(F.col("o_orderdate"), F.col("o_orderkey") % 24).alias("created_date"),
        F.col("first_ship").alias("updated_date"),
        F.when(finished, later(F.col("last_ship"), F.col("o_custkey") % 24)).alias("resolved_date"),
        F.when(F.col("o_custkey") % 10 != 0, F.concat(F.lit("user"), (F.col("o_custkey") % 50).cast("string"))).alias("assignee"),
        F.col("c_mktsegment").alias("resolver_group"),
        F.array(F.lower("o_orderpriority"), F.col("c_mktsegment")).alias("tags"),
        F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("metadata"),
    )

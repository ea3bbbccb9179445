"""Raw log source (S1) and the telemetry parse projection (F1).

A raw log record has the shape of a cloud log export:

    timestamp TIMESTAMP, insert_id STRING, severity STRING, log_name STRING,
    resource STRUCT<type STRING, labels STRING(JSON)>, labels STRING(JSON),
    json_payload STRING(JSON), text_payload STRING,
    proto_payload STRUCT<audit_log STRUCT<method_name STRING>>

On a cluster the table is stored partitioned by date and ``resource.type``;
the filters below are plain column predicates so they reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Resource types and log names of the streams.
RT_JOB = "cloud_dataproc_job"
RT_CLUSTER = "cloud_dataproc_cluster"
TELEMETRY_LOG = "projects/your-project/logs/dataproc.job.telemetry"
DRIVER_LOG = "projects/your-project/logs/dataproc.job.driver"
CLUSTER_LOG = "projects/your-project/logs/dataproc.googleapis.com%2Fcluster"
AUDIT_LOG = "projects/your-project/logs/cloudaudit.googleapis.com%2Factivity"
AUTOSCALER_LOG = "projects/your-project/logs/dataproc.googleapis.com%2Fautoscaler"

RAW_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("insert_id", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("log_name", T.StringType()),
    T.StructField("resource", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("labels", T.StringType()),
    ])),
    T.StructField("labels", T.StringType()),
    T.StructField("json_payload", T.StringType()),
    T.StructField("text_payload", T.StringType()),
    T.StructField("proto_payload", T.StructType([
        T.StructField("audit_log", T.StructType([T.StructField("method_name", T.StringType())])),
    ])),
])

# Listener message: every value is a string.
TELEMETRY_FIELDS = [
    "event_type", "event_type_family", "clusterName", "recipeFilename", "layerToLayer",
    "app_start_iso", "app_end_iso", "app_duration_millis", "executor_event", "executor_id",
    "executor_host", "total_no_executors", "current_no_executors", "timestamp_iso",
    "max_executors_seen", "min_executors_seen",
]
TELEMETRY_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in TELEMETRY_FIELDS])


def read_raw_logs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read an exported raw log table with the fixed schema (no inference)."""
    reader = spark.read.schema(RAW_LOG_SCHEMA)
    return reader.json(path) if fmt == "json" else reader.format(fmt).load(path)


#: Partition columns of a stored raw log.
PARTITIONS = ("date", "resource_type")


def with_partitions(logs: DataFrame) -> DataFrame:
    """A raw log with the columns a stored one is partitioned by, its rows dealt by them; tasks get about as much
    each, however large a partition is, so a small partition has few files and a large one many tasks."""
    out = logs.withColumns({"date": F.to_date("timestamp"), "resource_type": F.col("resource.type")})
    return out.hint("rebalance", *PARTITIONS)


def read_stored_logs(spark: SparkSession, path: str) -> DataFrame:
    """A raw log stored by date and resource type; filters and joins on them choose the files that are read."""
    return spark.read.schema(T.StructType([*RAW_LOG_SCHEMA.fields, T.StructField("date", T.DateType()),
                                           T.StructField("resource_type", T.StringType())])).parquet(path)


def of_dates(logs: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows of a stored log whose date is in a table of dates (a calendar, a list of failed days): the join's other
    side chooses at run time which partitions are read."""
    return logs.join(dates.select("date"), "date", "left_semi")


def scan(logs: DataFrame, resource_type: str | None = None,
         log_name_like: str | None = None) -> DataFrame:
    """The raw log view filtered by resource type (the partition column where the log has one) and log-name pattern."""
    out = logs
    if resource_type is not None:
        out = out.filter(F.col("resource_type" if "resource_type" in logs.columns else "resource.type") == resource_type)
    if log_name_like is not None:
        out = out.filter(F.col("log_name").like(log_name_like))
    return out


def label(name: str, labels: str = "resource.labels") -> Column:
    return F.get_json_object(F.col(labels), f"$.{name}")


def parse_ts(c: Column) -> Column:
    """ISO-8601 or ``YYYY-MM-DD HH:MM:SS[.f] UTC``; NULL / 'null' tolerant."""
    s = F.nullif(F.trim(c), F.lit(""))
    s = F.when(F.lower(s) == "null", None).otherwise(s)
    return F.coalesce(F.try_to_timestamp(s),
                      F.try_to_timestamp(F.regexp_replace(s, r"\s+UTC$", "")))


def decode_fields(df: DataFrame, json_col: str, fields: list[str], prefix: str = "") -> DataFrame:
    """Decode top-level JSON fields once per row with ``json_tuple``.

    ``json_tuple`` is a generator: the string is parsed once for all fields,
    and filters on the outputs stay above it.  (With ``from_json`` /
    ``get_json_object`` in a projection, predicate pushdown copies the decode
    into every pushed filter, so the JSON is parsed once per predicate.)
    """
    outs = [f"{prefix}{f}" for f in fields]
    keep = [c for c in df.columns]
    return df.select(*keep, F.json_tuple(F.col(json_col), *fields).alias(*outs))


def once(df: DataFrame, *cols: Column) -> DataFrame:
    """``df`` with more columns that are computed once per row.

    A generator gives them, so that filters on them stay above it.  (In a projection, predicate
    pushdown copies a costly expression, and all that it is made of, into every pushed filter.)
    """
    return df.select("*", F.inline(F.array(F.struct(*cols))))


def parse_telemetry(logs: DataFrame) -> DataFrame:
    """decode the listener message once; typed telemetry rows.

    ``evt_ts = COALESCE(message timestamp, log timestamp)``; integer fields use
    ``try_cast`` (SAFE_CAST): unparsable -> NULL.
    """
    jobs = scan(logs, resource_type=RT_JOB).select(
        "timestamp", "insert_id", F.col("resource.labels").alias("_labels"), "json_payload")
    jobs = decode_fields(jobs, "_labels", ["job_id"])
    jobs = decode_fields(jobs, "json_payload", ["message"], prefix="_")
    m = decode_fields(jobs, "_message", TELEMETRY_FIELDS, prefix="m_")
    m = m.filter(F.col("m_clusterName").isNotNull())
    return m.select(
        F.coalesce(parse_ts(F.col("m_timestamp_iso")), F.col("timestamp")).alias("evt_ts"),
        F.col("insert_id").alias("event_id"),
        F.col("job_id"),
        F.col("m_event_type").alias("event_type"),
        F.col("m_clusterName").alias("cluster_name"),
        F.col("m_recipeFilename").alias("recipe_filename"),
        F.col("m_executor_event").alias("executor_event"),
        F.col("m_current_no_executors").try_cast("bigint").alias("current_no_executors"),
        F.col("m_total_no_executors").try_cast("bigint").alias("total_no_executors"),
        F.col("m_max_executors_seen").try_cast("bigint").alias("max_executors_seen"),
        parse_ts(F.col("m_app_start_iso")).alias("app_start_ts"),
        parse_ts(F.col("m_app_end_iso")).alias("app_end_ts"),
        F.col("m_app_duration_millis").try_cast("bigint").alias("app_duration_millis"),
    )


def runs_from_telemetry(parsed: DataFrame) -> DataFrame:
    """``application_runs``: application_end rows with both endpoints."""
    r = parsed.filter((F.col("event_type") == "application_end")
                      & F.col("app_start_ts").isNotNull() & F.col("app_end_ts").isNotNull())
    return r.select(
        "cluster_name", "recipe_filename", "app_start_ts", "app_end_ts", "app_duration_millis",
        F.concat_ws("|", "cluster_name", "recipe_filename",
                    F.date_format("app_start_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("run_id"),
        "job_id", "evt_ts",
    )


def executor_events_from_telemetry(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("event_type") == "executor_status").select(
        "event_id", "cluster_name", "recipe_filename", "evt_ts", "executor_event",
        "current_no_executors", "total_no_executors", "max_executors_seen")

"""Spark event logs as a source (E1 / E2): one JSON object a line, told apart by ``Event``.

An application's log is one file, or a folder of rolling files ``events_<n>_<app>`` that are
read in the order of n.  A joined log, which ``write_event_log`` writes, holds the lines of many
applications in few files of a folder ``joined_eventlogs``: each line has its application and
roll in front, so the number of files follows the volume and not the number of applications.
A line's place is (roll, file, start of the split, row in it), so lines of one application keep
their order however files are cut into splits.

Lines that are no JSON object or name no event are left out, as are events of other kinds
than those asked for; numbers that can't be read are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Event names and keys of Spark's JSON event log.
LOG_START, ENVIRONMENT = "SparkListenerLogStart", "SparkListenerEnvironmentUpdate"
APP_START, APP_END = "SparkListenerApplicationStart", "SparkListenerApplicationEnd"
EXECUTOR_ADDED, EXECUTOR_REMOVED = "SparkListenerExecutorAdded", "SparkListenerExecutorRemoved"
START_TIME_KEY, APP_NAME_KEY = "spark.app.startTime", "spark.app.name"

#: Folder of joined logs, and what stands between a line's application and roll (JSON, which has no raw tab) and the line.
JOINED, HEAD_END = "joined_eventlogs", "\t"

_KINDS = {EXECUTOR_ADDED: "EXECUTOR_ADDED", EXECUTOR_REMOVED: "EXECUTOR_REMOVED"}


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """app_id, place, event, and the decoded fields of every line below ``path``."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"))
    joined = F.col("_path").contains(f"/{JOINED}/")
    lines = lines.withColumn("_head", F.when(joined, F.substring_index("value", HEAD_END, 1)))
    lines = lines.withColumn("value", F.when(joined, F.substring(F.col("value"), F.length("_head") + 2, F.length("value"))).otherwise(F.col("value")))
    lines = lines.select("value", "_path", "_start", "_row", F.json_tuple("_head", "app", "roll").alias("_app", "_roll"))
    name = F.element_at(F.split("_path", "/"), -1)
    folder = F.regexp_extract("_path", r"/(?:eventlog_v2_|app=)([^/]+)/", 1)
    own = F.when(folder != "", folder).otherwise(F.regexp_replace(name, r"\.(inprogress|lz4|lzf|snappy|zstd|gz)$", ""))
    app = F.when(joined, F.col("_app")).otherwise(own)
    roll = F.when(joined, F.col("_roll")).otherwise(F.regexp_extract("_path", r"/(?:events_|roll=)(-?\d+)[_/]", 1)).try_cast("long")
    place = F.struct(F.coalesce(roll, F.lit(0)).alias("roll"), F.col("_path").alias("file"), F.col("_start").alias("start"),
                     F.col("_row").alias("row"))
    decoded = lines.select(app.alias("app_id"), place.alias("place"), F.json_tuple(
        "value", "Event", "Timestamp", "Executor ID", "App Name", "Spark Properties").alias(
        "event", "timestamp_ms", "executor_id", "app_name", "properties"))
    return decoded.where(F.col("event").isNotNull()).withColumn("timestamp_ms", F.col("timestamp_ms").try_cast("long"))


def app_names(log: DataFrame) -> DataFrame:
    """app_id, cluster_name, recipe_filename of the applications whose name is ``<cluster>/<recipe>``."""
    name = F.coalesce("app_name", F.try_element_at(F.from_json("properties", "map<string,string>"), F.lit(APP_NAME_KEY)))
    named = log.where(F.col("event").isin(APP_START, ENVIRONMENT)).select("app_id", name.alias("name")).where(F.col("name").contains("/"))
    one = named.groupBy("app_id").agg(F.min("name").alias("name"))
    return one.select("app_id", F.substring_index("name", "/", 1).alias("cluster_name"),
                      F.expr("substring(name, instr(name, '/') + 1)").alias("recipe_filename"))


def executor_events_of(log: DataFrame) -> DataFrame:
    """Executor add / remove rows for ``executor_running_counts``: event order is (time, place)."""
    kind = F.when(F.col("event") == EXECUTOR_ADDED, _KINDS[EXECUTOR_ADDED]).otherwise(_KINDS[EXECUTOR_REMOVED])
    rows = log.where(F.col("event").isin(*_KINDS) & F.col("timestamp_ms").isNotNull())
    return rows.select("app_id", "place", "executor_id", F.timestamp_millis("timestamp_ms").alias("evt_ts"),
                       kind.alias("executor_event")).join(app_names(log), "app_id")


def starts_of(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(real starts, starts of the context, ends) as app_id, ts: what the listener heard of an application's life."""
    context = F.try_element_at(F.from_json("properties", "map<string,string>"), F.lit(START_TIME_KEY)).try_cast("long")
    of = lambda event, ms: log.where(F.col("event") == event).select("app_id", F.timestamp_millis(ms).alias("ts")).where("ts is not null")
    return of(APP_START, F.col("timestamp_ms")), of(ENVIRONMENT, context), of(APP_END, F.col("timestamp_ms"))


def _line(event: str, **fields: Column) -> Column:
    return F.to_json(F.struct(F.lit(event).alias("Event"), *[c.alias(k.replace("_", " ")) for k, c in fields.items()]))


def executor_line(kind: Column, ms: Column, executor_id: Column) -> Column:
    added = _line(EXECUTOR_ADDED, Timestamp=ms, Executor_ID=executor_id)
    removed = _line(EXECUTOR_REMOVED, Timestamp=ms, Executor_ID=executor_id, Removed_Reason=F.lit("lost"))
    return F.when(kind == _KINDS[EXECUTOR_ADDED], added).otherwise(removed)


def start_line(ms: Column, name: Column, app_id: Column) -> Column:
    return _line(APP_START, App_Name=name, App_ID=app_id, Timestamp=ms)


def end_line(ms: Column) -> Column:
    return _line(APP_END, Timestamp=ms)


def environment_line(ms: Column, name: Column) -> Column:
    properties = F.struct(ms.cast("string").alias(START_TIME_KEY), name.alias(APP_NAME_KEY))
    return F.to_json(F.struct(F.lit(ENVIRONMENT).alias("Event"), properties.alias("Spark Properties")))


def write_event_log(lines: DataFrame, path: str) -> str:
    """Write rows (app, roll, order columns ``at``, ``line``) as a joined log, in order.

    Ranges of (app, roll, at) are a file each, named in their order, so a long log is split over many tasks and
    its lines still follow each other.
    """
    dealt = lines.repartitionByRange("app", "roll", "at").sortWithinPartitions("app", "roll", "at")
    dealt.select(F.concat(F.to_json(F.struct("app", "roll")), F.lit(HEAD_END), "line").alias("value")).write.text(f"{path}/{JOINED}")
    return path

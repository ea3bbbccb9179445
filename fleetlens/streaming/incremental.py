"""Structured Streaming variants of the event queries (E6, and E1).

Both take every row whenever it arrives: no watermark cuts rows off, so files may come in
any order and the result equals the batch query over what has arrived.

* ``stream_counts`` keeps one count per (window, cluster, event kind) in state; a late row
  raises its window's count again.  State grows with the time span, not with the rows.
* ``stream_executor_counts`` lands the executor events exactly once (file sink) and gives
  the running counts of what has landed, in event time, by the bucketed scan of the batch
  query: a running count is only defined over rows in event order, which no arrival order
  gives.

Work folders lie below ``spark.checkpoint.dir``.  A stream with a name keeps its folder, so
a restarted query goes on from its offsets and state and takes what has been added; its
files must not be replaced, since Spark knows read files by their paths.  Without a name
(the registered queries) the folder is named by the query and the paths, sizes and
modification times of the files there are, so other files at the same paths are read anew.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import binding as B
from ..session import ensure_checkpoint_dir
from ..sources.files import make_folder
from .eventlog import executor_running_counts

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
COUNTS = "window_start timestamp, cluster_name string, executor_event string, events long"
APP = ["cluster_name", "recipe_filename"]


def _workdir(spark: SparkSession, query: str, sf_dir: str, name: str | None) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    files = [] if name else (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{sf_dir}/events*.parquet")
                             .select("path", "length", F.unix_millis("modificationTime").alias("changed")).collect())
    of = repr((sf_dir, name, sorted(tuple(f) for f in files)))
    return f"{base}/streams/{query}-{hashlib.sha256(of.encode()).hexdigest()[:16]}"


def read_events_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
            .option("maxFileAge", "36500d")  # a file is read however old it is
            .option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet"))


def stream_counts(spark: SparkSession, sf_dir: str, window: str = "1 day", name: str | None = None) -> DataFrame:
    """Executor events per (day window, cluster, event kind), incrementally.

    A micro-batch writes the counts it changed to a folder of its number (a retried batch
    writes the same folder again); the last count of a key is its count.
    """
    agg = (B.executor_events(read_events_stream(spark, sf_dir))
           .groupBy(F.window("evt_ts", window).alias("w"), "cluster_name", "executor_event")
           .agg(F.count(F.lit(1)).alias("events")))
    work = _workdir(spark, "stream_counts", sf_dir, name)
    out_dir = make_folder(spark, f"{work}/batches")

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.select(F.col("w.start").alias("window_start"), "cluster_name", "executor_event", "events")
         .write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}"))

    (agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{work}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    res = spark.read.schema(f"{COUNTS}, batch long").option("basePath", out_dir).parquet(out_dir)
    return (res.groupBy("window_start", "cluster_name", "executor_event")
            .agg(F.max_by("events", "batch").alias("events")))


def stream_executor_counts(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """E1 streaming: running executor counts per application over the events landed so far."""
    ev = B.executor_events(read_events_stream(spark, sf_dir)).select(*APP, "event_id", "evt_ts", "executor_event")
    work = _workdir(spark, "stream_executor_counts", sf_dir, name)
    landed = make_folder(spark, f"{work}/events")
    (ev.writeStream.outputMode("append").format("parquet").option("path", landed)
     .option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    counts = executor_running_counts(spark.read.schema(ev.schema).parquet(landed), APP)
    return counts.select(*APP, "event_id", "evt_ts", "executor_event", "current_executors", "max_executors_seen",
                         "min_executors_seen")

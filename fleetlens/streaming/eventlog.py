"""Executor and application telemetry from event rows (E1, E2, E4), batch form.

E1 folds executor add / remove events into running counts per application
(current, max seen, min seen) with the bucketed prefix scan; E2 reconciles the
starts an application is heard of by and builds its lifecycle; E4 is uptime.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.interval import WIDTH, interval_join, key_bucket_widths
from ..operators.scan import bucketed_lead, bucketed_running_sum_extrema, time_bucket

ADDED, REMOVED = "EXECUTOR_ADDED", "EXECUTOR_REMOVED"

# A real start belongs to the context's start before it if it comes within two seconds.
START_TOLERANCE_MS = 2000


def executor_running_counts(events: DataFrame, app: list[str], ts: str = "evt_ts", tie: str = "event_id",
                            bucket_seconds: int = 86400) -> DataFrame:
    """One status row per add / remove event with the running executor
    count and the running max / min of that count for its application."""
    e = events.drop("current_executors", "max_executors_seen", "min_executors_seen") \
        .filter(F.col("executor_event").isin(ADDED, REMOVED))
    # adaptive bucket per application: one day, halved while a bucket would hold
    # more than ~1M events (a busy application is split over many tasks)
    widths = key_bucket_widths(e, app, ts, max_seconds=bucket_seconds)
    e = e.join(widths, app).withColumn("_d", F.when(F.col("executor_event") == ADDED, 1).otherwise(-1)) \
        .withColumn("_b", F.floor(F.unix_micros(ts) / F.col(WIDTH)).cast("long")).drop(WIDTH)
    out = bucketed_running_sum_extrema(e, app, "_b", [ts, tie], "_d", "current_executors",
                                       "max_executors_seen", "min_executors_seen")
    return out.drop("_d", "_b")


def app_lifecycle(runs: DataFrame, status_events: DataFrame, as_of: str | None = None) -> DataFrame:
    """E2 + E4: start, end, duration, final status (latest status event inside the
    run window, else UNKNOWN) and uptime (end, or ``as_of`` when still running)."""
    st = status_events.select("cluster_name", "recipe_filename", F.col("log_ts").alias("status_ts"),
                              "insert_id", "status")
    j = interval_join(runs.select("run_id", "cluster_name", "recipe_filename", "app_start_ts", "app_end_ts"),
                      st, ["cluster_name", "recipe_filename"], "app_start_ts", "app_end_ts", "status_ts")
    final = j.groupBy("run_id").agg(F.max_by("status", F.struct("status_ts", "insert_id")).alias("final_status"))
    end = F.col("app_end_ts") if as_of is None else F.coalesce(F.col("app_end_ts"), F.to_timestamp(F.lit(as_of)))
    return runs.join(final, "run_id", "left").select(
        "cluster_name", "recipe_filename", "app_start_ts", "app_end_ts",
        F.timestamp_diff("MILLISECOND", F.col("app_start_ts"), F.col("app_end_ts")).alias("app_duration_millis"),
        F.coalesce("final_status", F.lit("UNKNOWN")).alias("final_status"),
        F.timestamp_diff("MILLISECOND", F.col("app_start_ts"), end).alias("uptime_millis"))


def reconciled_starts(real: DataFrame, context: DataFrame, tolerance_ms: int = START_TOLERANCE_MS) -> DataFrame:
    """One row per start from two sources of (app_id, ts), none counted twice.

    A start of the context and the real start that follows it as the very next start of the
    application, at most ``tolerance_ms`` later (or at the same time), are one start with the
    real one's time.  A start of the context alone is synthetic.  Every start pairs once: its
    neighbour in time order decides.  Output: app_id, start_ts, context_ts, synthetic.
    """
    both = context.select("app_id", "ts", F.lit(0).alias("kind")).unionByName(real.select("app_id", "ts", F.lit(1).alias("kind")))
    rows = both.where("app_id is not null and ts is not null").distinct().select("app_id", "kind", F.unix_micros("ts").alias("us"), time_bucket("ts", 86400).alias("b"))
    ahead = bucketed_lead(rows, ["app_id"], "b", ["us", "kind"], ["us", "kind"], ["next_us", "next_kind"])
    back = ahead.withColumns({"_nb": -F.col("b"), "_nus": -F.col("us"), "_nk": -F.col("kind")})
    near = bucketed_lead(back, ["app_id"], "_nb", ["_nus", "_nk"], ["us", "kind"], ["last_us", "last_kind"])
    within = lambda kind, gap: F.coalesce((kind) & (gap <= tolerance_ms * 1000), F.lit(False))
    joined = within(F.col("next_kind") == 1, F.col("next_us") - F.col("us"))
    told = within(F.col("last_kind") == 0, F.col("us") - F.col("last_us"))
    starts = near.where((F.col("kind") == 1) | ~joined)
    context_us = F.when(F.col("kind") == 0, F.col("us")).when(told, F.col("last_us"))
    return starts.select("app_id", F.timestamp_micros("us").alias("start_ts"), F.timestamp_micros(context_us).alias("context_ts"),
                         (F.col("kind") == 0).alias("synthetic"))


def started_lifecycle(starts: DataFrame, ends: DataFrame, as_of: str) -> DataFrame:
    """E2 + E4: each start with its end (the next row of the application, if that is an end), duration and
    uptime; without an end the application still runs and its uptime goes up to ``as_of``."""
    both = starts.select("app_id", F.col("start_ts").alias("ts"), F.lit(0).alias("kind"), "context_ts", "synthetic").unionByName(
        ends.select("app_id", "ts", F.lit(1).alias("kind"), F.lit(None).cast("timestamp").alias("context_ts"), F.lit(None).cast("boolean").alias("synthetic")))
    rows = both.withColumns({"us": F.unix_micros("ts"), "b": time_bucket("ts", 86400)})
    ahead = bucketed_lead(rows, ["app_id"], "b", ["us", "kind"], ["ts", "kind"], ["next_ts", "next_kind"]).where("kind = 0")
    end = F.when(F.col("next_kind") == 1, F.col("next_ts"))
    until = F.coalesce(end, F.to_timestamp(F.lit(as_of)))
    millis = lambda a, b: F.floor((F.unix_micros(b) - F.unix_micros(a)) / 1000).cast("long")
    return ahead.select("app_id", F.col("ts").alias("start_ts"), "context_ts", "synthetic", end.alias("end_ts"),
                        millis(F.col("ts"), end).alias("app_duration_millis"), end.isNull().alias("running"),
                        millis(F.col("ts"), until).alias("uptime_millis"))

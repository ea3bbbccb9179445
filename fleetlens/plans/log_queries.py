"""Fleet log queries b1-b21 (C1-C21) as DataFrame plans.

Inputs are the two telemetry tables

    runs(cluster_name, recipe_filename, app_start_ts, app_end_ts,
         app_duration_millis, run_id, ...)
    executor_events(event_id, cluster_name, recipe_filename, evt_ts,
                    executor_event, current_no_executors, max_executors_seen, ...)

(from :func:`fleetlens.sources.logs.parse_telemetry` or the driver binding),
the ``capacity(cluster_name, max_exec_allowed)`` parameter table, and raw log
records for the text-extraction queries.

Scale notes
-----------
* runs x events is an interval join; it is bucketed by time
  (:mod:`fleetlens.operators.interval`) so a hot (cluster, recipe) is spread
  over buckets and never meets all of its events at once.
* ``LEAD`` per run is the bucketed two-level scan
  (:mod:`fleetlens.operators.scan`): a run with a huge event count is split
  over its time buckets.
* every other step is an aggregation with map-side partial aggregation;
  ``capacity`` is a parameter table of bounded, known size and is broadcast.
* the segment table is built once; b13 derives all its metrics from one
  per-run aggregate and one per-(cluster, recipe) aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import (ceil_minute, mins_sec_text, p95, regexp_extract_or_null,
                                safe_divide, seconds_between)
from ..operators.interval import BUCKET, SLOT, interval_join
from ..operators.scan import DEFAULT_BUCKET_SECONDS, bucketed_lead, bucketed_running, time_bucket
from ..sources import logs as L

KEYS = ["cluster_name", "recipe_filename"]
# runs x events buckets: per-key adaptive width (6 h, halved for keys dense in time)
RUN_BUCKETS = "auto"
RUN_COLS = ["run_id", "cluster_name", "recipe_filename", "app_start_ts", "app_end_ts",
            "app_duration_millis"]
EVENT_COLS = ["event_id", "cluster_name", "recipe_filename", "evt_ts", "executor_event",
              "current_no_executors", "max_executors_seen"]


# --- shared building blocks ---------------------------------------------------------

def events_in_runs(runs: DataFrame, events: DataFrame,
                   bucket_seconds=RUN_BUCKETS,
                   event_filter=None, reach: str = "any") -> DataFrame:
    """Runs x executor events with ``evt_ts BETWEEN start AND end`` (inner)."""
    ev = events.select(*EVENT_COLS)
    if event_filter is not None:
        ev = ev.filter(event_filter)
    return interval_join(runs.select(*RUN_COLS), ev, KEYS, "app_start_ts", "app_end_ts",
                         "evt_ts", how="inner", bucket_seconds=bucket_seconds, keep_bucket=True, reach=reach)


def run_segments(runs: DataFrame, events: DataFrame,
                 bucket_seconds=RUN_BUCKETS) -> DataFrame:
    """W1 + X7: each event's segment until the next event (or run end), seconds."""
    order = ["evt_ts", "event_id"]
    # A run that lies in one bucket needs no carry, and the join has dealt its rows by (keys, bucket) already:
    # the window reads them there.  Longer runs meet their next event over the buckets.
    one = events_in_runs(runs, events, bucket_seconds, reach="one")
    one = one.withColumn("next_evt_ts", F.lead("evt_ts").over(Window.partitionBy(SLOT, *KEYS, BUCKET, "run_id").orderBy(*order))).drop(SLOT)
    many = bucketed_lead(events_in_runs(runs, events, bucket_seconds, reach="many"), ["run_id"], BUCKET, order, "evt_ts", "next_evt_ts")
    seg = one.unionByName(many)
    seg_end = F.least(F.coalesce("next_evt_ts", "app_end_ts"), F.col("app_end_ts"))
    return seg.withColumn("seg_seconds",
                          F.greatest(F.lit(0), seconds_between(F.col("evt_ts"), seg_end)))


def _run_seconds() -> F.Column:
    return F.nullif(seconds_between("app_start_ts", "app_end_ts"), F.lit(0))


def per_run(runs: DataFrame, events: DataFrame, capacity: DataFrame | None = None,
            bucket_seconds=RUN_BUCKETS, keep_eventless: bool = True) -> DataFrame:
    """Per-run time-weighted average, peak executors, seconds at cap.

    ``keep_eventless`` reproduces b13's LEFT join (runs without events kept
    with NULL executor metrics); b1/b5/b9/b12 use the inner form.
    """
    seg = run_segments(runs, events, bucket_seconds)
    if capacity is not None:
        seg = seg.join(capacity, "cluster_name", "left")
        at_cap = F.when(F.col("max_exec_allowed").isNotNull()
                        & (F.col("current_no_executors") >= F.col("max_exec_allowed")),
                        F.col("seg_seconds")).otherwise(F.lit(0))
    else:
        at_cap = F.lit(None).cast("long")
    # run ids begin alike: a hash before them decides the comparisons of the join's sort
    mark = F.xxhash64("run_id").alias("_mark")
    agg = seg.groupBy(mark, "run_id").agg(
        F.sum(F.col("current_no_executors") * F.col("seg_seconds")).alias("weighted_sum"),
        F.max("max_executors_seen").alias("run_max_executors"),
        F.sum(at_cap).alias("run_seconds_at_cap"),
    )
    base = runs.select(*RUN_COLS, mark)
    out = base.join(agg, ["_mark", "run_id"], "left" if keep_eventless else "inner").drop("_mark")
    return out.withColumn("run_avg_executors", safe_divide(F.col("weighted_sum"), _run_seconds()))


# --- C1 .. C13 ---------------------------------------------------------------------

def b1_avg_executors(runs: DataFrame, events: DataFrame, **kw) -> DataFrame:
    """Time-weighted average executors per run, averaged per recipe."""
    pr = per_run(runs, events, keep_eventless=False, **kw)
    return (pr.groupBy(*KEYS).agg(F.avg("run_avg_executors").alias("avg_executors_per_job"))
            .orderBy(F.desc("avg_executors_per_job")))


def b2_peak_executors(events: DataFrame) -> DataFrame:
    """C2."""
    return (events.groupBy("cluster_name")
            .agg(F.max("max_executors_seen").alias("peak_executors_seen"))
            .orderBy(F.desc("peak_executors_seen")))


def b3_avg_duration(runs: DataFrame) -> DataFrame:
    return (runs.groupBy(*KEYS).agg(F.avg("app_duration_millis").alias("avg_job_duration_ms"))
            .orderBy(F.desc("avg_job_duration_ms")))


def b4_peak_duration(runs: DataFrame) -> DataFrame:
    return (runs.groupBy(*KEYS).agg(F.max("app_duration_millis").alias("peak_job_duration_ms"))
            .orderBy(F.desc("peak_job_duration_ms")))


def _run_peaks(runs: DataFrame, events: DataFrame, bucket_seconds: int) -> DataFrame:
    j = events_in_runs(runs, events, bucket_seconds)
    return j.groupBy("run_id", *KEYS).agg(F.max("max_executors_seen").alias("run_max_executors"))


def b5_runs_reaching_cap(runs: DataFrame, events: DataFrame, capacity: DataFrame,
                         bucket_seconds=RUN_BUCKETS) -> DataFrame:
    """Inner joins drop event-less runs and clusters without a cap (Q16)."""
    p = _run_peaks(runs, events, bucket_seconds).join(capacity, "cluster_name")
    hit = F.sum(F.when(F.col("run_max_executors") >= F.col("max_exec_allowed"), 1).otherwise(0))
    return (p.groupBy(*KEYS)
            .agg(hit.alias("runs_reaching_cap"), F.count(F.lit(1)).alias("total_runs"))
            .withColumn("fraction_reaching_cap",
                        safe_divide(F.col("runs_reaching_cap"), F.col("total_runs")))
            .orderBy(F.desc("runs_reaching_cap"), F.desc("total_runs")))


def b6_total_jobs(runs: DataFrame) -> DataFrame:
    return (runs.groupBy("cluster_name").agg(F.count(F.lit(1)).alias("total_jobs"))
            .orderBy(F.desc("total_jobs")))


def b7_total_runtime(runs: DataFrame) -> DataFrame:
    """Unit scaling and ROUND(x, 2)."""
    s = F.sum("app_duration_millis")
    return (runs.groupBy("cluster_name")
            .agg(s.alias("total_runtime_ms"),
                 F.round(s / 1000 / 60, 2).alias("total_runtime_minutes"),
                 F.round(s / 1000 / 60 / 60, 2).alias("total_runtime_hours"))
            .orderBy(F.desc("total_runtime_hours")))


def b8_p95_duration(runs: DataFrame) -> DataFrame:
    return (runs.groupBy(*KEYS)
            .agg(p95("app_duration_millis").alias("p95_job_duration_ms"),
                 F.avg("app_duration_millis").alias("avg_job_duration_ms"),
                 F.count(F.lit(1)).alias("runs"))
            .orderBy(F.desc("p95_job_duration_ms")))


def b9_seconds_at_cap(runs: DataFrame, events: DataFrame, capacity: DataFrame,
                      bucket_seconds=RUN_BUCKETS) -> DataFrame:
    """Compares the *current* executor count with the cap."""
    seg = run_segments(runs, events, bucket_seconds).join(capacity, "cluster_name")
    at = F.when(F.col("current_no_executors") >= F.col("max_exec_allowed"),
                F.col("seg_seconds")).otherwise(0)
    return (seg.groupBy(*KEYS).agg(F.sum(at).alias("seconds_at_cap"))
            .orderBy(F.desc("seconds_at_cap")))


def b10_executor_churn(runs: DataFrame, events: DataFrame,
                       bucket_seconds=RUN_BUCKETS) -> DataFrame:
    kinds = F.col("executor_event").isin("EXECUTOR_ADDED", "EXECUTOR_REMOVED")
    j = events_in_runs(runs, events, bucket_seconds, event_filter=kinds)
    added = F.sum(F.when(F.col("executor_event") == "EXECUTOR_ADDED", 1).otherwise(0))
    removed = F.sum(F.when(F.col("executor_event") == "EXECUTOR_REMOVED", 1).otherwise(0))
    return (j.groupBy(*KEYS).agg(added.alias("executors_added"), removed.alias("executors_removed"))
            .orderBy((F.col("executors_added") + F.col("executors_removed")).desc()))


def max_concurrency(runs: DataFrame, key: str = "cluster_name") -> DataFrame:
    """C11 by sweep line -- same answer as sampling every whole minute.

    A run is active at minute m when ``start <= m <= end``, i.e. for minutes in
    ``[ceil_minute(start), floor_minute(end)]``.  +1 / -1 deltas are summed per
    (cluster, minute) first (map-side combine: at most one row per minute per
    cluster), then a running sum is taken with the bucketed scan (day buckets).
    """
    first = ceil_minute("app_start_ts")
    last = F.date_trunc("minute", F.col("app_end_ts"))
    valid = runs.select(key, first.alias("m0"), last.alias("m1")).filter(F.col("m0") <= F.col("m1"))
    deltas = (valid.select(key, F.col("m0").alias("minute"), F.lit(1).alias("d"))
              .unionByName(valid.select(key, (F.col("m1") + F.expr("INTERVAL 1 MINUTE"))
                                        .alias("minute"), F.lit(-1).alias("d"))))
    per_min = (deltas.groupBy(key, "minute").agg(F.sum("d").alias("d"))
               .withColumn("_mkey", F.unix_micros("minute"))
               .withColumn("_b", time_bucket("minute", 86400)))
    running = bucketed_running(per_min, [key], "_b", "_mkey", "d", "level", fn="sum",
                               direction="preceding", strict=False)
    peak = running.groupBy(key).agg(F.max("level").alias("max_concurrent_jobs"))
    clusters = runs.select(key).distinct()
    return (clusters.join(peak, key, "left")
            .select(key, F.coalesce(F.col("max_concurrent_jobs"), F.lit(0))
                    .cast("int").alias("max_concurrent_jobs")))


def b11_max_concurrent(runs: DataFrame) -> DataFrame:
    return max_concurrency(runs).orderBy(F.desc("max_concurrent_jobs"))


def b12_p95_max_executors(runs: DataFrame, events: DataFrame,
                          bucket_seconds=RUN_BUCKETS) -> DataFrame:
    p = _run_peaks(runs, events, bucket_seconds)
    return (p.groupBy(*KEYS)
            .agg(p95("run_max_executors").alias("p95_run_max_executors"),
                 F.avg("run_max_executors").alias("avg_run_max_executors"),
                 F.count(F.lit(1)).alias("runs"))
            .orderBy(F.desc("p95_run_max_executors"), F.desc("runs")))


def b13_metrics(runs: DataFrame, events: DataFrame, capacity: DataFrame,
                bucket_seconds=RUN_BUCKETS) -> DataFrame:
    """The one-stop metric row per (cluster, recipe); event-less runs kept."""
    pr = per_run(runs, events, capacity, bucket_seconds, keep_eventless=True)
    pr = pr.join(capacity, "cluster_name", "left")
    capped = F.max("max_exec_allowed").isNotNull()
    hit = F.when(F.col("run_max_executors") >= F.col("max_exec_allowed"), 1).otherwise(0)
    agg = pr.groupBy(*KEYS).agg(
        F.avg("run_avg_executors").alias("avg_executors_per_job"),
        p95("run_max_executors").alias("p95_run_max_executors"),
        F.avg("app_duration_millis").alias("avg_job_duration_ms"),
        p95("app_duration_millis").alias("p95_job_duration_ms"),
        F.count(F.lit(1)).alias("runs"),
        F.when(capped, F.sum(F.coalesce("run_seconds_at_cap", F.lit(0)))).alias("seconds_at_cap"),
        F.when(capped, F.sum(hit)).alias("runs_reaching_cap"),
        F.when(capped, F.count(F.lit(1))).alias("total_runs"),
    ).withColumn("fraction_reaching_cap", safe_divide(F.col("runs_reaching_cap"), F.col("total_runs")))
    return agg.join(max_concurrency(runs), "cluster_name", "left").select(
        *KEYS, "avg_executors_per_job", "p95_run_max_executors", "avg_job_duration_ms",
        "p95_job_duration_ms", "runs", "seconds_at_cap", "runs_reaching_cap", "total_runs",
        "fraction_reaching_cap", "max_concurrent_jobs")


# --- C14 .. C21: text / JSON extraction over raw logs ------------------------------

def b14_nonzero_exits(logs: DataFrame, ordered: bool = True) -> DataFrame:
    """C14: non-zero driver exit codes from cluster logs."""
    base = L.once(L.scan(logs, resource_type=L.RT_CLUSTER).select("timestamp", F.col("resource.labels").alias("_labels"), "text_payload", "json_payload"),
                  F.coalesce("text_payload", "json_payload", F.lit("")).alias("msg"))
    base = base.filter(F.col("msg").like("%completed with exit code%")
                       | F.col("msg").like("%driver_exit_code:%"))
    code = F.coalesce(
        regexp_extract_or_null("msg", r"driver_exit_code:\s*([0-9]+)").try_cast("bigint"),
        regexp_extract_or_null("msg", r"exit code\s+([0-9]+)").try_cast("bigint"))
    parsed = L.once(base, regexp_extract_or_null("msg", r"Job\s+'([^']+)'").alias("job_id"), code.alias("driver_exit_code"),
                    L.label("cluster_name", "_labels").alias("cluster_name"))
    out = parsed.filter(F.col("job_id").isNotNull() & F.col("driver_exit_code").isNotNull() & (F.col("driver_exit_code") != 0)).select(
        "timestamp", "job_id", "cluster_name", "driver_exit_code", "msg")
    return out.orderBy(F.desc("timestamp")) if ordered else out


def latest_by(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """W2 ``ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order DESC) = 1``.

    Written as a ``max_by`` aggregation: it combines map-side, so a hot key is
    reduced in every task before the shuffle instead of being sorted whole.
    """
    picked = F.max_by(F.struct(*cols), F.struct(*order)).alias("_latest")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_latest.{c}").alias(c) for c in cols])


def status_events(logs: DataFrame) -> DataFrame:
    """``Execution status: {...}`` job messages as typed rows (b15 status_events)."""
    jobs = L.scan(logs, resource_type=L.RT_JOB).select("timestamp", "insert_id", "json_payload")
    status = (L.decode_fields(jobs, "json_payload", ["message"], prefix="_")
              .filter(F.lower(F.col("_message")).contains("execution status: {"))
              .select(F.col("timestamp").alias("log_ts"), "insert_id",
                      regexp_extract_or_null("_message", r".*Execution status:\s*(\{.*\})").alias("j")))
    fields = ["CLUSTER_NAME", "RECIPE", "JOB_ID", "STATUS", "MESSAGE"]
    return L.decode_fields(status, "j", fields, prefix="s_").select(
        "log_ts", "insert_id",
        F.col("s_CLUSTER_NAME").alias("cluster_name"), F.col("s_RECIPE").alias("recipe_filename"),
        F.col("s_JOB_ID").alias("app_id"), F.col("s_STATUS").alias("status"),
        F.col("s_MESSAGE").alias("message"))


def b15_latest_status(logs: DataFrame) -> DataFrame:
    """Latest application + latest execution status per recipe."""
    parsed = L.parse_telemetry(logs)
    apps = L.runs_from_telemetry(parsed).filter(F.col("recipe_filename").isNotNull())
    avg = apps.groupBy(*KEYS).agg(F.avg("app_duration_millis").alias("avg_job_duration_ms"))
    latest_app = latest_by(apps, KEYS, ["evt_ts", "run_id"], ["job_id", "app_start_ts"])
    s = status_events(logs)
    latest_status = latest_by(s, KEYS, ["log_ts", "insert_id"], ["app_id", "status", "message"])
    out = avg.join(latest_app, KEYS, "left").join(latest_status, KEYS, "left")
    return out.select(*KEYS, "job_id", F.col("app_start_ts").alias("app_start_iso"),
                      mins_sec_text("avg_job_duration_ms").alias("avg_job_duration_in_mins_sec"),
                      "status", "message", "avg_job_duration_ms") \
        .orderBy(F.desc("avg_job_duration_ms")).drop("avg_job_duration_ms")


ALERT_SEVERITIES = ["WARNING", "ERROR", "CRITICAL", "ALERT", "EMERGENCY"]


def driver_log_signals(logs: DataFrame, driver_log_name: str = L.DRIVER_LOG) -> DataFrame:
    """Classified driver log lines (the ``driver_logs`` CTE of b16)."""
    d = (L.scan(logs, resource_type=L.RT_JOB)
         .filter(F.col("log_name") == driver_log_name)
         .select(F.col("timestamp").alias("log_ts"), "insert_id", F.col("resource.labels").alias("_labels"),
                 "labels", "severity", "log_name", "json_payload"))
    cluster = F.regexp_replace(F.coalesce(F.get_json_object("labels", "$['dataproc.googleapis.com/cluster_name']"),
                                          L.label("cluster_name", "_labels")), r'^"|"$', "")
    d = L.once(d, L.label("job_id", "_labels").alias("job_id"), cluster.alias("cluster_name")).drop("_labels", "labels") \
        .where("job_id is not null")
    d = L.decode_fields(d, "json_payload", ["class", "message"], prefix="_") \
        .withColumnRenamed("_class", "log_class").withColumnRenamed("_message", "driver_message") \
        .drop("json_payload")
    d = d.filter(F.col("severity").isin(*ALERT_SEVERITIES) | F.col("driver_message").rlike("(Exception|Error|OutOfMemory)"))
    return d.select(
        "*",
        regexp_extract_or_null("driver_message", r"(java\.[A-Za-z0-9_$.]+(?:Exception|Error))")
        .alias("exception_type"),
        F.col("driver_message").rlike("^Lost task ").alias("is_lost_task"),
        F.col("driver_message").rlike("StackOverflowError").alias("is_stack_overflow"),
        F.col("driver_message").rlike(r"java\.lang\.OutOfMemoryError: Java heap space").alias("is_java_heap"),
    )


def b16_oom_latest(logs: DataFrame, ordered: bool = True) -> DataFrame:
    """Jobs whose *latest* driver log is a heap OOM (rank first, filter after)."""
    d = driver_log_signals(logs)
    keep = ["cluster_name", "log_ts", "severity", "log_class", "exception_type", "is_lost_task",
            "is_stack_overflow", "is_java_heap", "driver_message", "log_name"]
    latest = latest_by(d, ["job_id"], ["log_ts", "insert_id"], keep)
    apps = L.runs_from_telemetry(L.parse_telemetry(logs)).filter(
        F.col("recipe_filename").isNotNull() & F.col("job_id").isNotNull())
    recipe = latest_by(apps, ["job_id"], ["evt_ts", "run_id"], ["recipe_filename"])
    out = latest.filter(F.col("is_java_heap")).join(recipe, "job_id", "left")
    out = out.select(
        "job_id", "cluster_name", "recipe_filename",
        F.col("log_ts").alias("latest_driver_log_ts"),
        F.col("severity").alias("latest_driver_log_severity"),
        F.col("log_class").alias("latest_driver_log_class"),
        F.col("exception_type").alias("latest_driver_exception_type"),
        "is_lost_task", "is_stack_overflow", "is_java_heap",
        F.col("driver_message").alias("latest_driver_message"), "log_name")
    return out.orderBy(F.desc("latest_driver_log_ts")) if ordered else out


def b20_incarnations(logs: DataFrame, bucket_seconds: int = 86400, ordered: bool = True) -> DataFrame:
    """C20: one row per cluster incarnation (create -> delete cycle).

    The correlated ``MAX/MIN ... WHERE ts < / > ...`` subqueries (J7, J8) are
    strict as-of lookups; they run as bucketed range-window scans over an
    integer micros key, so equal timestamps are excluded exactly like ``<``.
    """
    base = (L.scan(logs, resource_type=L.RT_CLUSTER)
            .select("timestamp", F.col("resource.labels").alias("_labels"), "log_name",
                    F.col("proto_payload.audit_log.method_name").alias("method_name")))
    base = L.once(base, L.label("cluster_name", "_labels").alias("cluster_name")).drop("_labels").filter(F.col("cluster_name").isNotNull())
    audit = base.filter(F.col("log_name").like("%cloudaudit.googleapis.com%2Factivity")
                        & F.col("method_name").isNotNull())
    raw = audit.select(
        "cluster_name", F.col("timestamp").alias("ts"),
        F.when(F.col("method_name").like("%.CreateCluster"), "C")
        .when(F.col("method_name").like("%.DeleteCluster"), "D").alias("kind")
    ).filter(F.col("kind").isNotNull())
    raw = raw.withColumn("_k", F.unix_micros("ts")).withColumn("_b", time_bucket("ts", bucket_seconds))

    # J7 + A10: collapse consecutive same-type events to the earliest one.
    raw = raw.withColumn("_d", F.when(F.col("kind") == "D", F.col("ts"))) \
             .withColumn("_c", F.when(F.col("kind") == "C", F.col("ts")))
    raw = bucketed_running(raw, ["cluster_name"], "_b", "_k", ["_d", "_c"], ["prev_delete", "prev_create"], "max")
    # one aggregate for both kinds; a filter on its own output (_kind) leaves what every branch reads the same exchange
    canon = (raw.groupBy("cluster_name", "kind", F.when(F.col("kind") == "C", F.col("prev_delete")).otherwise(F.col("prev_create")).alias("_prev"))
             .agg(F.min("ts").alias("ts"), F.max("kind").alias("_kind")).select("cluster_name", "ts", F.col("_kind").alias("kind")))
    creates = canon.filter(F.col("kind") == "C").select("cluster_name", F.col("ts").alias("create_ts"))
    deletes = canon.filter(F.col("kind") == "D").select("cluster_name", F.col("ts").alias("delete_ts"))

    # Each canonical create pairs with the soonest canonical delete after it.
    canon = (canon.withColumn("_k", F.unix_micros("ts"))
             .withColumn("_b", time_bucket("ts", bucket_seconds))
             .withColumn("_d", F.when(F.col("kind") == "D", F.col("ts"))))
    canon = bucketed_running(canon, ["cluster_name"], "_b", "_k", "_d", "next_delete", "min",
                             direction="following")
    paired = canon.filter(F.col("kind") == "C").select(
        "cluster_name", F.col("ts").alias("create_ts"), F.col("next_delete").alias("delete_ts"))

    # Orphan deletes -- no canonical create strictly before them.
    first_create = creates.groupBy("cluster_name").agg(F.min("create_ts").alias("_first_c"))
    orphans = (deletes.join(first_create, "cluster_name", "left")
               .filter(F.col("_first_c").isNull() | (F.col("_first_c") >= F.col("delete_ts")))
               .select("cluster_name", F.lit(None).cast("timestamp").alias("create_ts"), "delete_ts"))
    incarnations = paired.unionByName(orphans)

    fallback = base.groupBy("cluster_name").agg(
        F.min("timestamp").alias("first_event_ts"), F.max("timestamp").alias("last_event_ts"),
        F.count(F.lit(1)).alias("total_events"))
    w = Window.partitionBy("cluster_name").orderBy(F.coalesce("create_ts", "delete_ts"))
    # every incarnation's cluster has events; a cluster without one is a single window of its events
    rows = fallback.join(incarnations.withColumn("incarnation_idx", F.row_number().over(w)), "cluster_name", "left") \
        .withColumn("incarnation_idx", F.coalesce("incarnation_idx", F.lit(1)))
    start = F.coalesce("create_ts", "first_event_ts")
    end = F.coalesce("delete_ts", "last_event_ts")
    out = rows.select(
        "cluster_name", F.col("incarnation_idx").cast("int").alias("incarnation_idx"),
        start.alias("span_start_ts"), end.alias("span_end_ts"),
        (seconds_between(start, end) / 60.0).alias("span_minutes"),
        F.col("create_ts").alias("create_event_ts"), F.col("delete_ts").alias("delete_event_ts"),
        F.col("create_ts").isNotNull().alias("has_explicit_create"),
        F.col("delete_ts").isNotNull().alias("has_explicit_delete"),
        "total_events",
    )
    return out.orderBy("cluster_name", "incarnation_idx") if ordered else out


AUTOSCALER_PAYLOAD_PATHS = [  # fixed values: output column -> payload path, integer?
    ("state", "$.status.state", False),
    ("decision", "$.recommendation.outputs.decision", False),
    ("decision_metric", "$.recommendation.outputs.decisionMetric", False),
    ("current_primary_workers", "$.recommendation.inputs.currentClusterSize.primaryWorkerCount", True),
    ("target_primary_workers", "$.recommendation.outputs.recommendedClusterSize.primaryWorkerCount", True),
    ("min_primary_workers", "$.recommendation.inputs.minWorkerCounts.primaryWorkerCount", True),
    ("max_primary_workers", "$.recommendation.inputs.maxWorkerCounts.primaryWorkerCount", True),
    ("current_secondary_workers", "$.recommendation.inputs.currentClusterSize.secondaryWorkerCount", True),
    ("target_secondary_workers", "$.recommendation.outputs.recommendedClusterSize.secondaryWorkerCount", True),
    ("min_secondary_workers", "$.recommendation.inputs.minWorkerCounts.secondaryWorkerCount", True),
    ("max_secondary_workers", "$.recommendation.inputs.maxWorkerCounts.secondaryWorkerCount", True),
    ("recommendation_id", "$.recommendation.outputs.recommendationId", False),
    ("status_details", "$.status.details", False),
]


def _payload_schema(paths: list[str]) -> str:
    """A schema with a text at the end of every path (``$.a.b``)."""
    tree: dict = {}
    for path in paths:
        at = tree
        for name in path.split(".")[1:]:
            at = at.setdefault(name, {})
    kind = lambda t: "struct<" + ",".join(f"{n}:{kind(x)}" for n, x in t.items()) + ">" if t else "string"
    return kind(tree)


def b21_recommendations(logs: DataFrame, ordered: bool = True) -> DataFrame:
    """Autoscaler events; the JSON payload is parsed once per row for all its paths."""
    a = (logs.filter(F.col("log_name").like("%dataproc.googleapis.com%2Fautoscaler"))
         .select("timestamp", F.col("resource.labels").alias("_labels"), "json_payload"))
    parsed = F.from_json("json_payload", _payload_schema([path for _, path, _ in AUTOSCALER_PAYLOAD_PATHS]))
    a = L.once(a, L.label("cluster_name", "_labels").alias("cluster_name"), parsed.alias("_p")).filter(F.col("cluster_name").isNotNull())
    cols = []
    for name, path, is_int in AUTOSCALER_PAYLOAD_PATHS:
        v = F.col("_p" + path[1:])
        cols.append((v.try_cast("bigint") if is_int else v).alias(name))
    out = a.select("cluster_name", F.col("timestamp").alias("event_ts"), *cols)
    return out.orderBy("cluster_name", "event_ts") if ordered else out

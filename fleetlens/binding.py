"""Binding of the driver tables onto the logical telemetry tables.

No fleet log corpus is supplied, so the driver's ``events`` table is mapped
onto every log stream the operators consume.  Each logical table is a pure
DataFrame derivation of ``events`` -- its size grows with the input -- and the
same rules are written independently as SQL in ``fleetlens.checks.oracle``.

Rules (fixed values of the binding, shared with the oracle SQL):
  k                 = bigint value of ``props.$.k``
  executor cluster  = 'cluster-' || user_id % 7
  recipe            = '_RECIPE_' || user_id || '.json'
  executor event    = signup -> EXECUTOR_ADDED, error -> EXECUTOR_REMOVED,
                      anything else -> EXECUTOR_FINAL_STATUS
  current / total / max executors seen = k % 16
  run               = one (user_id, calendar day): start = min ts, end = max ts
  job id            = 'job-' || user_id || '-' || yyyyMMdd-HHmm of the run start
  capacity          = cluster-0 .. cluster-4 -> 12 executors (5 and 6 absent)
  lifecycle cluster = 'fleet-' || user_id ; signup = CreateCluster,
                      error = DeleteCluster, other events = other cluster logs
  autoscaler        = purchase -> RECOMMENDING (current k%8+2, target k%10+2,
                      NULL when k%9 = 0, bounds 2..11); view -> COOLDOWN; clusters of
                      users divisible by 17 are pools ('pool-' || user_id) without audit logs
  home cluster      = a fleet's or pool's executor cluster: its user id % 7
  DAG and timer     = one per region: of cluster r_regionkey, of cluster r_regionkey + 2
  driver logs       = error events, message kind by k % 5
  exit-code logs    = error events, message kind by (k div 5) % 5
  status logs       = purchase events, STATUS by k % 3
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.params import param_table
from .sources import event_log as EVL
from .sources.logs import (AUDIT_LOG, AUTOSCALER_LOG, CLUSTER_LOG, DRIVER_LOG,
                           RT_CLUSTER, RT_JOB, TELEMETRY_LOG)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Fixed values of the binding ------------------------------------------------
N_EXECUTOR_CLUSTERS = 7
CAPPED_CLUSTERS = {f"cluster-{i}": 12 for i in range(5)}
AUTOSCALER_MIN_WORKERS = 2
AUTOSCALER_MAX_WORKERS = 11
CREATE_METHOD = "google.cloud.dataproc.v1.ClusterController.CreateCluster"
DELETE_METHOD = "google.cloud.dataproc.v1.ClusterController.DeleteCluster"
STATUS_BY_K3 = ["SUCCESS", "FAILED", "RUNNING"]
# deployed master shape of each executor cluster (reference configs), fresh-plan master
DEPLOYED_MASTERS = ["e2-standard-8", "n2-highcpu-32", "n2-standard-32", "n2-highmem-32",
                    "e2-standard-32", "c3-highmem-192", "e2-highmem-16"]
FRESH_MASTER = "e2-standard-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def k_of(props: str = "props") -> Column:
    return F.get_json_object(F.col(props), "$.k").try_cast("bigint")


def executor_cluster(user_id: Column) -> Column:
    return F.concat(F.lit("cluster-"), (user_id % N_EXECUTOR_CLUSTERS).cast("string"))


def recipe_of(user_id: Column) -> Column:
    return F.concat(F.lit("_RECIPE_"), user_id.cast("string"), F.lit(".json"))


def lifecycle_cluster(user_id: Column) -> Column:
    return F.concat(F.lit("fleet-"), user_id.cast("string"))


def autoscaled_cluster(user_id: Column) -> Column:
    return F.concat(F.when(user_id % 17 == 0, "pool-").otherwise("fleet-"), user_id.cast("string"))


def at_home(by_span: DataFrame) -> DataFrame:
    """Spans or segments of fleets and pools as those of the executor cluster they serve."""
    owner = F.regexp_extract("cluster_name", r"(\d+)$", 1).cast("long")
    return by_span.withColumns({"incarnation_idx": F.concat_ws("/", "cluster_name", "incarnation_idx"),
                                "cluster_name": executor_cluster(owner)})


def dag_map(region: DataFrame) -> DataFrame:
    return region.select(F.concat(F.lit("cluster-"), "r_regionkey").alias("cluster_name"),
                         F.concat(F.lit("dag_"), F.lower("r_name")).alias("dag_id"))


def timer_map(region: DataFrame) -> DataFrame:
    return region.select(F.concat(F.lit("cluster-"), F.col("r_regionkey") + 2).alias("cluster_name"),
                         F.concat(F.lit("timer_"), F.lower("r_name")).alias("timer_name"),
                         F.concat(F.lit("0"), "r_regionkey", F.lit(":30")).alias("timer_time"))


def typed_events(events: DataFrame) -> DataFrame:
    """``events`` with a zoned TIMESTAMP (session zone UTC) and ``k``."""
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
                         "event_type", "value", k_of().alias("k"))


def executor_events(events: DataFrame) -> DataFrame:
    e = typed_events(events)
    kind = (F.when(F.col("event_type") == "signup", "EXECUTOR_ADDED")
            .when(F.col("event_type") == "error", "EXECUTOR_REMOVED")
            .otherwise("EXECUTOR_FINAL_STATUS"))
    n = F.col("k") % 16
    return e.select(
        "event_id",
        executor_cluster(F.col("user_id")).alias("cluster_name"),
        recipe_of(F.col("user_id")).alias("recipe_filename"),
        F.col("ts").alias("evt_ts"),
        kind.alias("executor_event"),
        n.alias("current_no_executors"),
        n.alias("total_no_executors"),
        n.alias("max_executors_seen"),
    )


def runs(events: DataFrame) -> DataFrame:
    """One application run per (user, day): partial aggregation, skew safe."""
    e = typed_events(events)
    r = (e.groupBy("user_id", F.to_date("ts").alias("run_date"))
         .agg(F.min("ts").alias("app_start_ts"), F.max("ts").alias("app_end_ts")))
    cluster = executor_cluster(F.col("user_id"))
    recipe = recipe_of(F.col("user_id"))
    return r.select(
        cluster.alias("cluster_name"),
        recipe.alias("recipe_filename"),
        "app_start_ts", "app_end_ts",
        ((F.unix_micros("app_end_ts") - F.unix_micros("app_start_ts")) / 1000)
        .cast("long").alias("app_duration_millis"),
        F.concat_ws("|", cluster, recipe,
                    F.date_format("app_start_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("run_id"),
        F.concat(F.lit("job-"), F.col("user_id").cast("string"), F.lit("-"),
                 F.date_format("app_start_ts", "yyyyMMdd-HHmm")).alias("job_id"),
        "user_id", "run_date",
    )


def capacity(spark: SparkSession, caps: dict[str, int] | None = None) -> DataFrame:
    """The per-cluster executor cap parameter table (b5/b9/b13 ``capacity``)."""
    caps = CAPPED_CLUSTERS if caps is None else caps
    return param_table(spark, sorted(caps.items()), "cluster_name string, max_exec_allowed int")


# --- raw log records ----------------------------------------------------------

def _labels(**cols: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in cols.items()]))


def _record(ts: Column, insert_id: Column, severity: Column, log_name: str, rtype: str,
            resource_labels: Column, json_payload: Column | None = None,
            text_payload: Column | None = None, method: Column | None = None) -> list[Column]:
    return [
        ts.alias("timestamp"),
        insert_id.cast("string").alias("insert_id"),
        severity.alias("severity"),
        F.lit(log_name).alias("log_name"),
        F.struct(F.lit(rtype).alias("type"), resource_labels.alias("labels")).alias("resource"),
        F.lit(None).cast("string").alias("labels"),
        (json_payload if json_payload is not None else F.lit(None).cast("string")).alias("json_payload"),
        (text_payload if text_payload is not None else F.lit(None).cast("string")).alias("text_payload"),
        F.struct(F.struct((method if method is not None else F.lit(None).cast("string"))
                          .alias("method_name")).alias("audit_log")).alias("proto_payload"),
    ]


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def telemetry_logs(events: DataFrame) -> DataFrame:
    """application_end + executor_status listener messages as raw log records.

    ``json_payload.message`` is itself a JSON string whose values are strings,
    exactly like the listener emits them.
    """
    r = runs(events)
    app_msg = F.to_json(F.struct(
        F.lit("application_end").alias("event_type"),
        F.lit("FLEET").alias("event_type_family"),
        F.col("cluster_name").alias("clusterName"),
        F.col("recipe_filename").alias("recipeFilename"),
        _iso(F.col("app_start_ts")).alias("app_start_iso"),
        _iso(F.col("app_end_ts")).alias("app_end_iso"),
        F.col("app_duration_millis").cast("string").alias("app_duration_millis"),
    ))
    app = r.select(*_record(
        F.col("app_end_ts"), F.concat(F.lit("app-"), F.col("run_id")), F.lit("INFO"),
        TELEMETRY_LOG, RT_JOB,
        _labels(cluster_name=F.col("cluster_name"), job_id=F.col("job_id")),
        json_payload=F.to_json(F.struct(app_msg.alias("message")))))
    ev = executor_events(events)
    ev_msg = F.to_json(F.struct(
        F.lit("executor_status").alias("event_type"),
        F.lit("FLEET").alias("event_type_family"),
        F.col("cluster_name").alias("clusterName"),
        F.col("recipe_filename").alias("recipeFilename"),
        F.col("executor_event"),
        F.col("event_id").cast("string").alias("executor_id"),
        F.col("total_no_executors").cast("string").alias("total_no_executors"),
        F.col("current_no_executors").cast("string").alias("current_no_executors"),
        _iso(F.col("evt_ts")).alias("timestamp_iso"),
        F.col("max_executors_seen").cast("string").alias("max_executors_seen"),
    ))
    exe = ev.select(*_record(
        F.col("evt_ts"), F.col("event_id"), F.lit("INFO"), TELEMETRY_LOG, RT_JOB,
        _labels(cluster_name=F.col("cluster_name")),
        json_payload=F.to_json(F.struct(ev_msg.alias("message")))))
    return app.unionByName(exe)


def _error_events_with_job(events: DataFrame) -> DataFrame:
    """error events with the job id of the run (user, day) they belong to."""
    r = runs(events).select("user_id", "run_date", "job_id")
    e = typed_events(events).filter(F.col("event_type") == "error")
    return e.join(r, (e.user_id == r.user_id) & (F.to_date(e.ts) == r.run_date)) \
        .select(e["*"], r.job_id)


DRIVER_MESSAGES = [  # fixed values: driver log kind by k % 5 -> (severity, class, message)
    ("ERROR", "org.apache.spark.SparkContext",
     "Job aborted: java.lang.OutOfMemoryError: Java heap space"),
    ("WARNING", "org.apache.spark.scheduler.TaskSetManager",
     "Lost task 3.0 in stage 2.0 (TID 7): java.io.IOException: No space left on device"),
    ("ERROR", "org.apache.spark.deploy.yarn.ApplicationMaster",
     "User class threw exception: java.lang.StackOverflowError"),
    ("INFO", "org.apache.spark.executor.Executor",
     "Task retried after java.lang.IllegalStateException: shuffle block missing"),
    ("INFO", "org.apache.spark.scheduler.DAGScheduler", "Stage 4 finished in 2.1 s"),
]


def driver_logs(events: DataFrame) -> DataFrame:
    e = _error_events_with_job(events)
    kind = F.col("k") % 5
    def pick(i: int) -> Column:
        out = F.lit(None).cast("string")
        for j in reversed(range(len(DRIVER_MESSAGES))):
            out = F.when(kind == j, F.lit(DRIVER_MESSAGES[j][i])).otherwise(out)
        return out
    payload = F.to_json(F.struct(pick(2).alias("message"), pick(1).alias("class")))
    return e.select(*_record(
        F.col("ts"), F.col("event_id"), pick(0), DRIVER_LOG, RT_JOB,
        _labels(cluster_name=executor_cluster(F.col("user_id")), job_id=F.col("job_id")),
        json_payload=payload))


def exit_code_logs(events: DataFrame) -> DataFrame:
    """Cluster-level job completion messages (b14 input)."""
    e = _error_events_with_job(events)
    kind = (F.col("k") / 5).cast("long") % 5
    job = F.col("job_id")
    text = (F.when(kind == 0, F.concat(F.lit("Job '"), job, F.lit("' completed with exit code 0")))
            .when(kind == 1, F.concat(F.lit("Job '"), job, F.lit("' completed with exit code 1")))
            .when(kind == 2, F.concat(F.lit("Job '"), job,
                                      F.lit("' failed: driver_exit_code: 247 (YARN eviction)")))
            .when(kind == 3, F.concat(F.lit("Job '"), job, F.lit("' completed with exit code 143")))
            .otherwise(F.lit("Cluster agent heartbeat ok")))
    return e.select(*_record(
        F.col("ts"), F.col("event_id"), F.lit("INFO"), CLUSTER_LOG, RT_CLUSTER,
        _labels(cluster_name=executor_cluster(F.col("user_id"))), text_payload=text))


def status_logs(events: DataFrame) -> DataFrame:
    """"Execution status: {...}" messages written by the job itself (b15 input)."""
    e = typed_events(events).filter(F.col("event_type") == "purchase")
    status = F.element_at(F.array(*[F.lit(s) for s in STATUS_BY_K3]), (F.col("k") % 3 + 1).cast("int"))
    body = F.to_json(F.struct(
        executor_cluster(F.col("user_id")).alias("CLUSTER_NAME"),
        F.lit("DWH").alias("LAYER"),
        F.concat(F.lit("application_"), F.col("event_id").cast("string")).alias("JOB_ID"),
        recipe_of(F.col("user_id")).alias("RECIPE"),
        status.alias("STATUS"),
        F.when(status == "FAILED", F.concat(F.lit("failed k="), F.col("k").cast("string")))
        .otherwise(F.lit("")).alias("MESSAGE"),
    ))
    msg = F.concat(F.lit("INFO Runner: Execution status: "), body)
    return e.select(*_record(
        F.col("ts"), F.col("event_id"), F.lit("INFO"), TELEMETRY_LOG, RT_JOB,
        _labels(cluster_name=executor_cluster(F.col("user_id"))),
        json_payload=F.to_json(F.struct(msg.alias("message")))))


def audit_logs(events: DataFrame) -> DataFrame:
    """Cluster audit + other cluster logs per lifecycle cluster (b20 input)."""
    e = typed_events(events)
    method = (F.when(F.col("event_type") == "signup", F.lit(CREATE_METHOD))
              .when(F.col("event_type") == "error", F.lit(DELETE_METHOD)))
    is_audit = F.col("event_type").isin("signup", "error")
    log_name = F.when(is_audit, F.lit(AUDIT_LOG)).otherwise(F.lit(CLUSTER_LOG))
    cols = _record(F.col("ts"), F.col("event_id"), F.lit("NOTICE"), "", RT_CLUSTER,
                   _labels(cluster_name=lifecycle_cluster(F.col("user_id"))), method=method)
    cols[3] = log_name.alias("log_name")
    return e.select(*cols)


def autoscaler_logs(events: DataFrame) -> DataFrame:
    e = typed_events(events).filter(F.col("event_type").isin("purchase", "view"))
    rec = F.col("event_type") == "purchase"
    cur = F.col("k") % 8 + 2
    tgt = F.when(F.col("k") % 9 != 0, F.col("k") % 10 + 2)
    decision = (F.when(tgt > cur, "SCALE_UP").when(tgt < cur, "SCALE_DOWN")
                .when(tgt == cur, "NO_SCALE"))
    recommendation = F.struct(
        F.struct(
            F.struct(cur.alias("primaryWorkerCount")).alias("currentClusterSize"),
            F.struct(F.lit(AUTOSCALER_MIN_WORKERS).alias("primaryWorkerCount")).alias("minWorkerCounts"),
            F.struct(F.lit(AUTOSCALER_MAX_WORKERS).alias("primaryWorkerCount")).alias("maxWorkerCounts"),
        ).alias("inputs"),
        F.struct(
            decision.alias("decision"),
            F.lit("YARN_MEMORY").alias("decisionMetric"),
            F.struct(tgt.alias("primaryWorkerCount")).alias("recommendedClusterSize"),
            F.concat(F.lit("rec-"), F.col("event_id").cast("string")).alias("recommendationId"),
        ).alias("outputs"),
    )
    status = F.struct(
        F.when(rec, "RECOMMENDING").otherwise("COOLDOWN").alias("state"),
        F.when(~rec, F.lit("2 minute cooldown started")).alias("details"),
    )
    payload = F.to_json(F.struct(status.alias("status"),
                                 F.when(rec, recommendation).alias("recommendation")))
    return e.select(*_record(
        F.col("ts"), F.col("event_id"), F.lit("INFO"), AUTOSCALER_LOG, RT_CLUSTER,
        _labels(cluster_name=autoscaled_cluster(F.col("user_id"))), json_payload=payload))


def raw_logs(events: DataFrame) -> DataFrame:
    """All bound log streams in one raw log table (one scan serves every bNN)."""
    parts = [telemetry_logs(events), status_logs(events), driver_logs(events),
             exit_code_logs(events), audit_logs(events), autoscaler_logs(events)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def event_log_lines(events: DataFrame) -> DataFrame:
    """Spark event-log lines of every user's application (app, roll, at, line), ten days to a rolling file.

    A run is heard of by its real start, by its context's start, or by both (the real start up
    to 1.5 s later): kinds by (user_id + day of month) % 3.  Users with user_id % 5 = 4 never end.
    """
    def place(ts: Column, rank: int, event_id: Column) -> list[Column]:
        return [F.concat(F.lit("app-"), F.col("user_id").cast("string")).alias("app"),
                F.floor(F.datediff(ts, F.lit("2024-01-01")) / 10).cast("long").alias("roll"),
                F.struct(F.unix_micros(ts).alias("us"), F.lit(rank).alias("rank"), event_id.alias("id")).alias("at")]

    e = typed_events(events).withColumn("kind", F.when(F.col("event_type") == "signup", "EXECUTOR_ADDED").when(
        F.col("event_type") == "error", "EXECUTOR_REMOVED")).where("kind is not null")
    executors = e.select(*place(F.col("ts"), 2, F.col("event_id")), EVL.executor_line(
        F.col("kind"), F.unix_millis("ts"), F.col("event_id").cast("string")).alias("line"))
    r = runs(events).withColumn("how", (F.col("user_id") + F.dayofmonth("run_date")) % 3)
    name = F.concat_ws("/", "cluster_name", "recipe_filename")
    zero = F.lit(0).cast("long")
    begun, ended = F.unix_millis("app_start_ts"), F.unix_millis("app_end_ts")
    real = F.timestamp_millis(begun + F.when(F.col("how") == 2, F.col("user_id") % 4 * 500).otherwise(0))
    contexts = r.where("how > 0").select(*place(F.timestamp_millis(begun), 0, zero), EVL.environment_line(begun, name).alias("line"))
    starts = r.where("how <> 1").withColumn("real", real).select(*place(F.col("real"), 1, zero), EVL.start_line(
        F.unix_millis("real"), name, F.concat(F.lit("app-"), F.col("user_id").cast("string"))).alias("line"))
    ends = r.where("user_id % 5 <> 4").select(*place(F.timestamp_millis(ended), 3, zero), EVL.end_line(ended).alias("line"))
    return executors.unionByName(contexts).unionByName(starts).unionByName(ends)


def cluster_masters(exits: DataFrame, reference_exits: DataFrame) -> DataFrame:
    """Deployed / fresh master per executor cluster seen in the exit-code logs;
    the reference config carries a promotion tag when the reference window had
    an eviction."""
    idx = F.regexp_extract("cluster_name", r"cluster-(\d+)", 1).cast("int")
    masters = F.element_at(F.array(*[F.lit(m) for m in DEPLOYED_MASTERS]), idx + 1)
    tagged = (reference_exits.filter(F.col("driver_exit_code") == 247).select("cluster_name").distinct()
              .withColumn("has_promotion_tag", F.lit(True)))
    seen = exits.select("cluster_name").unionByName(reference_exits.select("cluster_name")).distinct()
    return (seen.join(tagged, "cluster_name", "left")
            .select("cluster_name", masters.alias("reference_master"), F.lit(FRESH_MASTER).alias("fresh_master"),
                    F.coalesce("has_promotion_tag", F.lit(False)).alias("has_promotion_tag")))


def deployed_configs(reference_metrics: DataFrame, heap_tagged: DataFrame) -> DataFrame:
    """Recipe configs deployed from the reference window (what the previous run wrote).

    Flavour and memory follow the recipe's user id: every 4th is a fixed-size
    (manual) recipe, memory 8 / 12 / 16 GB; DA bounds come from the reference
    metrics.  Recipes with a reference-window heap OOM carry the boost tag.
    """
    from .plans.snapshots import normalize_metrics
    m = normalize_metrics(reference_metrics)
    uid = F.regexp_extract("recipe_filename", r"_RECIPE_(\d+)", 1).cast("long")
    mem_gb = (8 + 4 * (uid % 3)).cast("int")
    mem = F.concat(mem_gb.cast("string"), F.lit("g"))
    manual = uid % 4 == 0
    mn = F.greatest(F.lit(2), F.ceil("avg_executors_per_job")).cast("int")
    mx = F.greatest(mn + 1, F.ceil("p95_run_max_executors")).cast("int")
    inst = F.greatest(F.lit(1), F.ceil("p95_run_max_executors")).cast("int")
    opts = F.when(manual, F.create_map(F.lit("spark.executor.instances"), inst.cast("string"),
                                       F.lit("spark.executor.memory"), mem)) \
        .otherwise(F.create_map(F.lit("spark.dynamicAllocation.enabled"), F.lit("true"),
                                F.lit("spark.dynamicAllocation.minExecutors"), mn.cast("string"),
                                F.lit("spark.dynamicAllocation.maxExecutors"), mx.cast("string"),
                                F.lit("spark.executor.memory"), mem))
    tags = heap_tagged.select("cluster_name", "recipe_filename").distinct().withColumn("_t", F.lit(True))
    out = m.join(tags, ["cluster_name", "recipe_filename"], "left")
    return out.select(
        "cluster_name", "recipe_filename", opts.alias("spark_opts"),
        (F.when(manual, inst).otherwise(mn) * mem_gb).cast("int").alias("total_executor_minimum_allocated_memory_gb"),
        (F.when(manual, inst).otherwise(mx) * mem_gb).cast("int").alias("total_executor_maximum_allocated_memory_gb"),
        F.when(F.col("_t").isNotNull(), F.create_map(F.lit("appliedMemoryHeapBoostFactor"), F.lit("1.5")))
        .otherwise(F.create_map().cast("map<string,string>")).alias("extra"))


#: Start of the current comparison window; what came before is the reference window.
SNAPSHOT_BOUNDARY = "2024-01-16"


def is_current(ts: Column | str) -> Column:
    """Does a timestamp lie in the current comparison window?"""
    return F.col(ts) >= F.to_timestamp(F.lit(SNAPSHOT_BOUNDARY)) if isinstance(ts, str) else ts >= F.to_timestamp(F.lit(SNAPSHOT_BOUNDARY))


#: Residues (user id % 7) whose users share recipes, per window: busy in both, in the first, in the second.
SHARED_RECIPES = {"reference": (1, 5, 2), "current": (1, 5, 3)}


def with_scale_tags(configs: DataFrame, touching: DataFrame) -> DataFrame:
    """Deployed configs of recipes that touched their ceiling carry the scale tag of the run before."""
    keys = ["cluster_name", "recipe_filename"]
    tags = touching.select(*keys).distinct().withColumn("_t", F.lit(True))
    tag = F.create_map(F.lit("appliedExecutorScaleFactor"), F.lit("1.5"))
    return (configs.join(tags, keys, "left")
            .withColumn("extra", F.when(F.col("_t"), F.map_concat("extra", tag)).otherwise(F.col("extra"))).drop("_t"))


def snapshot_events(events: DataFrame, which: str) -> DataFrame:
    """The events of one comparison window, every one of them.

    Some users share a recipe: in every 20 ids of a cluster with a residue of
    ``SHARED_RECIPES``, the second to sixth run the recipe of the first, whose runs become
    long ones (the scale signals).

    Some recipes go by another name in one window, which makes paired, new and dropped
    recipes: users divisible by 11 are renamed in the reference window (id + 7,000,000),
    those divisible by 13 in the current one (id + 14,000,000); both offsets keep the
    user's cluster.
    """
    uid, place = F.col("user_id"), F.floor(F.col("user_id") / 7) % 20
    if which not in SHARED_RECIPES:
        raise ValueError(which)
    retired, offset = (11, 7_000_000) if which == "reference" else (13, 14_000_000)
    named = (F.when(place.between(1, 5) & (uid % 7).isin(*SHARED_RECIPES[which]), uid - 7 * place)
             .when(uid % retired == 0, uid + offset).otherwise(uid))
    inside = is_current("ts") if which == "current" else ~is_current("ts")
    return events.filter(inside).withColumn("user_id", named)

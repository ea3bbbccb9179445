"""Cluster and recipe sizing (P3-P15) under a tuning strategy.

Flow (one scenario = one strategy over one metric snapshot):

  metrics (b13) --groupBy cluster--> demand (P4)
  demand x 23 candidate shapes (explode of the fixed, filtered catalogue)
      --> candidate evaluation + min-max normalised score (P5, P6)   [distributed]
  scored candidates --one compact row per cluster--> quota fold (P7)  [ordered, one task per scenario]
  plan x recipe metrics --> manual plan (P9), DA plan (P10), roll-ups (P11, P12)

P7 is the only ordered step: the pick for one cluster changes the quota
pressure seen by the next (clusters in demand order).  It receives one row per
cluster with the candidates that can win (at most 23, mostly a handful), so a
group's size follows the number of clusters that share one quota, never the log
volume, and scenarios (each a quota pool of its own) run in parallel.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import catalog_rows, machine_catalog, price_of
from .snapshots import normalize_metrics

# ---------------------------------------------------------------------------------
# Topology presets, bias modes, machine preference, quotas, strategies.
TOPOLOGIES = {"8cx1GBpc": (8, 1), "8cx2GBpc": (8, 2), "8cx4GBpc": (8, 4), "4cx1GBpc": (4, 1), "4cx2GBpc": (4, 2)}

BIAS_MODES = {  # cost, sufficiency, utilization, worker penalty, oversize penalty, concurrency buffer
    "cost_biased": (0.7, 0.3, 0.2, 0.4, 0.3, 0.10),
    "performance_biased": (0.1, 0.8, 0.5, 0.1, 0.05, 0.40),
    "cost_performance_balance": (0.4, 0.5, 0.3, 0.3, 0.2, 0.25),
}

PREFERRED_CORES = 32
MIN_CORES = 32
MAX_CORES = 48
ALLOWED_FAMILIES = ["n2", "n2d", "e2", "c3", "c4"]
FAMILY_PRIORITY = {"n2": 1, "n2d": 2, "e2": 3, "c3": 4, "c4": 5}
C3_MAX_CLUSTERS = 1
C4_MAX_CLUSTERS = 1
C3C4_MAX_WORKERS = 13
EXCLUDED_FAMILIES = ["n4", "n4d"]
FAMILY_PRIORITY_WEIGHT = 0.20
QUOTAS = {"e2": 5000, "n2": 5000, "n2d": 3000, "c3": 500, "c4": 500, "n4": 500, "n4d": 500}

MIN_OVERHEAD_GB = 0.384
EXECUTOR_MEMORY_CAP_GB = 32
MEMORY_PER_CORE_BY_VARIANT = {"highcpu": 1, "highmem": 4}   # anything else: 2
OVERSIZE_THRESHOLD = 1.5
PREFERRED_CORE_BONUS = -0.10
MIN_WORKERS = 2
# autoscaling policy brackets: (max workers, policy name, worker ceiling)
AUTOSCALING_BRACKETS = [(4, "small-workload-autoscaling", 4), (6, "medium-workload-autoscaling", 6),
                        (8, "large-workload-autoscaling", 8), (10, "extra-large-workload-autoscaling", 10)]


@dataclass(frozen=True)
class Strategy:
    name: str = "default"
    bias: str = "cost_performance_balance"
    topology: str = "8cx1GBpc"
    cap_hit_boost_pct: float = 0.20
    cap_hit_threshold: float = 0.30
    prefer_max_workers: int = 6
    per_worker_penalty_pct: float = 0.05
    memory_overhead_ratio: float = 0.10
    os_and_daemons_reserve_gb: int = 4
    manual_instances_from: str = "p95"
    min_executor_instances: int = 1
    da_min_from: str = "avg"
    da_initial_equals_min: bool = True
    quotas: dict = field(default_factory=lambda: dict(QUOTAS))

    @property
    def executor_cores(self) -> int:
        return TOPOLOGIES[self.topology][0]

    @property
    def executor_memory_gb(self) -> int:
        c, gb = TOPOLOGIES[self.topology]
        return c * gb

    @property
    def prefer_eight(self) -> bool:
        return self.executor_cores == 8

    @property
    def weights(self) -> tuple:
        return BIAS_MODES[self.bias]

    def with_topology(self, label: str) -> "Strategy":
        return replace(self, name=f"{self.name}+{label}", topology=label)


STRATEGIES = {
    "default": Strategy(),
    "cost_biased": Strategy(name="cost_biased", bias="cost_biased", cap_hit_boost_pct=0.10, cap_hit_threshold=0.40,
                            prefer_max_workers=4, per_worker_penalty_pct=0.08),
    "performance_biased": Strategy(name="performance_biased", bias="performance_biased", topology="8cx2GBpc",
                                   cap_hit_boost_pct=0.30, cap_hit_threshold=0.20, prefer_max_workers=8,
                                   per_worker_penalty_pct=0.02, min_executor_instances=2,
                                   da_initial_equals_min=False),
}


def strategies_df(spark: SparkSession) -> DataFrame:
    """P13 as a dimension table: one row per strategy (with its bias weights)."""
    rows = []
    for s in STRATEGIES.values():
        cw, sw, uw, ww, ow, buf = s.weights
        rows.append((s.name, s.bias, s.topology, s.executor_cores, s.executor_memory_gb, cw, sw, uw, ww, ow, buf,
                     s.cap_hit_boost_pct, s.cap_hit_threshold, s.prefer_max_workers, s.per_worker_penalty_pct,
                     s.min_executor_instances, s.da_initial_equals_min))
    return spark.createDataFrame(rows, "strategy string, bias string, topology string, executor_cores int, "
                                       "executor_memory_gb int, cost_weight double, sufficiency_weight double, "
                                       "utilization_weight double, worker_penalty_weight double, "
                                       "oversize_penalty_weight double, concurrency_buffer_pct double, "
                                       "cap_hit_boost_pct double, cap_hit_threshold double, prefer_max_workers int, "
                                       "per_worker_penalty_pct double, min_executor_instances int, "
                                       "da_initial_equals_min boolean")


# ---------------------------------------------------------------------------------
# Per-worker executor capacity and recommended executor memory.

def executors_per_worker(cores: Column, memory_gb: Column, exec_cores: int | Column, exec_mem_gb: int,
                         ratio: float, reserve_gb: int) -> Column:
    ec = exec_cores if isinstance(exec_cores, Column) else F.lit(exec_cores)
    by_cores = F.floor(cores / ec)
    usable = F.greatest(F.lit(0.0), memory_gb - F.lit(reserve_gb))
    per_exec = F.lit(exec_mem_gb + max(MIN_OVERHEAD_GB, exec_mem_gb * ratio))
    by_mem = F.floor(usable / per_exec)
    return F.greatest(F.lit(1), F.least(by_cores, by_mem)).cast("int")


def recommended_executor_memory(variant: Column, memory_gb: Column, exec_cores: Column, s: Strategy) -> Column:
    per_core = F.lit(2)
    for v, gb in MEMORY_PER_CORE_BY_VARIANT.items():
        per_core = F.when(F.lower(variant) == v, F.lit(gb)).otherwise(per_core)
    base = per_core * exec_cores
    overhead = F.greatest(F.lit(MIN_OVERHEAD_GB), base * s.memory_overhead_ratio)
    usable = F.greatest(F.lit(1.0), memory_gb - s.os_and_daemons_reserve_gb)
    max_allowed = F.floor(F.greatest(F.lit(1.0), usable - overhead))
    proposed = F.least(base, max_allowed)
    with_floor = F.greatest(F.lit(s.executor_memory_gb), proposed)
    return F.greatest(F.lit(1), F.least(with_floor, F.least(max_allowed, F.lit(EXECUTOR_MEMORY_CAP_GB)))).cast("int")


def candidate_shapes() -> list[tuple]:
    """The fixed candidate list: allowed families, not excluded, cores in [32, 48]."""
    out = []
    for idx, name, fam, variant, cores, mem in catalog_rows():
        if fam in ALLOWED_FAMILIES and fam not in EXCLUDED_FAMILIES and MIN_CORES <= cores <= MAX_CORES:
            out.append((idx, name, fam, variant, cores, mem, price_of(name), FAMILY_PRIORITY.get(fam, 99)))
    return out


# ---------------------------------------------------------------------------------
# P4 - P6

def cluster_demand(metrics: DataFrame, s: Strategy) -> DataFrame:
    """Max p95 executors x max concurrency, buffered, per cluster (+ recipes)."""
    m = normalize_metrics(metrics)
    buf = s.weights[5]
    return m.groupBy("cluster_name").agg(
        F.max("p95_run_max_executors").alias("target_exec_per_job"),
        F.max("max_concurrent_jobs").alias("max_concurrent_jobs"),
        F.count(F.lit(1)).alias("recipes"),
    ).select("cluster_name", "recipes", "target_exec_per_job", "max_concurrent_jobs",
             (F.col("target_exec_per_job") * F.col("max_concurrent_jobs")).alias("demand"),
             F.greatest(F.lit(1.0), F.col("target_exec_per_job") * F.col("max_concurrent_jobs") * (1.0 + buf))
             .alias("req_slots"))


def candidate_scores(metrics: DataFrame, s: Strategy = STRATEGIES["default"]) -> DataFrame:
    """P5 + P6: every (cluster, candidate shape) with its evaluation and base score
    (before the quota-pressure term added by the fold)."""
    cw, sw, uw, ww, ow, _ = s.weights
    core_pref = 8 if s.prefer_eight else s.executor_cores
    shapes = F.array(*[F.struct(F.lit(i).alias("catalog_idx"), F.lit(n).alias("machine_type"),
                                F.lit(f).alias("family"), F.lit(v).alias("variant"), F.lit(c).alias("cores"),
                                F.lit(m).alias("memory_gb"), F.lit(p).alias("price_eur_per_hour"),
                                F.lit(pr).alias("family_priority"))
                       for i, n, f, v, c, m, p, pr in candidate_shapes()])
    d = cluster_demand(metrics, s).select("cluster_name", "demand", "req_slots", F.inline(shapes))
    epw = executors_per_worker(F.col("cores"), F.col("memory_gb"), core_pref, s.executor_memory_gb,
                               s.memory_overhead_ratio, s.os_and_daemons_reserve_gb)
    d = d.withColumn("executors_per_worker", epw)
    raw_workers = F.greatest(F.lit(MIN_WORKERS), F.ceil(F.col("req_slots") / F.greatest(F.lit(1), epw)))
    workers = F.when(F.col("family").isin("c3", "c4") & F.lit(C3C4_MAX_WORKERS > 0),
                     F.least(raw_workers, F.lit(C3C4_MAX_WORKERS))).otherwise(raw_workers).cast("int")
    d = d.withColumn("workers", workers)
    desired = F.lit(float(core_pref)) * F.col("req_slots")
    total_cores = F.col("cores") * F.col("workers")
    base_cost = F.col("price_eur_per_hour") * F.col("workers") + F.col("price_eur_per_hour")
    penalty = F.when(F.col("workers") > s.prefer_max_workers,
                     base_cost * s.per_worker_penalty_pct * (F.col("workers") - s.prefer_max_workers)).otherwise(0.0)
    d = d.select(
        "*", (F.col("executors_per_worker") * F.col("workers")).alias("capacity_slots"),
        total_cores.alias("total_cores"),
        F.least(F.lit(1.0), total_cores / F.greatest(F.lit(1.0), desired)).alias("core_sufficiency"),
        F.least(F.lit(1.0), desired / F.greatest(F.lit(1.0), total_cores)).alias("utilization"),
        (base_cost + penalty).alias("hourly_cost"),
        (total_cores / F.greatest(F.lit(1.0), desired)).alias("oversize_ratio"),
    ).withColumn("capacity_shortfall", F.greatest(F.lit(0.0), F.col("req_slots") - F.col("capacity_slots")))
    # Min-max normalisation across the 23 candidates of a cluster; the rows already lie by cluster
    same = Window.partitionBy("cluster_name")
    d = d.withColumns({"_cmin": F.min("hourly_cost").over(same), "_cmax": F.max("hourly_cost").over(same),
                       "_wmin": F.min("workers").over(same), "_wmax": F.max("workers").over(same)})
    cost_norm = (F.col("hourly_cost") - F.col("_cmin")) / F.greatest(F.lit(1e-9), F.col("_cmax") - F.col("_cmin"))
    workers_norm = (F.col("workers") - F.col("_wmin")) / F.greatest(F.lit(1e-9), (F.col("_wmax") - F.col("_wmin")).cast("double"))
    cap_pen = F.when(F.col("capacity_shortfall") > 0, 100.0 * (F.col("capacity_shortfall") / F.col("req_slots"))) \
        .otherwise(0.0)
    over_pen = F.when(F.col("oversize_ratio") > OVERSIZE_THRESHOLD,
                      ow * (F.col("oversize_ratio") - OVERSIZE_THRESHOLD)).otherwise(0.0)
    bonus = F.when(F.col("cores") == PREFERRED_CORES, F.lit(PREFERRED_CORE_BONUS)).otherwise(0.0)
    score = (cw * cost_norm + ww * workers_norm - sw * F.col("core_sufficiency") - uw * F.col("utilization")
             + cap_pen + over_pen + bonus)
    return d.select(
        "cluster_name", "demand", "req_slots", "catalog_idx", "machine_type", "family", "cores", "memory_gb",
        "family_priority", "executors_per_worker", "workers", "capacity_slots", "total_cores", "core_sufficiency",
        "utilization", "hourly_cost", "oversize_ratio", "capacity_shortfall", cost_norm.alias("cost_norm"),
        workers_norm.alias("workers_norm"), score.alias("base_score"))


# ---------------------------------------------------------------------------------
# The quota fold.  The pick for one cluster changes the pressure on the next, so it is ordered by nature.
# Its group is one quota pool (scenario): one row per cluster with the few candidates that can win.

POOLS = ("within_quota", "hard_constraints", "all")

PLAN_SCHEMA = T.StructType([
    T.StructField("scenario", T.StringType()), T.StructField("plan_order", T.IntegerType()),
    T.StructField("cluster_name", T.StringType()), T.StructField("worker_machine_type", T.StringType()),
    T.StructField("master_machine_type", T.StringType()), T.StructField("workers", T.IntegerType()),
    T.StructField("executors_per_worker", T.IntegerType()), T.StructField("max_executors_supported", T.IntegerType()),
    T.StructField("score", T.DoubleType()), T.StructField("pool", T.StringType()),
])


def _quota_fold(quotas: dict[str, dict], by: str):
    """The fold over one row per cluster; ``quotas``: family quotas per scenario."""
    keys, ascending = (["cluster_name"], [True]) if by == "name" else (["demand", "cluster_name"], [False, True])
    most_clusters = {"c3": C3_MAX_CLUSTERS, "c4": C4_MAX_CLUSTERS}

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        limit = quotas[key[0]]
        used, clusters = defaultdict(int), defaultdict(int)

        def rank(c: dict) -> tuple:
            family, quota = c["family"], limit.get(c["family"], 0)
            blocked = clusters[family] >= most_clusters.get(family, math.inf)
            fits = quota == 0 or used[family] + c["total_cores"] <= quota
            pressure = used[family] / quota if quota > 0 else 0.0
            return (2 if blocked else 0 if fits else 1, c["base_score"] + FAMILY_PRIORITY_WEIGHT * pressure,
                    c["family_priority"], c["catalog_idx"])

        out = []
        for n, row in enumerate(pdf.sort_values(keys, ascending=ascending).itertuples(index=False)):
            best = min(row.candidates, key=rank)
            tier, score, *_ = rank(best)
            used[best["family"]] += best["total_cores"]
            clusters[best["family"]] += 1
            out.append((key[0], n, row.cluster_name, best["machine_type"], best["machine_type"], best["workers"],
                        best["executors_per_worker"], best["workers"] * best["executors_per_worker"], score, POOLS[tier]))
        return pd.DataFrame(out, columns=[f.name for f in PLAN_SCHEMA.fields])

    return fold


def possible_winners(scored: DataFrame) -> DataFrame:
    """One row per (scenario, cluster) with the candidates that can win, whatever was admitted before.

    Pressure, quota and blocking are the same within a family, so a candidate that another one of its
    family beats in score and order, with no more cores, never wins.
    """
    c = scored.groupBy("scenario", "cluster_name").agg(
        F.max("demand").alias("demand"),
        F.collect_list(F.struct("family", "machine_type", "catalog_idx", "family_priority", "executors_per_worker",
                                "workers", "total_cores", "base_score")).alias("candidates"))  # 23 shapes at most

    def beats(y: Column, x: Column) -> Column:
        return ((y["family"] == x["family"]) & (y["total_cores"] <= x["total_cores"])
                & (y["base_score"] <= x["base_score"]) & (y["catalog_idx"] < x["catalog_idx"])) | (
            (y["family"] == x["family"]) & (y["total_cores"] <= x["total_cores"]) & (y["base_score"] < x["base_score"] - 1e-9))

    return c.withColumn("candidates", F.filter(
        "candidates", lambda x: ~F.exists("candidates", lambda y: beats(y, x))))


def fold_scenarios(scored: DataFrame, strategies: dict[str, Strategy], order: str = "demand") -> DataFrame:
    """P7 for several scenarios (column ``scenario``), each with quotas of its own and a task of its own."""
    fold = _quota_fold({name: dict(s.quotas) for name, s in strategies.items()}, order)
    return possible_winners(scored).groupBy("scenario").applyInPandas(fold, schema=PLAN_SCHEMA)


def cluster_plans(scored: DataFrame, s: Strategy = STRATEGIES["default"], scenario: str | None = None,
                  order: str = "demand") -> DataFrame:
    """Quota admission (within quota -> not hard-blocked -> all); arg-min of
    (score + pressure, family priority, catalogue order).  ``order``: ``demand``
    (single-snapshot tuner, most demanding first) or ``name`` (comparison run)."""
    name = scenario or s.name
    return fold_scenarios(scored.withColumn("scenario", F.lit(name)), {name: s}, order)


def strategy_plans(metrics: DataFrame, strategies: dict[str, Strategy] = STRATEGIES) -> DataFrame:
    """P7 + P13: the plans of every strategy over the same metrics."""
    scored = [candidate_scores(metrics, s).withColumn("scenario", F.lit(name)) for name, s in strategies.items()]
    return fold_scenarios(functools.reduce(DataFrame.unionByName, scored), strategies)


# ---------------------------------------------------------------------------------
# P8 - P12

def _with_worker_shape(plans: DataFrame) -> DataFrame:
    """Worker variant / cores / memory from the catalogue (173 rows, broadcast)."""
    cat = machine_catalog(plans.sparkSession).select(
        F.col("machine_type").alias("worker_machine_type"), F.col("variant").alias("worker_variant"),
        F.col("cores").alias("worker_cores"), F.col("memory_gb").alias("worker_memory_gb"))
    return plans.join(cat, "worker_machine_type", "left")


def manual_plans(plans: DataFrame, metrics: DataFrame, s: Strategy = STRATEGIES["default"]) -> DataFrame:
    """Instances from p95 (or avg / round-up p95), cap-hit boost, clamped to the
    cluster's capacity; 8-core executors when they fit."""
    m = normalize_metrics(metrics)
    p = _with_worker_shape(plans).select("cluster_name", "workers", "max_executors_supported", "worker_variant",
                                         "worker_cores", "worker_memory_gb")
    j = m.join(p, "cluster_name")
    base = {"avg": F.col("avg_executors_per_job"),
            "round_up_p95": F.ceil("p95_run_max_executors").cast("double")}.get(
        s.manual_instances_from, F.col("p95_run_max_executors"))
    boosted = F.when(F.col("fraction_reaching_cap") >= s.cap_hit_threshold, base * (1.0 + s.cap_hit_boost_pct)) \
        .otherwise(base)
    desired = F.ceil(boosted).cast("int")
    capped = F.greatest(F.lit(s.min_executor_instances), F.least(desired, F.col("max_executors_supported")))
    epw8 = executors_per_worker(F.col("worker_cores"), F.col("worker_memory_gb"), 8, s.executor_memory_gb,
                                s.memory_overhead_ratio, s.os_and_daemons_reserve_gb)
    can8 = F.lit(s.prefer_eight) & (epw8 * F.col("workers") >= capped)
    cores = F.when(can8, F.lit(8)).otherwise(F.lit(s.executor_cores))
    j = j.withColumn("spark_executor_instances", capped.cast("int")).withColumn("spark_executor_cores", cores)
    mem = recommended_executor_memory(F.col("worker_variant"), F.col("worker_memory_gb"),
                                      F.col("spark_executor_cores"), s)
    return j.select("cluster_name", "recipe_filename", "spark_executor_instances", "spark_executor_cores",
                    mem.alias("spark_executor_memory_gb"))


def da_plans(plans: DataFrame, metrics: DataFrame, s: Strategy = STRATEGIES["default"]) -> DataFrame:
    """P10: dynamic allocation min / initial / max executors (min is not clamped
    to capacity, so it can exceed max -- flagged, Q12)."""
    m = normalize_metrics(metrics)
    p = _with_worker_shape(plans).select("cluster_name", "max_executors_supported", "worker_variant",
                                         "worker_memory_gb")
    j = m.join(p, "cluster_name")
    sup = F.col("max_executors_supported")
    min_raw = F.lit(2) if s.da_min_from == "fixed2" else F.ceil("avg_executors_per_job")
    min_e = F.greatest(F.lit(2), F.greatest(F.lit(s.min_executor_instances), min_raw)).cast("int")
    j = j.withColumn("min_executors", min_e)
    init_base = F.col("min_executors") if s.da_initial_equals_min else F.least(F.col("min_executors") + 1, sup)
    j = j.withColumn("initial_executors", F.greatest(F.lit(2), F.least(init_base, sup)).cast("int"))
    need_more = F.col("p95_run_max_executors") > (F.col("min_executors") + 1)
    max_raw = F.when(need_more, F.ceil("p95_run_max_executors")).otherwise(F.col("min_executors") + 1)
    max_e = F.greatest(F.col("initial_executors"), F.least(max_raw, sup)).cast("int")
    cores = 8 if s.prefer_eight else s.executor_cores
    mem = recommended_executor_memory(F.col("worker_variant"), F.col("worker_memory_gb"), F.lit(cores), s)
    return j.select("cluster_name", "recipe_filename", "min_executors", max_e.alias("max_executors"),
                    "initial_executors", F.lit(cores).alias("spark_executor_cores"),
                    mem.alias("spark_executor_memory_gb"),
                    (F.col("min_executors") > max_e).alias("min_exceeds_max"))


def autoscaling_policy(workers: Column) -> Column:
    """Policy bracket by planned workers."""
    out = F.lit(AUTOSCALING_BRACKETS[-1][1])
    for hi, name, _ in reversed(AUTOSCALING_BRACKETS):
        out = F.when(workers <= hi, F.lit(name)).otherwise(out)
    return out


def max_workers_for_cluster(workers: Column) -> Column:
    """Worker ceiling 4 / 6 / 8 / 10, else the planned count."""
    out = workers
    for hi, _, ceiling in reversed(AUTOSCALING_BRACKETS):
        out = F.when(workers <= hi, F.lit(ceiling)).otherwise(out)
    return out


def cluster_config(plans: DataFrame, manual: DataFrame) -> DataFrame:
    """Cluster roll-up written into the per-cluster config."""
    p = _with_worker_shape(plans)
    acc = manual.groupBy("cluster_name").agg(
        F.sum(F.col("spark_executor_instances") * F.col("spark_executor_memory_gb")).alias(
            "accumulated_max_total_memory_per_jobs_gb"),
        F.count(F.lit(1)).alias("total_no_of_jobs"))
    return p.join(acc, "cluster_name", "left").select(
        "cluster_name", F.col("workers").alias("num_workers"), "master_machine_type", "worker_machine_type",
        autoscaling_policy(F.col("workers")).alias("autoscaling_policy"),
        F.coalesce("total_no_of_jobs", F.lit(0)).alias("total_no_of_jobs"),
        (F.col("workers") * F.col("worker_memory_gb")).alias("cluster_max_total_memory_gb"),
        (F.col("workers") * F.col("worker_cores")).alias("cluster_max_total_cores"),
        F.coalesce("accumulated_max_total_memory_per_jobs_gb", F.lit(0)).alias(
            "accumulated_max_total_memory_per_jobs_gb"))


def machine_rollup(plans: DataFrame) -> DataFrame:
    """Per worker shape -- workers, cores, ceiling workers and cores,
    sorted distinct cluster names joined by ';'."""
    p = _with_worker_shape(plans)
    ceiling = max_workers_for_cluster(F.col("workers"))
    g = p.groupBy("worker_machine_type").agg(
        F.sum("workers").alias("estimated_max_no_of_workers"),
        F.max("worker_cores").alias("_cores"),
        F.sum(ceiling).alias("real_max_no_of_workers"),
        F.array_join(F.array_sort(F.collect_set("cluster_name")), ";").alias("clusters_list"))
    return g.select(F.col("worker_machine_type").alias("machine_type"), "estimated_max_no_of_workers",
                    (F.col("estimated_max_no_of_workers") * F.col("_cores")).alias("estimated_max_no_of_cores"),
                    "real_max_no_of_workers",
                    (F.col("real_max_no_of_workers") * F.col("_cores")).alias("real_max_no_of_cores"),
                    "clusters_list").orderBy(F.desc("estimated_max_no_of_cores"), "machine_type")


def quota_usage(plans: DataFrame, s: Strategy = STRATEGIES["default"]) -> DataFrame:
    """Cores used per family against the quota, % used."""
    p = _with_worker_shape(plans)
    used = p.groupBy(F.split_part("worker_machine_type", F.lit("-"), F.lit(1)).alias("family")).agg(
        F.sum(F.col("workers") * F.col("worker_cores")).alias("used_cores"))
    q = used.sparkSession.createDataFrame(sorted(s.quotas.items()), "family string, quota_cores int")
    return (q.join(used, "family", "left")
            .select("family", F.coalesce("used_cores", F.lit(0)).alias("used_cores"), "quota_cores",
                    F.when(F.col("quota_cores") > 0, F.coalesce("used_cores", F.lit(0)) * 100.0 / F.col("quota_cores"))
                    .otherwise(0.0).alias("pct_used")))


def generation_summary(plans: DataFrame, s: Strategy = STRATEGIES["default"],
                       signals: DataFrame | None = None) -> DataFrame:
    """K5 / P14 entries: shape, ceiling, cores, bias mode, topology, diagnostic descriptions per cluster."""
    p = _with_worker_shape(plans)
    ceiling = max_workers_for_cluster(F.col("workers"))
    out = p.select("cluster_name", "worker_machine_type",
                   F.split_part("worker_machine_type", F.lit("-"), F.lit(1)).alias("worker_family"),
                   F.col("workers").alias("num_workers"), ceiling.alias("max_workers_from_policy"),
                   (F.col("workers") * F.col("worker_cores")).alias("total_cores"),
                   (ceiling * F.col("worker_cores")).alias("max_total_cores"), "scenario",
                   F.lit(s.bias).alias("bias_mode"), F.lit(s.topology).alias("topology"))
    if signals is not None:
        d = signals.select("cluster_name", F.filter(F.array("eviction_description", "pattern_description"),
                                                   lambda x: x.isNotNull()).alias("diagnostic_signals"))
        out = out.join(d, "cluster_name", "left")
    return out


def generation_totals(plans: DataFrame) -> DataFrame:
    """Total predicted nodes sum(workers + 1) and max nodes sum(ceiling + 1)."""
    ceiling = max_workers_for_cluster(F.col("workers"))
    return plans.agg(F.count(F.lit(1)).alias("total_clusters"),
                     F.sum(F.col("workers") + 1).alias("total_predicted_nodes"),
                     F.sum(ceiling + 1).alias("total_max_nodes"))


def cluster_summary(plans: DataFrame, metrics: DataFrame, cost: DataFrame | None = None,
                    stats: DataFrame | None = None, dag_map: DataFrame | None = None,
                    timer_map: DataFrame | None = None) -> DataFrame:
    """Plan + cost + worker stats + DAG / timer lookups (with defaults)."""
    jobs = normalize_metrics(metrics).groupBy("cluster_name").agg(F.count(F.lit(1)).alias("no_of_jobs"))
    out = plans.select("cluster_name", F.col("workers").alias("num_of_workers"), "worker_machine_type",
                       "master_machine_type").join(jobs, "cluster_name", "left")
    if cost is not None:
        out = out.join(cost.select("cluster_name", F.col("wall_clock_minutes").alias("total_active_minutes"),
                                   "estimated_cost_eur"), "cluster_name", "left")
    else:
        out = out.withColumn("total_active_minutes", F.lit(0.0)).withColumn("estimated_cost_eur", F.lit(0.0))
    if stats is not None:
        out = out.join(stats.select("cluster_name", F.col("avg_workers").alias("real_used_avg_num_of_workers"),
                                    F.col("min_workers").alias("real_used_min_workers"),
                                    F.col("max_workers").alias("real_used_max_workers")), "cluster_name", "left")
    else:
        out = (out.withColumn("real_used_avg_num_of_workers", F.lit(0.0))
               .withColumn("real_used_min_workers", F.lit(0)).withColumn("real_used_max_workers", F.lit(0)))
    if dag_map is not None:
        out = out.join(dag_map.select("cluster_name", "dag_id"), "cluster_name", "left")
    else:
        out = out.withColumn("dag_id", F.lit(None).cast("string"))
    if timer_map is not None:
        out = out.join(timer_map.select("cluster_name", "timer_name", "timer_time"), "cluster_name", "left")
    else:
        out = out.withColumn("timer_name", F.lit(None).cast("string")).withColumn("timer_time", F.lit(None).cast("string"))
    return out.select(
        "cluster_name", F.coalesce("dag_id", F.lit("UNKNOWN_DAG_ID")).alias("dag_id"),
        F.coalesce("no_of_jobs", F.lit(0)).alias("no_of_jobs"), "num_of_workers", "worker_machine_type",
        "master_machine_type", F.coalesce("real_used_avg_num_of_workers", F.lit(0.0)).alias("real_used_avg_num_of_workers"),
        F.coalesce("real_used_min_workers", F.lit(0)).alias("real_used_min_workers"),
        F.coalesce("real_used_max_workers", F.lit(0)).alias("real_used_max_workers"),
        F.coalesce("total_active_minutes", F.lit(0.0)).alias("total_active_minutes"),
        F.coalesce("estimated_cost_eur", F.lit(0.0)).alias("estimated_cost_eur"),
        F.coalesce("timer_name", F.lit("ZERO_TIMER")).alias("timer_name"),
        F.coalesce("timer_time", F.lit("00:00")).alias("timer_time"))


SUMMARY_ORDERS = {  # O3: report name -> descending metric (base: workers, then jobs), then cluster name ascending
    "base": None, "by_jobs": "no_of_jobs", "by_workers": "num_of_workers",
    "by_cost": "estimated_cost_eur", "by_minutes": "total_active_minutes",
}


def summary_report(summary: DataFrame, order: str = "by_cost", only_wf: bool = False) -> DataFrame:
    """A sorted summary; ``only_wf`` keeps names starting ``cluster-wf-``."""
    out = summary.filter(F.col("cluster_name").startswith("cluster-wf-")) if only_wf else summary
    metric = SUMMARY_ORDERS[order]
    first = [F.desc(metric)] if metric else [F.desc("num_of_workers"), F.desc("no_of_jobs")]
    return out.orderBy(*first, F.asc("cluster_name"))

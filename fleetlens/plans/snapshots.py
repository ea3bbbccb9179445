"""Two-snapshot comparison: pairing, deltas, trend classes, evolution decisions.

A snapshot is a per-(cluster, recipe) metric table (the b13 schema).  All
operators here are joins and per-row expressions over the paired table --
one full outer join on the key, no per-cluster loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import pct_change

KEYS = ["cluster_name", "recipe_filename"]

# Metric names, trend thresholds and labels.
METRICS = ["avg_executors_per_job", "p95_run_max_executors", "avg_job_duration_ms",
           "p95_job_duration_ms", "fraction_reaching_cap", "runs"]
DURATION_DEGRADATION_PCT = 10.0
DURATION_IMPROVEMENT_PCT = -5.0
CAP_HIT_DEGRADATION_PCT = 15.0
CONFIDENCE_RUNS = 10.0

IMPROVED, DEGRADED, STABLE, NEW_ENTRY, DROPPED_ENTRY = (
    "improved", "degraded", "stable", "new_entry", "dropped_entry")
KEEP_AS_IS, BOOST_RESOURCES, PRESERVE_HISTORICAL, GENERATE_FRESH = (
    "keep_as_is", "boost_resources", "preserve_historical", "generate_fresh")


def normalize_metrics(m: DataFrame) -> DataFrame:
    """S3 defaults: a metric row as the tuner reads it (missing -> default)."""
    avg_dur = F.coalesce(F.col("avg_job_duration_ms").cast("double"), F.lit(0.0))
    return m.select(
        *KEYS,
        F.coalesce(F.col("avg_executors_per_job").cast("double"), F.lit(1.0)).alias("avg_executors_per_job"),
        F.coalesce(F.col("p95_run_max_executors").cast("double"), F.lit(1.0)).alias("p95_run_max_executors"),
        avg_dur.alias("avg_job_duration_ms"),
        F.coalesce(F.col("p95_job_duration_ms").cast("double"), avg_dur).alias("p95_job_duration_ms"),
        F.coalesce(F.col("runs").cast("long"), F.lit(0)).alias("runs"),
        F.col("seconds_at_cap").cast("long").alias("seconds_at_cap"),
        F.col("runs_reaching_cap").cast("long").alias("runs_reaching_cap"),
        F.col("total_runs").cast("long").alias("total_runs"),
        F.col("fraction_reaching_cap").cast("double").alias("fraction_reaching_cap"),
        F.coalesce(F.col("max_concurrent_jobs").cast("int"), F.lit(1)).alias("max_concurrent_jobs"),
    )


def metric_value(prefix: str, name: str) -> Column:
    """Value of a compared metric; missing cap fraction counts as 0 (Q11)."""
    c = F.col(f"{prefix}{name}")
    if name == "fraction_reaching_cap":
        return F.coalesce(c, F.lit(0.0))
    return c.cast("double")


def pair_snapshots(reference: DataFrame, current: DataFrame) -> DataFrame:
    """One full outer join; ``status`` = paired / new / dropped."""
    ref = normalize_metrics(reference)
    cur = normalize_metrics(current)
    r = ref.select(*KEYS, F.lit(True).alias("_in_ref"),
                   *[F.col(c).alias(f"ref_{c}") for c in ref.columns if c not in KEYS])
    c = cur.select(*KEYS, F.lit(True).alias("_in_cur"),
                   *[F.col(x).alias(f"cur_{x}") for x in cur.columns if x not in KEYS])
    j = r.join(c, KEYS, "full_outer")
    status = (F.when(F.col("_in_ref") & F.col("_in_cur"), "paired")
              .when(F.col("_in_cur"), "new").otherwise("dropped"))
    return j.withColumn("status", status).drop("_in_ref", "_in_cur")


def metric_deltas(pairs: DataFrame) -> DataFrame:
    """Long form (cluster, recipe, metric) with ref, cur, abs and pct change."""
    p = pairs.filter(F.col("status") == "paired")
    rows = F.array(*[F.struct(F.lit(m).alias("metric_name"),
                              metric_value("ref_", m).alias("reference_value"),
                              metric_value("cur_", m).alias("current_value")) for m in METRICS])
    long = p.select(*KEYS, F.inline(rows))
    return long.select(
        *KEYS, "metric_name", "reference_value", "current_value",
        (F.col("current_value") - F.col("reference_value")).alias("absolute_change"),
        pct_change("reference_value", "current_value").alias("percentage_change"))


def trend_class(pairs: DataFrame) -> DataFrame:
    """T2 + T3: trend label and confidence per (cluster, recipe)."""
    p95_pct = pct_change(metric_value("ref_", "p95_job_duration_ms"),
                         metric_value("cur_", "p95_job_duration_ms"))
    cap_pct = pct_change(metric_value("ref_", "fraction_reaching_cap"),
                         metric_value("cur_", "fraction_reaching_cap"))
    cap_cur = metric_value("cur_", "fraction_reaching_cap")
    degraded = (p95_pct > DURATION_DEGRADATION_PCT) | ((cap_pct > CAP_HIT_DEGRADATION_PCT) & (cap_cur > 0))
    improved = (p95_pct < DURATION_IMPROVEMENT_PCT) & (cap_pct <= CAP_HIT_DEGRADATION_PCT)
    paired = F.col("status") == "paired"
    trend = (F.when(F.col("status") == "new", NEW_ENTRY)
             .when(F.col("status") == "dropped", DROPPED_ENTRY)
             .when(degraded, DEGRADED).when(improved, IMPROVED).otherwise(STABLE))
    conf = F.when(paired, F.least(F.lit(1.0), F.least("ref_runs", "cur_runs") / CONFIDENCE_RUNS)) \
        .otherwise(F.lit(0.0))
    return pairs.select(
        *KEYS, trend.alias("trend"), conf.alias("confidence"),
        F.when(paired, p95_pct).alias("p95_pct_change"),
        F.when(paired, cap_pct).alias("cap_pct_change"),
        F.when(paired, metric_value("ref_", "p95_job_duration_ms")).alias("p95_duration_ref"),
        F.when(paired, metric_value("cur_", "p95_job_duration_ms")).alias("p95_duration_cur"),
        "status")


def _fmt1(c: Column) -> Column:
    return F.format_string("%.1f", c)


def evolution_decisions(trends: DataFrame, keep_historical: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """T4: action and reason text per (cluster, recipe); ``keep`` names columns of ``trends`` to pass on."""
    top_is_cap = F.abs(F.col("cap_pct_change")) >= F.abs(F.col("p95_pct_change"))
    top_name = F.when(top_is_cap, F.lit("fraction_reaching_cap")).otherwise(F.lit("p95_job_duration_ms"))
    top_pct = F.when(top_is_cap, F.col("cap_pct_change")).otherwise(F.col("p95_pct_change"))
    t = F.col("trend")
    action = (F.when(t == DEGRADED, BOOST_RESOURCES).when(t == NEW_ENTRY, GENERATE_FRESH)
              .when((t == DROPPED_ENTRY) & F.lit(keep_historical), PRESERVE_HISTORICAL)
              .otherwise(KEEP_AS_IS))
    dropped_reason = ("Recipe absent from current date. Preserving historical config for future evolution."
                      if keep_historical else
                      "Recipe absent from current date. Skipped (keep-historical=false).")
    reason = (F.when(t == IMPROVED, F.concat(F.lit("Performance improved (confidence="),
                                             _fmt1(F.col("confidence")),
                                             F.lit("). Keeping reference config.")))
              .when(t == DEGRADED, F.concat(F.lit("Performance degraded: "), top_name, F.lit(" changed "),
                                            _fmt1(top_pct),
                                            F.lit("%. Re-planning with current metrics.")))
              .when(t == STABLE, F.concat(F.lit("Performance stable (confidence="),
                                          _fmt1(F.col("confidence")),
                                          F.lit("). Keeping reference config.")))
              .when(t == NEW_ENTRY, F.lit("New recipe not present in reference date. Generating fresh config."))
              .otherwise(F.lit(dropped_reason)))
    return trends.select(*KEYS, "trend", "confidence", action.alias("action"), reason.alias("reason"),
                         *[c for c in keep if c in trends.columns])


def cluster_actions(decisions: DataFrame) -> DataFrame:
    """T5: any boost > any fresh > keep (paired entries come first) > preserve."""
    a = F.col("action")
    return decisions.groupBy("cluster_name").agg(
        F.bool_or(a == BOOST_RESOURCES).alias("_b"), F.bool_or(a == GENERATE_FRESH).alias("_f"),
        F.bool_or(a == KEEP_AS_IS).alias("_k"),
    ).select("cluster_name", F.when(F.col("_b"), BOOST_RESOURCES).when(F.col("_f"), GENERATE_FRESH)
             .when(F.col("_k"), KEEP_AS_IS).otherwise(PRESERVE_HISTORICAL).alias("cluster_action"))


def cluster_trend_rollup(trends: DataFrame) -> DataFrame:
    """Degraded if any; improved if all; mixed if any improved; else stable."""
    t = F.col("trend")
    return trends.groupBy("cluster_name").agg(
        F.bool_or(t == DEGRADED).alias("_d"), F.bool_and(t == IMPROVED).alias("_a"),
        F.bool_or(t == IMPROVED).alias("_i"), F.count(F.lit(1)).alias("recipes"),
    ).select("cluster_name", F.when(F.col("_d"), "degraded").when(F.col("_a"), "improved")
             .when(F.col("_i"), "mixed").otherwise("stable").alias("overall_trend"), "recipes")


def trend_counts(trends: DataFrame) -> DataFrame:
    """Recipes per trend label and distinct clusters per label."""
    return trends.groupBy("trend").agg(F.count(F.lit(1)).alias("recipes"),
                                       F.count_distinct("cluster_name").alias("clusters"))


def trend_summary(trends: DataFrame) -> DataFrame:
    """The trend-summary report row (p95 ref/cur/pct, action, reason), a projection of ``trends``."""
    d = evolution_decisions(trends, keep=("p95_duration_ref", "p95_duration_cur", "p95_pct_change"))
    return d.select(*KEYS, "trend", "confidence", "action", "reason", "p95_duration_ref", "p95_duration_cur",
                    F.col("p95_pct_change").alias("p95_duration_pct_change"))


def cluster_active_minutes(metrics: DataFrame) -> DataFrame:
    """Sum over a cluster's recipes of the average run duration, in minutes."""
    m = normalize_metrics(metrics)
    return m.groupBy("cluster_name").agg((F.sum(F.col("avg_job_duration_ms") / 60000.0)).alias("active_minutes"))

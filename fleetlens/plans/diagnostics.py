"""Driver-failure diagnostics (D1-D5): exit-code signals, driver overrides,
master promotion ladder, promotion baseline and state.

Input is the b14 table (timestamp, job_id, cluster_name, driver_exit_code,
msg).  Everything is a grouped aggregation per cluster; job samples use the
salted top-k so a cluster with very many evicted jobs is never collected
whole.  The promotion ladder is a 173-row dimension computed with joins over
the machine catalogue and broadcast into lookups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.params import broadcast_bounded
from ..operators.topk import top_k
from .catalog import machine_catalog

# YARN eviction exit code and the driver boost heuristic.
YARN_EVICTION_CODE = 247
DRIVER_MEMORY_BOOST_GB = 4
DRIVER_MIN_CORES = 4
SAMPLE_JOBS = 3


def exit_codes(b14: DataFrame) -> DataFrame:
    """Quotes stripped from the cluster name; rows without an integer code dropped."""
    c = F.trim(F.regexp_replace(F.col("cluster_name").cast("string"), '"', ""))
    return (b14.select(F.col("timestamp").cast("string").alias("timestamp"), "job_id", c.alias("cluster_name"),
                       F.col("driver_exit_code").cast("string").try_cast("int").alias("driver_exit_code"),
                       F.col("timestamp").cast("timestamp").alias("_ts"))
            .filter((F.col("cluster_name") != "") & F.col("driver_exit_code").isNotNull()
                    & F.col("job_id").isNotNull()))


def exit_signals(exits: DataFrame) -> DataFrame:
    """Per cluster -- YARN evictions (count, all distinct jobs, and the 3 most recent
    for the description) and the
    dominant other non-zero exit code (mode; ties -> lowest code)."""
    ev = exits.filter(F.col("driver_exit_code") == YARN_EVICTION_CODE)
    per_job = ev.groupBy("cluster_name", "job_id").agg(F.max("_ts").alias("_last"))
    counts = ev.groupBy("cluster_name").agg(F.count(F.lit(1)).alias("eviction_count"))
    jobs = per_job.groupBy("cluster_name").agg(F.count(F.lit(1)).alias("evicted_jobs"),
                                               F.sort_array(F.collect_list("job_id")).alias("jobs"))
    sample = (top_k(per_job, ["cluster_name"], [F.desc("_last"), F.asc("job_id")], SAMPLE_JOBS,
                    salt_cols=["job_id"])
              .groupBy("cluster_name")
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "job_id"))),
                               lambda s: s["job_id"]).alias("sample_jobs")))
    evictions = counts.join(jobs, "cluster_name").join(sample, "cluster_name")
    evictions = evictions.withColumn("eviction_description", F.concat(
        F.lit("YARN driver evicted "), F.col("eviction_count").cast("string"),
        F.lit(" time(s) (exit 247). Sample jobs: "), F.array_join("sample_jobs", ", ")))
    others = (exits.filter(F.col("driver_exit_code") != YARN_EVICTION_CODE)
              .groupBy("cluster_name", "driver_exit_code").agg(F.count(F.lit(1)).alias("_n")))
    dominant = others.groupBy("cluster_name").agg(
        F.max(F.struct("_n", (-F.col("driver_exit_code")).alias("_neg"))).alias("_m"))
    dominant = dominant.select(
        "cluster_name", (-F.col("_m._neg")).alias("dominant_exit_code"), F.col("_m._n").alias("dominant_count"))
    dominant = dominant.withColumn("pattern_description", F.concat(
        F.lit("Non-zero exit code "), F.col("dominant_exit_code").cast("string"), F.lit(" occurred "),
        F.col("dominant_count").cast("string"), F.lit(" time(s)")))
    return evictions.join(dominant, "cluster_name", "full_outer").select(
        "cluster_name", F.coalesce("eviction_count", F.lit(0)).alias("eviction_count"),
        F.coalesce("evicted_jobs", F.lit(0)).alias("evicted_jobs"), "sample_jobs", "jobs", "eviction_description",
        "dominant_exit_code", "dominant_count", "pattern_description")


def driver_overrides(signals: DataFrame, base_memory_gb: int = 4, base_cores: int = 2) -> DataFrame:
    """Driver memory +4 GB, cores at least 4, overhead max(1, memory / 4)."""
    mem = base_memory_gb + DRIVER_MEMORY_BOOST_GB
    return signals.filter(F.col("eviction_count") > 0).select(
        "cluster_name", F.lit(mem).alias("driver_memory_gb"),
        F.lit(max(base_cores, DRIVER_MIN_CORES)).alias("driver_cores"),
        F.lit(max(1, mem // 4)).alias("driver_memory_overhead_gb"),
        F.col("eviction_description").alias("diagnostic_reason"))


def promotion_ladder(spark: SparkSession) -> DataFrame:
    """D3 as a dimension: catalogue shape -> promoted master shape.

    variant step (highcpu -> standard -> highmem, same cores), else the next
    larger core count of the same family and variant, else for e2 the n2 shape
    of the same variant (or n2-standard) with the same cores, else unchanged.
    """
    cat = machine_catalog(spark).select("machine_type", "family", "variant", "cores", "memory_gb")
    names = cat.select(F.col("machine_type").alias("_target"))
    up_variant = F.when(F.col("variant") == "highcpu", "standard").when(F.col("variant") == "standard", "highmem")
    step1 = cat.select("machine_type", F.concat_ws("-", "family", up_variant, F.col("cores").cast("string"))
                       .alias("_target"))
    step1 = step1.join(names, "_target").select("machine_type", F.col("_target").alias("variant_step"))
    # next larger core count of the same family and variant: the following shape in core order
    by_cores = Window.partitionBy("family", "variant").orderBy("cores")
    step2 = cat.select("machine_type", F.lead("machine_type").over(by_cores).alias("core_step"))
    n2_same = F.concat(F.lit("n2-"), F.col("variant"), F.lit("-"), F.col("cores").cast("string"))
    n2_std = F.concat(F.lit("n2-standard-"), F.col("cores").cast("string"))
    cross = (cat.filter(F.col("family") == "e2")
             .select("machine_type", n2_same.alias("_a"), n2_std.alias("_b"))
             .join(names.withColumnRenamed("_target", "_a"), "_a", "left_semi"))
    cross_a = cross.select("machine_type", F.col("_a").alias("family_step"))
    cross_b = (cat.filter(F.col("family") == "e2").select("machine_type", n2_std.alias("_b"))
               .join(names.withColumnRenamed("_target", "_b"), "_b", "left_semi")
               .select("machine_type", F.col("_b").alias("family_step_std")))
    out = (cat.join(step1, "machine_type", "left").join(step2, "machine_type", "left")
           .join(cross_a, "machine_type", "left").join(cross_b, "machine_type", "left"))
    return out.select("machine_type", "memory_gb",
                      F.coalesce("variant_step", "core_step", "family_step", "family_step_std", "machine_type")
                      .alias("promoted_machine_type"))


def master_promotions(spark: SparkSession, current: DataFrame, reference: DataFrame | None,
                      masters: DataFrame) -> DataFrame:
    """D3 + D4 + D5 for clusters with a current-window eviction signal.

    ``masters``: (cluster_name, reference_master, fresh_master, has_promotion_tag).
    Baseline = the reference master when it has at least the fresh master's
    memory, else the fresh master; promoted by the ladder.  Reason names the
    persistent case (the reference window has any exit signal too) with both eviction counts.
    State: re-boost when the reference config carries a promotion tag, else new;
    tagged clusters without any current exit signal are holding.
    """
    ladder = broadcast_bounded(promotion_ladder(spark), 200, "one row per catalogue shape")
    mem = ladder.select(F.col("machine_type").alias("_mt"), F.col("memory_gb").alias("_mem"))
    # any exit signal of a window counts for "persistent" and against "holding"; only evictions promote
    cur = current.select("cluster_name", F.col("eviction_count").alias("_cur_any"),
                         F.when(F.col("eviction_count") > 0, F.col("eviction_count")).alias("cur_n"))
    ref = (reference.select("cluster_name", F.col("eviction_count").alias("ref_n"))
           if reference is not None else cur.limit(0).select("cluster_name", F.col("cur_n").alias("ref_n")))
    m = (masters.join(mem.withColumnRenamed("_mt", "reference_master").withColumnRenamed("_mem", "_rm"),
                      "reference_master", "left")
         .join(mem.withColumnRenamed("_mt", "fresh_master").withColumnRenamed("_mem", "_fm"), "fresh_master", "left"))
    base = F.when(F.col("_rm").isNotNull() & (F.col("_rm") >= F.col("_fm")), F.col("reference_master")) \
        .otherwise(F.col("fresh_master"))
    m = m.withColumn("baseline_master", base)
    lad = ladder.select(F.col("machine_type").alias("baseline_master"), "promoted_machine_type")
    j = (m.join(cur, "cluster_name", "left").join(ref, "cluster_name", "left")
         .join(lad, "baseline_master", "left"))
    promoted = F.coalesce("promoted_machine_type", "baseline_master")
    reason = F.when(F.col("ref_n").isNotNull(), F.concat(
        F.lit("Persistent b14 driver eviction (247): "), F.col("ref_n").cast("string"), F.lit(" (ref) -> "),
        F.col("cur_n").cast("string"), F.lit(" (cur). Promoted "), F.col("baseline_master"), F.lit(" -> "),
        promoted)).otherwise(F.concat(F.lit("Current-date b14 driver eviction (247). Promoted "),
                                      F.col("baseline_master"), F.lit(" -> "), promoted))
    state = (F.when(F.col("cur_n").isNotNull() & F.col("has_promotion_tag"), "re-boost")
             .when(F.col("cur_n").isNotNull(), "new")
             .when(F.col("has_promotion_tag") & F.col("_cur_any").isNull(), "holding"))
    out = j.select("cluster_name", "baseline_master",
                   F.when(F.col("cur_n").isNotNull(), promoted).alias("promoted_master"),
                   F.when(F.col("cur_n").isNotNull(), reason).alias("reason"),
                   state.alias("state"), F.coalesce("ref_n", F.lit(0)).alias("reference_evictions"),
                   F.coalesce("cur_n", F.lit(0)).alias("current_evictions"))
    return out.filter(F.col("state").isNotNull())

"""Failure-driven boosts (D6-D14): signal resolution, heap and executor-scale
boost lifecycles, applying boosts to recipe configs, counters, carrying prior
boosts into re-planned configs and keeping dropped recipes.

A recipe config is one row:

    cluster_name, recipe_filename, spark_opts MAP<STRING,STRING>,
    total_executor_minimum_allocated_memory_gb INT,
    total_executor_maximum_allocated_memory_gb INT, extra MAP<STRING,STRING>

``extra`` holds the tags the lifecycle reads back on the next run
(``appliedMemoryHeapBoostFactor``, ``appliedExecutorScaleFactor``,
``lastTunedDate``, ``keptWithoutCurrentDate``).  Every step is a join on
(cluster, recipe) plus column expressions; nothing is folded per recipe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import boosted_memory, memory_gb

KEYS = ["cluster_name", "recipe_filename"]

# Option keys, tag keys, counters and defaults.
MEMORY_KEY = "spark.executor.memory"
INSTANCES_KEY = "spark.executor.instances"
CORES_KEY = "spark.executor.cores"
DA_ENABLED_KEY = "spark.dynamicAllocation.enabled"
DA_MIN_KEY = "spark.dynamicAllocation.minExecutors"
DA_MAX_KEY = "spark.dynamicAllocation.maxExecutors"
DA_INITIAL_KEY = "spark.dynamicAllocation.initialExecutors"
HEAP_TAG = "appliedMemoryHeapBoostFactor"
SCALE_TAG = "appliedExecutorScaleFactor"
LAST_TUNED_TAG = "lastTunedDate"
KEPT_TAG = "keptWithoutCurrentDate"
HEAP_COUNTERS = ("boostedMemoryHeapJobCount", "boostedMemoryHeapJobList")
SCALE_COUNTERS = ("scaledMaxExecutorsJobCount", "scaledMaxExecutorsJobList")
DEFAULT_MEMORY = "8g"
HEAP_BOOST_FACTOR = 1.5
SCALE_BOOST_FACTOR = 1.5
SCALE_CAP_TOUCH_RATIO = 0.5
SERIALIZER = "org.apache.spark.serializer.KryoSerializer"
PARALLELIZATION_FACTOR = 5

CONFIG_SCHEMA = ("cluster_name string, recipe_filename string, spark_opts map<string,string>, "
                 "total_executor_minimum_allocated_memory_gb int, total_executor_maximum_allocated_memory_gb int, "
                 "extra map<string,string>")


# --- building configs ---------------------------------------------------------------

def configs_from_manual(manual: DataFrame) -> DataFrame:
    """K1 recipe blocks from a manual plan (instances / cores / memory)."""
    mem = F.concat(F.col("spark_executor_memory_gb").cast("string"), F.lit("g"))
    opts = F.create_map(
        F.lit("spark.serializer"), F.lit(SERIALIZER), F.lit("spark.closure.serializer"), F.lit(SERIALIZER),
        F.lit(INSTANCES_KEY), F.col("spark_executor_instances").cast("string"),
        F.lit(CORES_KEY), F.col("spark_executor_cores").cast("string"), F.lit(MEMORY_KEY), mem)
    total = (F.col("spark_executor_instances") * F.col("spark_executor_memory_gb")).cast("int")
    return manual.select(*KEYS, opts.alias("spark_opts"),
                         total.alias("total_executor_minimum_allocated_memory_gb"),
                         total.alias("total_executor_maximum_allocated_memory_gb"),
                         F.create_map().cast("map<string,string>").alias("extra"))


def configs_from_da(da: DataFrame) -> DataFrame:
    """K2 recipe blocks from a dynamic-allocation plan."""
    mem = F.concat(F.col("spark_executor_memory_gb").cast("string"), F.lit("g"))
    opts = F.create_map(
        F.lit("spark.serializer"), F.lit(SERIALIZER), F.lit(DA_ENABLED_KEY), F.lit("true"),
        F.lit(DA_MIN_KEY), F.col("min_executors").cast("string"),
        F.lit(DA_MAX_KEY), F.col("max_executors").cast("string"),
        F.lit(DA_INITIAL_KEY), F.col("initial_executors").cast("string"),
        F.lit(CORES_KEY), F.col("spark_executor_cores").cast("string"), F.lit(MEMORY_KEY), mem)
    return da.select(*KEYS, opts.alias("spark_opts"),
                     (F.col("min_executors") * F.col("spark_executor_memory_gb")).cast("int")
                     .alias("total_executor_minimum_allocated_memory_gb"),
                     (F.col("max_executors") * F.col("spark_executor_memory_gb")).cast("int")
                     .alias("total_executor_maximum_allocated_memory_gb"),
                     F.create_map().cast("map<string,string>").alias("extra"))


def opt(name: str, key: str) -> Column:
    """Value of one map key, NULL when absent."""
    return F.try_element_at(F.col(name), F.lit(key))


def executor_counts(opts: str = "spark_opts") -> tuple[Column, Column]:
    """(min, max) executors: DA min / max (max defaults to min), else instances twice."""
    is_da = F.coalesce(opt(opts, DA_ENABLED_KEY) == "true", F.lit(False))
    da_min = F.coalesce(opt(opts, DA_MIN_KEY).try_cast("int"), F.lit(1))
    da_max = F.coalesce(opt(opts, DA_MAX_KEY).try_cast("int"), da_min)
    inst = F.coalesce(opt(opts, INSTANCES_KEY).try_cast("int"), F.lit(1))
    return F.when(is_da, da_min).otherwise(inst), F.when(is_da, da_max).otherwise(inst)


def with_option(opts: Column, key: str, value: Column) -> Column:
    """Set one option, keeping every other key."""
    return F.map_concat(F.map_filter(opts, lambda k, v: k != F.lit(key)), F.create_map(F.lit(key), value))


# --- D6: signal resolution -------------------------------------------------------------

def strip_job_suffix(job_id: Column) -> Column:
    """Drop a trailing ``-YYYYMMDD-HHMM``."""
    return F.regexp_replace(job_id, r"-\d{8}-\d{4}$", "")


def normalise_job_prefix(prefix: Column) -> Column:
    return F.upper(F.translate(prefix, "-", "_"))


def normalise_recipe(recipe: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(recipe, r"^_", ""), r"\.json$", ""))


def resolve_signals(signals: DataFrame, configs: DataFrame) -> DataFrame:
    """Fill a missing recipe by (1) a sibling signal with the same job prefix,
    (2) the job prefix normalised and matched against the cluster's recipe names.
    Adds ``resolved`` and ``resolution`` (given / sibling / derived / none)."""
    s = signals.withColumn("_prefix", strip_job_suffix(F.col("job_id"))) \
        .withColumn("_given", F.nullif(F.trim(F.coalesce("recipe_filename", F.lit(""))), F.lit("")))
    siblings = (s.filter(F.col("_given").isNotNull()).groupBy("cluster_name", "_prefix")
                .agg(F.max("_given").alias("_sibling")))
    names = configs.select("cluster_name", F.col("recipe_filename").alias("_derived"),
                           normalise_recipe(F.col("recipe_filename")).alias("_norm")).dropDuplicates(
        ["cluster_name", "_norm"])
    j = (s.join(siblings, ["cluster_name", "_prefix"], "left")
         .withColumn("_norm", normalise_job_prefix(F.col("_prefix")))
         .join(names, ["cluster_name", "_norm"], "left"))
    recipe = F.coalesce("_given", "_sibling", "_derived")
    how = (F.when(F.col("_given").isNotNull(), "given").when(F.col("_sibling").isNotNull(), "sibling")
           .when(F.col("_derived").isNotNull(), "derived").otherwise("none"))
    keep = [c for c in signals.columns if c != "recipe_filename"]
    return j.select(*keep, recipe.alias("recipe_filename"), recipe.isNotNull().alias("resolved"),
                    how.alias("resolution"))


def unresolved_signals(resolved: DataFrame, vitamin: str, source: str) -> DataFrame:
    """K9: the unresolved signals, one row per (vitamin, job, cluster): the latest one, with the number of them
    per vitamin and source."""
    rest = [c for c in ("latest_driver_log_ts", "latest_driver_message") if c in resolved.columns]
    u = (resolved.filter(~F.col("resolved")).select(F.lit(vitamin).alias("vitamin_name"), F.lit(source).alias("csv_source"), "job_id", "cluster_name", *rest)
         .groupBy("vitamin_name", "csv_source", "job_id", "cluster_name")
         .agg(*[F.max(c).alias(c) for c in rest]))
    counts = u.groupBy("vitamin_name", "csv_source").agg(F.count(F.lit(1)).alias("unresolved_count"))
    return u.join(counts, ["vitamin_name", "csv_source"])


# --- D7 / D8 / D9: lifecycles -----------------------------------------------------------

def _lifecycle(configs: DataFrame, all_signals: DataFrame, current_signals: DataFrame, tag: str,
               reference_only_boosts: bool) -> DataFrame:
    """Shared New / ReBoost / Holding classification (one join, no per-recipe loop)."""
    anys = all_signals.select(*KEYS).distinct().withColumn("_any", F.lit(True))
    curs = current_signals.select(*KEYS).distinct().withColumn("_cur", F.lit(True))
    c = configs.withColumn("_prior", opt("extra", tag).try_cast("double"))
    j = c.join(anys, KEYS, "left").join(curs, KEYS, "left")
    j = j.withColumn("_any", F.coalesce("_any", F.lit(False))).withColumn("_cur", F.coalesce("_cur", F.lit(False)))
    has_prior = F.col("_prior").isNotNull()
    state = (F.when(~has_prior & F.col("_cur"), "new")
             .when(has_prior & F.col("_cur"), "re-boost")
             .when(has_prior, "holding")
             .when(F.col("_any") & F.lit(reference_only_boosts), "new"))
    return j.withColumn("state", state).filter(F.col("state").isNotNull())


def heap_boost_state(configs: DataFrame, all_signals: DataFrame, current_signals: DataFrame,
                     factor: float = HEAP_BOOST_FACTOR) -> DataFrame:
    """Heap OOM boosts across dates; memory ``ceil(gb x f)``, cumulative factor."""
    j = _lifecycle(configs, all_signals, current_signals, HEAP_TAG, reference_only_boosts=True)
    cur_mem = F.coalesce(opt("spark_opts", MEMORY_KEY), F.lit(DEFAULT_MEMORY))
    boosted = F.when(F.col("state") == "holding", cur_mem).otherwise(boosted_memory(cur_mem, factor))
    cumulative = (F.when(F.col("state") == "re-boost", F.col("_prior") * factor)
                  .when(F.col("state") == "holding", F.col("_prior")).otherwise(F.lit(factor)))
    return j.select(*KEYS, cur_mem.alias("original_memory"), boosted.alias("boosted_memory"),
                    F.lit(factor).alias("boost_factor"), cumulative.alias("cumulative_factor"), "state")


def heap_boost_single(configs: DataFrame, signals: DataFrame, factor: float = HEAP_BOOST_FACTOR) -> DataFrame:
    """Single-date variant, idempotent: a recipe already at >= factor is a no-op (holding)."""
    sig = signals.select(*KEYS).filter(F.col("recipe_filename") != "").distinct()
    j = configs.join(sig, KEYS).withColumn("_prior", opt("extra", HEAP_TAG).try_cast("double"))
    done = F.coalesce(F.col("_prior") >= factor, F.lit(False))
    cur_mem = F.coalesce(opt("spark_opts", MEMORY_KEY), F.lit(DEFAULT_MEMORY))
    return j.select(*KEYS, cur_mem.alias("original_memory"),
                    F.when(done, cur_mem).otherwise(boosted_memory(cur_mem, factor)).alias("boosted_memory"),
                    F.lit(factor).alias("boost_factor"),
                    F.when(done, F.col("_prior")).otherwise(F.lit(factor)).alias("cumulative_factor"),
                    F.when(done, "holding").otherwise("new").alias("state"))


def heap_boost_chain(configs: DataFrame, dated_signals: DataFrame, dates: list[str], factor: float = HEAP_BOOST_FACTOR) -> DataFrame:
    """D7 over any number of dates: each date's run starts from the memory and factor the run before left.

    ``dated_signals`` has (cluster, recipe, snapshot_date); ``dates`` are the runs, in order.  A
    recipe's dates with a signal are one array (at most as many as there are dates), folded by
    one ordered ``aggregate``: new, re-boost or holding per date from the first boost on, or
    from the first date for a recipe that is tagged already.
    """
    hit = dated_signals.where(F.col("snapshot_date").isin(dates)).groupBy(*KEYS).agg(F.collect_set("snapshot_date").alias("_hits"))
    j = configs.join(hit, KEYS, "left").select(
        *KEYS, memory_gb(F.coalesce(opt("spark_opts", MEMORY_KEY), F.lit(DEFAULT_MEMORY))).cast("int").alias("_gb"),
        opt("extra", HEAP_TAG).try_cast("double").alias("_factor"), F.coalesce("_hits", F.array().cast("array<string>")).alias("_hits"))
    step = "struct<snapshot_date:string,state:string,original_memory_gb:int,boosted_memory_gb:int,cumulative_factor:double>"
    start = F.struct(F.col("_gb").alias("gb"), F.col("_factor").alias("factor"), F.array().cast(f"array<{step}>").alias("steps"))

    def run(acc: Column, date: Column) -> Column:
        signal = F.array_contains("_hits", date)
        state = F.when(signal & acc["factor"].isNull(), "new").when(signal, "re-boost").when(acc["factor"].isNotNull(), "holding")
        gb = F.when(signal, F.ceil(acc["gb"] * factor).cast("int")).otherwise(acc["gb"])
        total = F.when(signal, F.coalesce(acc["factor"], F.lit(1.0)) * factor).otherwise(acc["factor"])
        row = F.struct(date.alias("snapshot_date"), state.alias("state"), acc["gb"].alias("original_memory_gb"), gb.alias("boosted_memory_gb"),
                       total.alias("cumulative_factor"))
        return F.struct(gb.alias("gb"), total.alias("factor"), F.concat(acc["steps"], F.array(row)).alias("steps"))

    folded = F.aggregate(F.array(*[F.lit(d) for d in dates]), start, run)["steps"]
    return j.select(*KEYS, F.inline(folded)).where("state is not null")


def cap_touching(signals: DataFrame, configs: DataFrame, ratio: float = SCALE_CAP_TOUCH_RATIO) -> DataFrame:
    """T13 gate: p95 run-max executors / dynamicAllocation.maxExecutors >= ratio; recipes without a positive maximum never pass."""
    c = configs.select(*KEYS, opt("spark_opts", "spark.dynamicAllocation.maxExecutors").try_cast("int").alias("_max")) \
        .filter(F.col("_max") > 0)
    return signals.join(c, KEYS).filter(F.col("p95_run_max_executors") / F.col("_max") >= ratio).drop("_max")


def scale_boost_state(configs: DataFrame, all_signals: DataFrame, current_signals: DataFrame,
                      factor: float = SCALE_BOOST_FACTOR) -> DataFrame:
    """Raise the DA ceiling ``max(cur + 1, ceil(cur x f))``; fixed-size recipes skipped;
    an untagged recipe without a current signal gets nothing."""
    mn, mx = executor_counts()
    dyn = configs.filter(mn != mx)
    j = _lifecycle(dyn, all_signals, current_signals, SCALE_TAG, reference_only_boosts=False)
    _, cur_max = executor_counts()
    boosted = F.when(F.col("state") == "holding", cur_max).otherwise(
        F.greatest(cur_max + 1, F.ceil(cur_max * factor).cast("int")))
    cumulative = (F.when(F.col("state") == "re-boost", F.col("_prior") * factor)
                  .when(F.col("state") == "holding", F.col("_prior")).otherwise(F.lit(factor)))
    return j.select(*KEYS, cur_max.alias("original_max_executors"), boosted.cast("int").alias("boosted_max_executors"),
                    F.lit(factor).alias("boost_factor"), cumulative.alias("cumulative_factor"), "state")


# --- D10 / D11: apply and count --------------------------------------------------------

def apply_heap_boosts(configs: DataFrame, boosts: DataFrame) -> DataFrame:
    """New memory option, totals re-derived from executor counts, factor stamped."""
    b = boosts.select(*KEYS, "boosted_memory", "cumulative_factor", "state", "original_memory")
    j = configs.join(b, KEYS, "left")
    hit = F.col("state").isNotNull()
    change = hit & (F.col("state") != "holding") & (F.col("original_memory") != F.col("boosted_memory"))
    mn, mx = executor_counts()
    gb = memory_gb(F.col("boosted_memory"))
    return j.select(
        *KEYS,
        F.when(change, with_option(F.col("spark_opts"), MEMORY_KEY, F.col("boosted_memory")))
        .otherwise(F.col("spark_opts")).alias("spark_opts"),
        F.when(change, (mn * gb).cast("int")).otherwise(F.col("total_executor_minimum_allocated_memory_gb"))
        .alias("total_executor_minimum_allocated_memory_gb"),
        F.when(change, (mx * gb).cast("int")).otherwise(F.col("total_executor_maximum_allocated_memory_gb"))
        .alias("total_executor_maximum_allocated_memory_gb"),
        F.when(hit, with_option(F.col("extra"), HEAP_TAG, F.col("cumulative_factor").cast("string")))
        .otherwise(F.col("extra")).alias("extra"))


def apply_scale_boosts(configs: DataFrame, boosts: DataFrame) -> DataFrame:
    b = boosts.select(*KEYS, "boosted_max_executors", "original_max_executors", "cumulative_factor", "state")
    j = configs.join(b, KEYS, "left")
    hit = F.col("state").isNotNull()
    change = hit & (F.col("state") != "holding") & (F.col("original_max_executors") != F.col("boosted_max_executors"))
    gb = memory_gb(F.coalesce(opt("spark_opts", MEMORY_KEY), F.lit(DEFAULT_MEMORY)))
    return j.select(
        *KEYS,
        F.when(change, with_option(F.col("spark_opts"), DA_MAX_KEY, F.col("boosted_max_executors").cast("string")))
        .otherwise(F.col("spark_opts")).alias("spark_opts"),
        "total_executor_minimum_allocated_memory_gb",
        F.when(change, (F.col("boosted_max_executors") * gb).cast("int"))
        .otherwise(F.col("total_executor_maximum_allocated_memory_gb"))
        .alias("total_executor_maximum_allocated_memory_gb"),
        F.when(hit, with_option(F.col("extra"), SCALE_TAG, F.col("cumulative_factor").cast("string")))
        .otherwise(F.col("extra")).alias("extra"))


def boost_counters(boosts: DataFrame, kind: str = "heap") -> DataFrame:
    """Per cluster, count and sorted list of boosted recipes (bounded by the
    cluster's recipe count)."""
    count_key, list_key = HEAP_COUNTERS if kind == "heap" else SCALE_COUNTERS
    return boosts.groupBy("cluster_name").agg(
        F.count_distinct("recipe_filename").alias(count_key),
        F.array_sort(F.collect_set("recipe_filename")).alias(list_key),
        F.sum(F.when(F.col("state") == "new", 1).otherwise(0)).alias("new_count"),
        F.sum(F.when(F.col("state") == "re-boost", 1).otherwise(0)).alias("reboost_count"),
        F.sum(F.when(F.col("state") == "holding", 1).otherwise(0)).alias("holding_count"))


# --- D12 / D13: carry prior boosts, keep dropped recipes -----------------------------

def carry_boosts(new_configs: DataFrame, reference_configs: DataFrame) -> DataFrame:
    """A re-planned recipe keeps its reference heap factor and boosted memory;
    totals are re-derived from the *new* executor counts."""
    ref = reference_configs.select(*KEYS, opt("extra", HEAP_TAG).alias("_factor"),
                                   opt("spark_opts", MEMORY_KEY).alias("_mem")) \
        .filter(F.col("_factor").isNotNull() & F.col("_mem").isNotNull())
    j = new_configs.join(ref, KEYS, "left")
    hit = F.col("_factor").isNotNull()
    mn, mx = executor_counts()
    gb = memory_gb(F.col("_mem"))
    return j.select(
        *KEYS,
        F.when(hit, with_option(F.col("spark_opts"), MEMORY_KEY, F.col("_mem"))).otherwise(F.col("spark_opts"))
        .alias("spark_opts"),
        F.when(hit, (mn * gb).cast("int")).otherwise(F.col("total_executor_minimum_allocated_memory_gb"))
        .alias("total_executor_minimum_allocated_memory_gb"),
        F.when(hit, (mx * gb).cast("int")).otherwise(F.col("total_executor_maximum_allocated_memory_gb"))
        .alias("total_executor_maximum_allocated_memory_gb"),
        F.when(hit, with_option(F.col("extra"), HEAP_TAG, F.col("_factor"))).otherwise(F.col("extra")).alias("extra"),
        hit.alias("carried"))


def keep_recipes(new_configs: DataFrame, reference_configs: DataFrame, preserved: DataFrame,
                 reference_date: str) -> DataFrame:
    """Preserved (dropped) recipes are tagged with ``lastTunedDate`` (the oldest
    date they were kept from) and ``keptWithoutCurrentDate``, then merged into the
    new config when absent from it."""
    p = preserved.select(*KEYS).distinct()
    kept = reference_configs.join(p, KEYS, "left_semi")
    last = F.coalesce(opt("extra", LAST_TUNED_TAG), F.lit(reference_date))
    tagged = kept.withColumn("extra", with_option(with_option(F.col("extra"), LAST_TUNED_TAG, last),
                                                  KEPT_TAG, F.lit("true")))
    missing = tagged.join(new_configs.select(*KEYS), KEYS, "left_anti")
    return (new_configs.withColumn("kept", F.lit(False))
            .unionByName(missing.select(*new_configs.columns).withColumn("kept", F.lit(True))))


def flat_config(configs: DataFrame) -> DataFrame:
    """A flat view of recipe configs (for reports and checks)."""
    mn, mx = executor_counts()
    return configs.select(
        *KEYS, opt("spark_opts", MEMORY_KEY).alias("executor_memory"), mn.alias("min_executors"),
        mx.alias("max_executors"), "total_executor_minimum_allocated_memory_gb",
        "total_executor_maximum_allocated_memory_gb",
        opt("extra", HEAP_TAG).alias(HEAP_TAG), opt("extra", SCALE_TAG).alias(SCALE_TAG),
        opt("extra", LAST_TUNED_TAG).alias(LAST_TUNED_TAG), opt("extra", KEPT_TAG).alias(KEPT_TAG))


def prioritised_signals(current: DataFrame, reference: DataFrame, seq: str = "latest_driver_log_ts") -> DataFrame:
    """One signal per (cluster, recipe), the current date's before the
    reference date's, then the earliest in sequence -- a ``min_by`` aggregate."""
    both = (current.withColumn("_priority", F.lit(0)).unionByName(reference.withColumn("_priority", F.lit(1)))
            .filter(F.coalesce(F.col("recipe_filename"), F.lit("")) != ""))
    cols = [c for c in current.columns if c not in KEYS]
    pick = F.min_by(F.struct(*cols, "_priority"), F.struct("_priority", seq)).alias("_s")
    return both.groupBy(*KEYS).agg(pick).select(*KEYS, *[F.col(f"_s.{c}").alias(c) for c in cols],
                                                F.col("_s._priority").alias("from_reference"))

"""Tabular inputs (S2-S7, S11-S13): CSV exports of the log queries, lookup maps,
spans, tuned configs, per-date snapshots, header validation.

Everything is read with an explicit schema or as all-string columns and cast
with ``try_cast`` (an unparsable cell becomes NULL, like the lenient reader of
the original exports).  Quoted cells are honoured (the original splitter did
not; stray quotes left in cluster names are stripped where they matter).
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.snapshots import normalize_metrics
from .files import path_exists
from .logs import parse_ts

KEYS = ["cluster_name", "recipe_filename"]

# File names of the per-date inputs.
B13_FILE = "b13_recommendations_inputs_per_recipe_per_cluster.csv"
B15_FLAT_FILE = "b15_recommendation_inputs_per_recipe_per_cluster.csv"
B14_FILE = "b14_clusters_with_nonzero_exit_codes.csv"
B16_FILE = "b16_oom_job_driver_exceptions.csv"
B20_FILE = "b20_cluster_span_time.csv"
B21_FILE = "b21_cluster_autoscaler_values.csv"

METRIC_COLUMNS = ["cluster_name", "recipe_filename", "avg_executors_per_job", "p95_run_max_executors",
                  "avg_job_duration_ms", "p95_job_duration_ms", "runs", "seconds_at_cap", "runs_reaching_cap",
                  "total_runs", "fraction_reaching_cap", "max_concurrent_jobs"]


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Header row, trimmed cells, blank lines skipped, all values text; missing
    expected columns are added as NULL."""
    df = (spark.read.option("header", True).option("inferSchema", False)
          .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
          .option("mode", "PERMISSIVE").csv(path))
    df = df.toDF(*[c.strip().strip('"').lstrip("﻿") for c in df.columns])
    for c in columns or []:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def typed_metrics(df: DataFrame) -> DataFrame:
    """S3: cast a flattened metric table (b13 shape) with the tuner defaults."""
    for c in METRIC_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    d = df.filter((F.coalesce(F.col("cluster_name"), F.lit("")) != "")
                  & (F.coalesce(F.col("recipe_filename"), F.lit("")) != ""))
    d = d.select(*KEYS, *[F.col(c).cast("string").try_cast("double").alias(c)
                          for c in ["avg_executors_per_job", "p95_run_max_executors", "avg_job_duration_ms",
                                    "p95_job_duration_ms", "fraction_reaching_cap"]],
                 *[F.col(c).cast("string").try_cast("long").alias(c)
                   for c in ["runs", "seconds_at_cap", "runs_reaching_cap", "total_runs"]],
                 F.col("max_concurrent_jobs").cast("string").try_cast("int").alias("max_concurrent_jobs"))
    return normalize_metrics(d)


def load_flattened(spark: SparkSession, input_dir: str) -> DataFrame | None:
    """S3: the b13 export, else the b15-named flattened export, else None."""
    for name in (B13_FILE, B15_FLAT_FILE):
        p = os.path.join(input_dir, name)
        if path_exists(spark, p):
            return typed_metrics(read_csv(spark, p, METRIC_COLUMNS))
    return None


def merge_individual(b1: DataFrame, b12: DataFrame, b3: DataFrame, b8: DataFrame, b5: DataFrame,
                     b11: DataFrame) -> DataFrame:
    """Union of the (cluster, recipe) keys of b1, b12, b3, b8, b5 with
    per-file defaults (Q10: no b12 row -> runs 0 even when b8 has runs; no b8
    row -> p95 duration 0, not the average; b11 missing -> concurrency 1)."""
    def side(df, tag, cols):
        return df.select(*KEYS, F.lit(True).alias(f"_{tag}"), *[F.col(c).alias(f"{tag}_{c}") for c in cols])
    j = (side(b1, "b1", ["avg_executors_per_job"])
         .join(side(b12, "b12", ["p95_run_max_executors", "runs"]), KEYS, "full_outer")
         .join(side(b3, "b3", ["avg_job_duration_ms"]), KEYS, "full_outer")
         .join(side(b8, "b8", ["p95_job_duration_ms", "runs"]), KEYS, "full_outer")
         .join(side(b5, "b5", ["seconds_at_cap", "runs_reaching_cap", "total_runs", "fraction_reaching_cap"]),
               KEYS, "full_outer"))
    conc = b11.select("cluster_name", F.lit(True).alias("_b11"),
                      F.col("max_concurrent_jobs").cast("int").alias("b11_conc"))
    j = j.join(conc, "cluster_name", "left")
    avg_dur = F.coalesce(F.col("b3_avg_job_duration_ms").cast("double"), F.lit(0.0))
    runs8 = F.when(F.col("_b8").isNotNull(), F.col("b8_runs").cast("long")).otherwise(F.lit(0))
    return j.select(
        *KEYS,
        F.coalesce(F.col("b1_avg_executors_per_job").cast("double"), F.lit(1.0)).alias("avg_executors_per_job"),
        F.coalesce(F.col("b12_p95_run_max_executors").cast("double"), F.lit(1.0)).alias("p95_run_max_executors"),
        avg_dur.alias("avg_job_duration_ms"),
        F.when(F.col("_b8").isNull(), F.lit(0.0))
        .otherwise(F.coalesce(F.col("b8_p95_job_duration_ms").cast("double"), avg_dur)).alias("p95_job_duration_ms"),
        F.when(F.col("_b12").isNull(), F.lit(0).cast("long"))
        .otherwise(F.coalesce(F.col("b12_runs").cast("long"), runs8, F.lit(0).cast("long"))).alias("runs"),
        F.col("b5_seconds_at_cap").cast("long").alias("seconds_at_cap"),
        F.col("b5_runs_reaching_cap").cast("long").alias("runs_reaching_cap"),
        F.col("b5_total_runs").cast("long").alias("total_runs"),
        F.col("b5_fraction_reaching_cap").cast("double").alias("fraction_reaching_cap"),
        F.when(F.col("_b11").isNull(), F.lit(1)).otherwise(F.col("b11_conc")).alias("max_concurrent_jobs"))


def first_row_wins(df: DataFrame, key: str, value_cols: Sequence[str]) -> DataFrame:
    """One row per key, the first in file order; rows with an empty key or
    value are skipped.  File order = ``monotonically_increasing_id`` of a scan."""
    ok = F.lit(True)
    for c in [key, *value_cols]:
        ok = ok & (F.coalesce(F.trim(F.col(c)), F.lit("")) != "")
    d = df.filter(ok).withColumn("_row", F.monotonically_increasing_id())
    pick = F.min_by(F.struct(*[F.trim(c).alias(c) for c in value_cols]), "_row").alias("_v")
    return d.groupBy(F.trim(key).alias(key)).agg(pick).select(key, *[F.col(f"_v.{c}").alias(c) for c in value_cols])


def dag_map(spark: SparkSession, path: str) -> DataFrame:
    """DAG <-> cluster map (``DAG_ID, CLUSTER_NAME``)."""
    df = read_csv(spark, path, ["DAG_ID", "CLUSTER_NAME"])
    return first_row_wins(df, "CLUSTER_NAME", ["DAG_ID"]).select(
        F.col("CLUSTER_NAME").alias("cluster_name"), F.col("DAG_ID").alias("dag_id"))


def timer_map(spark: SparkSession, path: str) -> DataFrame:
    """Timer per cluster (``DAG_NAME, CLUSTER_NAME, TIMER_NAME, TIME, ...``)."""
    df = read_csv(spark, path, ["CLUSTER_NAME", "TIMER_NAME", "TIME"])
    return first_row_wins(df, "CLUSTER_NAME", ["TIMER_NAME", "TIME"]).select(
        F.col("CLUSTER_NAME").alias("cluster_name"), F.col("TIMER_NAME").alias("timer_name"),
        F.col("TIME").alias("timer_time"))


def spans_table(df: DataFrame) -> DataFrame:
    """b20 export typed; rows with unparsable endpoints dropped."""
    d = df.select(F.regexp_replace(F.trim("cluster_name"), '"', "").alias("cluster_name"),
                  F.col("incarnation_idx").cast("string").try_cast("int").alias("incarnation_idx"),
                  parse_ts(F.col("span_start_ts").cast("string")).alias("span_start_ts"),
                  parse_ts(F.col("span_end_ts").cast("string")).alias("span_end_ts"),
                  F.coalesce(F.lower(F.col("has_explicit_create").cast("string")) == "true", F.lit(False))
                  .alias("has_explicit_create"),
                  F.coalesce(F.lower(F.col("has_explicit_delete").cast("string")) == "true", F.lit(False))
                  .alias("has_explicit_delete"))
    return d.filter(F.col("span_start_ts").isNotNull() & F.col("span_end_ts").isNotNull()
                    & (F.col("cluster_name") != ""))


def autoscaler_table(df: DataFrame) -> DataFrame:
    """S8 input typing of the b21 export (the RECOMMENDING filter is ``cost_events``)."""
    ints = ["current_primary_workers", "target_primary_workers", "min_primary_workers", "max_primary_workers"]
    return df.select(F.trim("cluster_name").alias("cluster_name"),
                     parse_ts(F.col("event_ts").cast("string")).alias("event_ts"), F.trim("state").alias("state"),
                     F.col("decision"), *[F.col(c).cast("string").try_cast("int").alias(c) for c in ints],
                     F.col("recommendation_id") if "recommendation_id" in df.columns
                     else F.lit(None).cast("string").alias("recommendation_id"))


def oom_signals_table(df: DataFrame) -> DataFrame:
    """The b16 export typed and filtered to heap OOMs (all clusters in one
    filter, no per-cluster pass); quotes stripped from cluster names."""
    return (df.select(F.trim("job_id").alias("job_id"),
                      F.trim(F.regexp_replace(F.col("cluster_name"), '"', "")).alias("cluster_name"),
                      F.trim(F.coalesce("recipe_filename", F.lit(""))).alias("recipe_filename"),
                      F.col("latest_driver_log_ts").cast("string").alias("latest_driver_log_ts"),
                      F.col("latest_driver_message"),
                      F.upper(F.trim(F.col("is_java_heap").cast("string"))).alias("_heap"))
            .filter((F.col("job_id") != "") & (F.col("cluster_name") != "") & (F.col("_heap") == "TRUE"))
            .drop("_heap"))


# --- S11: tuned configs ------------------------------------------------------------------
RECIPE_STRUCT = T.StructType([
    T.StructField("parallelizationFactor", T.IntegerType()),
    T.StructField("sparkOptsMap", T.MapType(T.StringType(), T.StringType())),
    T.StructField("total_executor_minimum_allocated_memory_gb", T.IntegerType()),
    T.StructField("total_executor_maximum_allocated_memory_gb", T.IntegerType()),
    T.StructField("appliedMemoryHeapBoostFactor", T.DoubleType()),
    T.StructField("appliedExecutorScaleFactor", T.DoubleType()),
    T.StructField("lastTunedDate", T.StringType()),
    T.StructField("keptWithoutCurrentDate", T.BooleanType()),
])
CLUSTER_STRUCT = T.StructType([T.StructField(n, t) for n, t in [
    ("num_workers", T.IntegerType()), ("master_machine_type", T.StringType()),
    ("worker_machine_type", T.StringType()), ("autoscaling_policy", T.StringType()),
    ("tuner_version", T.StringType()), ("total_no_of_jobs", T.IntegerType()),
    ("cluster_max_total_memory_gb", T.IntegerType()), ("cluster_max_total_cores", T.IntegerType()),
    ("accumulated_max_total_memory_per_jobs_gb", T.IntegerType()), ("driver_memory_gb", T.IntegerType()),
    ("driver_cores", T.IntegerType()), ("driver_memory_overhead_gb", T.IntegerType()),
    ("diagnostic_reason", T.StringType()), ("applied_driver_promotion", T.StringType()),
    ("boostedMemoryHeapJobCount", T.IntegerType()), ("boostedMemoryHeapJobList", T.ArrayType(T.StringType())),
    ("scaledMaxExecutorsJobCount", T.IntegerType()), ("scaledMaxExecutorsJobList", T.ArrayType(T.StringType())),
]])
CONFIG_FILE_SCHEMA = T.StructType([
    T.StructField("clusterConf", T.MapType(T.StringType(), CLUSTER_STRUCT)),
    T.StructField("recipeSparkConf", T.MapType(T.StringType(), RECIPE_STRUCT)),
    T.StructField("_corrupt_record", T.StringType()),
])


def read_configs(spark: SparkSession, path_glob: str) -> tuple[DataFrame, DataFrame]:
    """Every ``*-auto-scale-tuned.json`` (or manual) file under a folder:
    cluster rows and recipe-config rows; unparsable files are skipped."""
    raw = (spark.read.schema(CONFIG_FILE_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path_glob)
           .filter(F.col("_corrupt_record").isNull()))
    clusters = raw.select(F.explode("clusterConf").alias("cluster_name", "c")).select("cluster_name", "c.*")
    first_cluster = F.try_element_at(F.map_keys("clusterConf"), F.lit(1))
    recipes = raw.select(first_cluster.alias("cluster_name"), F.explode("recipeSparkConf").alias("recipe_filename", "r"))
    extra = F.map_filter(F.create_map(
        F.lit("appliedMemoryHeapBoostFactor"), F.col("r.appliedMemoryHeapBoostFactor").cast("string"),
        F.lit("appliedExecutorScaleFactor"), F.col("r.appliedExecutorScaleFactor").cast("string"),
        F.lit("lastTunedDate"), F.col("r.lastTunedDate"),
        F.lit("keptWithoutCurrentDate"), F.col("r.keptWithoutCurrentDate").cast("string")), lambda k, v: v.isNotNull())
    recipes = recipes.select(
        "cluster_name", "recipe_filename",
        F.coalesce(F.col("r.sparkOptsMap"), F.create_map().cast("map<string,string>")).alias("spark_opts"),
        F.col("r.total_executor_minimum_allocated_memory_gb").alias("total_executor_minimum_allocated_memory_gb"),
        F.col("r.total_executor_maximum_allocated_memory_gb").alias("total_executor_maximum_allocated_memory_gb"),
        extra.alias("extra"))
    return clusters, recipes


# --- S12: snapshot loader ------------------------------------------------------------------
SPAN_SCHEMA = ("cluster_name string, incarnation_idx int, span_start_ts timestamp, span_end_ts timestamp, "
               "has_explicit_create boolean, has_explicit_delete boolean")
EVENT_SCHEMA = ("cluster_name string, event_ts timestamp, state string, decision string, "
                "current_primary_workers int, target_primary_workers int, min_primary_workers int, "
                "max_primary_workers int, recommendation_id string")
EXIT_SCHEMA = "timestamp string, job_id string, cluster_name string, driver_exit_code string"


def load_snapshot(spark: SparkSession, input_dir: str) -> dict[str, DataFrame]:
    """Metrics + b14 + b20 + b21 of one date folder, each optional (empty with
    its schema when absent)."""
    def opt(name, schema, typer=lambda d: d):
        p = os.path.join(input_dir, name)
        return typer(read_csv(spark, p)) if path_exists(spark, p) else empty(spark, schema)
    metrics = load_flattened(spark, input_dir)
    return {
        "metrics": metrics if metrics is not None else typed_metrics(empty(spark, ", ".join(
            f"{c} string" for c in METRIC_COLUMNS))),
        "exit_codes": opt(B14_FILE, EXIT_SCHEMA),
        "spans": opt(B20_FILE, SPAN_SCHEMA, spans_table),
        "autoscaler": opt(B21_FILE, EVENT_SCHEMA, autoscaler_table),
    }


# --- S13: header validation -----------------------------------------------------------------
def validate_input(df: DataFrame, name: str, expected: Sequence[str]) -> DataFrame:
    """Required columns present (after quote / BOM stripping), missing and
    extra columns, and the row count (a distributed count)."""
    found = [c.strip().strip('"').lstrip("﻿") for c in df.columns]
    missing = [c for c in expected if c not in found]
    extra = [c for c in found if c not in expected]
    counts = df.agg(F.count(F.lit(1)).alias("row_count"))
    return counts.select(
        F.lit(name).alias("table_name"), F.lit(len(expected)).alias("expected_columns"),
        F.lit(len(found)).alias("found_columns"),
        F.lit(",".join(missing)).alias("missing_columns"), F.lit(",".join(extra)).alias("extra_columns"),
        F.lit(not missing).alias("valid"), "row_count")

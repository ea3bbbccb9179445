"""Sinks (K1-K8, K10): per-cluster tuned configs, summary reports, analysis
tables, run index and run summary.

Writers are plain DataFrame writes.  Per-cluster JSON documents are built
with ``to_json`` over one row per cluster (its recipes gathered with
``collect_list`` -- bounded by the recipes of one cluster) and written
partitioned by cluster, so every cluster's file is produced by the task that
owns it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.boosts import KEYS
from ..session import deal_by


def config_documents(cluster_conf: DataFrame, recipe_configs: DataFrame,
                     cost_timeline: DataFrame | None = None, flavour: str = "manual") -> DataFrame:
    """One JSON document per cluster -- ``clusterConf`` (fields in a
    fixed order), ``recipeSparkConf`` (recipes by ``position`` where that column is
    given, else by name) and an optional ``cost_timeline``."""
    r = recipe_configs.select(
        "cluster_name", "recipe_filename", F.col("position" if "position" in recipe_configs.columns else "recipe_filename").alias("_at"),
        F.struct(F.lit(5).alias("parallelizationFactor"), F.col("spark_opts").alias("sparkOptsMap"),
                 "total_executor_minimum_allocated_memory_gb", "total_executor_maximum_allocated_memory_gb",
                 F.try_element_at("extra", F.lit("appliedMemoryHeapBoostFactor")).cast("double")
                 .alias("appliedMemoryHeapBoostFactor"),
                 F.try_element_at("extra", F.lit("appliedExecutorScaleFactor")).cast("double")
                 .alias("appliedExecutorScaleFactor"),
                 F.try_element_at("extra", F.lit("lastTunedDate")).alias("lastTunedDate"),
                 F.try_element_at("extra", F.lit("keptWithoutCurrentDate")).cast("boolean")
                 .alias("keptWithoutCurrentDate")).alias("conf"))
    recipes = deal_by(r, "cluster_name").groupBy("cluster_name").agg(
        F.map_from_entries(F.transform(F.array_sort(
            F.collect_list(F.struct("_at", "recipe_filename", "conf")),
            lambda a, b: F.when(a["_at"] < b["_at"], -1).when(a["_at"] > b["_at"], 1).otherwise(0)),
            lambda e: F.struct(e["recipe_filename"], e["conf"]))).alias("recipeSparkConf"))
    fields = [c for c in cluster_conf.columns if c != "cluster_name"]
    c = cluster_conf.select("cluster_name", F.create_map(F.col("cluster_name"), F.struct(*fields)).alias("clusterConf"))
    doc = c.join(recipes, "cluster_name", "left")
    parts = [F.col("clusterConf"), F.col("recipeSparkConf")]
    if cost_timeline is not None:
        # parsed to a variant, so arrays and numbers stay what they are in the document
        doc = doc.join(cost_timeline.select("cluster_name", F.parse_json("cost_timeline").alias("cost_timeline")),
                       "cluster_name", "left")
        parts.append(F.col("cost_timeline"))
    suffix = "manually-tuned" if flavour == "manual" else "auto-scale-tuned"
    return doc.select("cluster_name", F.concat(F.col("cluster_name"), F.lit(f"-{suffix}.json")).alias("file_name"),
                      F.to_json(F.struct(*parts)).alias("value"))


def write_config_documents(docs: DataFrame, out_dir: str, mode: str = "overwrite") -> None:
    """Write one text file per cluster (partition folder ``cluster_name=...``)."""
    docs.select("cluster_name", "value").write.mode(mode).partitionBy("cluster_name").text(out_dir)


def write_report(df: DataFrame, out_dir: str, single_file: bool = True, mode: str = "overwrite") -> None:
    """K3 / K4 / K5 / K6: a CSV report with header.  Reports are small per-cluster
    or per-metric tables; ``single_file`` coalesces them to one part file."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).csv(out_dir)


def run_summary(decisions: DataFrame, boosts: DataFrame | None = None) -> DataFrame:
    """K8: counts by trend, by action, and boost groups with new / holding counts,
    as one long table (section, label, count)."""
    # decisions carry the trend, so one pass counts both
    both = F.array(F.struct(F.lit("trend").alias("section"), F.col("trend").alias("label")),
                   F.struct(F.lit("action").alias("section"), F.col("action").alias("label")))
    out = decisions.select(F.inline(both)).groupBy("section", "label").agg(F.count(F.lit(1)).alias("n"))
    if boosts is not None:
        b = boosts.groupBy("state").agg(F.count_distinct(*KEYS).alias("n")).select(
            F.lit("boost").alias("section"), F.col("state").alias("label"), "n")
        out = out.unionByName(b)
    return out

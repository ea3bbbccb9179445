"""Referential-integrity checks (G7): violation rows, one per (check, cluster).

* ``event_outside_spans``  -- an autoscaler event no incarnation of its cluster
  contains (bucketed interval join, then anti join on the event identity);
* ``target_out_of_bounds`` -- a recommended worker count outside [min, max];
* ``duplicate_incarnation`` -- (cluster, incarnation_idx) not unique;
* ``recipe_without_config`` -- a run whose (cluster, recipe) no config names;
* ``duplicate_recipe``     -- (cluster, recipe) named by several configs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.interval import interval_join


def integrity_violations(spans: DataFrame, autoscaler: DataFrame) -> DataFrame:
    ev = autoscaler.select("cluster_name", "event_ts",
                           F.coalesce("recommendation_id", F.lit("")).alias("_event_key"),
                           "target_primary_workers", "min_primary_workers", "max_primary_workers")
    key = ["cluster_name", "event_ts", "_event_key"]   # non-null identity for the anti join
    inside = interval_join(spans.select("cluster_name", "incarnation_idx", "span_start_ts", "span_end_ts"),
                           ev.select(*key), ["cluster_name"], "span_start_ts", "span_end_ts", "event_ts",
                           bucket_seconds=86400).select(*key).distinct()
    outside = ev.join(inside, key, "left_anti").groupBy("cluster_name").agg(
        F.count(F.lit(1)).alias("violations")).withColumn("check_name", F.lit("event_outside_spans"))
    bad_target = ev.filter(F.col("target_primary_workers").isNotNull() & (
        (F.col("target_primary_workers") < F.col("min_primary_workers"))
        | (F.col("target_primary_workers") > F.col("max_primary_workers"))))
    bounds = bad_target.groupBy("cluster_name").agg(F.count(F.lit(1)).alias("violations")) \
        .withColumn("check_name", F.lit("target_out_of_bounds"))
    dups = (spans.groupBy("cluster_name", "incarnation_idx").count().filter(F.col("count") > 1)
            .groupBy("cluster_name").agg(F.count(F.lit(1)).alias("violations"))
            .withColumn("check_name", F.lit("duplicate_incarnation")))
    cols = ["check_name", "cluster_name", "violations"]
    return outside.select(*cols).unionByName(bounds.select(*cols)).unionByName(dups.select(*cols))


def config_violations(configs: DataFrame, runs: DataFrame) -> DataFrame:
    """G7 for recipe configs: runs of recipes without a config, and recipes that several configs name."""
    key, cols = ["cluster_name", "recipe_filename"], ["check_name", "cluster_name", "violations"]
    unknown = (runs.select(*key).join(configs.select(*key), key, "left_anti").groupBy("cluster_name")
               .agg(F.count(F.lit(1)).alias("violations")).withColumn("check_name", F.lit("recipe_without_config")))
    twice = (configs.groupBy(*key).count().filter(F.col("count") > 1).groupBy("cluster_name")
             .agg(F.count(F.lit(1)).alias("violations")).withColumn("check_name", F.lit("duplicate_recipe")))
    return unknown.select(*cols).unionByName(twice.select(*cols))

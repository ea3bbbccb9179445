"""Keyed table diff (G1), roll-up counts (G4), file inventory
(G2), consistent anonymisation (G5) and the distributed dense index it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _long(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    cols = [c for c in columns if c != key]
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.col(key).cast("string").alias("key"), F.inline(items))


def table_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """G1: keys only in A / only in B, and per-column differences of common keys.

    Values compare as text with a missing value as ""; columns are the union
    of both sides.  Output: key, category, column, value_A, value_B.
    """
    ka = a.select(F.col(key).cast("string").alias("key")).distinct().withColumn("_a", F.lit(True))
    kb = b.select(F.col(key).cast("string").alias("key")).distinct().withColumn("_b", F.lit(True))
    keys = ka.join(kb, "key", "full_outer")
    presence = keys.filter(F.col("_a").isNull() | F.col("_b").isNull()).select(
        "key", F.when(F.col("_a").isNull(), "only_in_B").otherwise("only_in_A").alias("category"),
        F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("value_A"),
        F.lit(None).cast("string").alias("value_B"))
    common = keys.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull()).select("key")
    columns = sorted(set(a.columns) | set(b.columns))
    la = _long(a, key, [c for c in columns if c in a.columns]).withColumnRenamed("value", "value_A")
    lb = _long(b, key, [c for c in columns if c in b.columns]).withColumnRenamed("value", "value_B")
    fields = (la.join(lb, ["key", "column"], "full_outer").join(common, "key", "left_semi")
              .select("key", F.lit("field_diff").alias("category"), "column",
                      F.coalesce("value_A", F.lit("")).alias("value_A"),
                      F.coalesce("value_B", F.lit("")).alias("value_B"))
              .filter(F.col("value_A") != F.col("value_B")))
    return presence.unionByName(fields)


def diff_counts(diff: DataFrame) -> DataFrame:
    """Rows per diff category."""
    return diff.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def file_inventory(spark: SparkSession, dir_a: str, dir_b: str) -> DataFrame:
    """Presence of each file name in two folders and byte equality (sha-256)."""
    def files(path, side):
        return (spark.read.format("binaryFile").load(path)
                .select(F.element_at(F.split("path", "/"), -1).alias("file"),
                        F.sha2("content", 256).alias(f"sha_{side}")))
    j = files(dir_a, "a").join(files(dir_b, "b"), "file", "full_outer")
    return j.select("file",
                    F.when(F.col("sha_a").isNull(), "only_in_B").when(F.col("sha_b").isNull(), "only_in_A")
                    .otherwise("in_both").alias("presence"),
                    F.when(F.col("sha_a").isNotNull() & F.col("sha_b").isNotNull(), F.col("sha_a") == F.col("sha_b"))
                    .alias("equal"))


def dense_index(values: DataFrame, col: str, partitions: int | None = None) -> DataFrame:
    """1-based position of each distinct value in sorted order, computed without a
    global window: range-partition, number inside each partition, add the counts
    of the preceding partitions (one row per partition)."""
    spark = values.sparkSession
    n = partitions or spark.sparkContext.defaultParallelism
    # range bounds come from a sample: both uses below must see one and the same division
    d = cut_lineage(values.select(col).filter(F.col(col).isNotNull()).distinct().repartitionByRange(n, col)
                    .withColumn("_pid", F.spark_partition_id()))
    local = d.withColumn("_local", F.row_number().over(Window.partitionBy("_pid").orderBy(col)))
    sizes = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return local.join(F.broadcast(offsets), "_pid").select(col, (F.col("_off") + F.col("_local")).alias("idx"))


ANON_CLUSTER = "cluster-wf_spark_{}"          # fixed values: anonymised name formats
ANON_RECIPE = "_SPARK_JOB_recipe_filename_{}.json"


def anonymise_dictionary(tables: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One global dictionary per name kind over all tables (sorted -> numbered)."""
    def names(c):
        parts = [t.select(F.col(c).alias("name")) for t in tables if c in t.columns]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.filter(F.col("name") != "")
    clusters = dense_index(names("cluster_name"), "name").select(
        F.col("name").alias("cluster_name"),
        F.concat(F.lit("cluster-wf_spark_"), F.col("idx").cast("string")).alias("anon_cluster_name"))
    recipes = dense_index(names("recipe_filename"), "name").select(
        F.col("name").alias("recipe_filename"),
        F.concat(F.lit("_SPARK_JOB_recipe_filename_"), F.col("idx").cast("string"), F.lit(".json"))
        .alias("anon_recipe_filename"))
    return clusters, recipes


def anonymise(table: DataFrame, clusters: DataFrame, recipes: DataFrame) -> DataFrame:
    """Rewrite cluster / recipe names of one table through the dictionaries."""
    out = table
    if "cluster_name" in table.columns:
        out = out.join(clusters, "cluster_name", "left").withColumn(
            "cluster_name", F.coalesce("anon_cluster_name", "cluster_name")).drop("anon_cluster_name")
    if "recipe_filename" in table.columns:
        out = out.join(recipes, "recipe_filename", "left").withColumn(
            "recipe_filename", F.coalesce("anon_recipe_filename", "recipe_filename")).drop("anon_recipe_filename")
    return out.select(*table.columns)

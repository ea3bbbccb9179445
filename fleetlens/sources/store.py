"""Snapshot store (S12, K7): tables partitioned by snapshot date, each date written once.

``write_once`` writes one date of one table to a folder of its own and then gives it its
place by a rename, so a reader never sees half a date, a job that is run again finds what
is there, and of two writers the first one's rows stay.  Readers use partition discovery:
a filter on ``snapshot_date`` reads only that date's files.

``runs_index`` reads the run metadata of all dates, newest first.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .files import path_exists

DATE = "snapshot_date"

RUN_SCHEMA = ("dir string, reference_date string, current_date string, strategy string, total_clusters long, total_recipes long, "
              "improved long, degraded long, stable long, new_entries long, dropped_entries long")


def folder_of_input(spark: SparkSession, name: str, *paths: str) -> str:
    """A folder below the shared checkpoint folder that belongs to the files (path, size, time) there are now."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(list(paths)).select(
        "path", "length", F.unix_millis("modificationTime").alias("changed")).collect()
    mark = hashlib.sha256(repr((paths, sorted(tuple(f) for f in files))).encode()).hexdigest()[:16]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{mark}"


def write_once(spark: SparkSession, folder: str, table: str, date: str, make: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> str:
    """Write ``make()`` as ``date`` of ``table`` (partitioned ``by`` more columns) unless it is there; returns its path."""
    place = f"{folder}/{table}/{DATE}={date}"
    if path_exists(spark, f"{place}/_SUCCESS"):
        return place
    made = f"{folder}/made-{uuid.uuid4().hex}"
    make().write.partitionBy(*by).parquet(made)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(made).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(fs_path(f"{folder}/{table}"))
    if path_exists(spark, place) or not fs.rename(fs_path(made), fs_path(place)):
        fs.delete(fs_path(made), True)  # another writer was first
    return place


def stored(spark: SparkSession, folder: str, table: str, date: str, make: Callable[[], DataFrame]) -> DataFrame:
    """One date of a table, written first if it isn't there."""
    return spark.read.parquet(write_once(spark, folder, table, date, make))


def every_date(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """All dates of a table, with ``snapshot_date``."""
    return spark.read.option("basePath", f"{folder}/{table}").parquet(f"{folder}/{table}").withColumn(DATE, F.col(DATE).cast("string"))


def load_snapshot(spark: SparkSession, folder: str, date: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of one date, each optional: an absent one is empty with its schema."""
    def one(table: str, schema: str) -> DataFrame:
        place = f"{folder}/{table}/{DATE}={date}"
        return spark.read.schema(schema).parquet(place) if path_exists(spark, place) else spark.createDataFrame([], schema)
    return {table: one(table, schema) for table, schema in schemas.items()}


def run_metadata(trends: DataFrame, directory: str, reference_date: str, current_date: str, strategy: str = "default") -> DataFrame:
    """One row that describes a comparison run: totals and recipes per trend."""
    of = lambda label: F.count(F.when(F.col("trend") == label, 1))
    counts = trends.agg(F.count_distinct("cluster_name").alias("total_clusters"), F.count(F.lit(1)).alias("total_recipes"),
                        of("improved").alias("improved"), of("degraded").alias("degraded"), of("stable").alias("stable"),
                        of("new_entry").alias("new_entries"), of("dropped_entry").alias("dropped_entries"))
    return counts.select(F.lit(directory).alias("dir"), F.lit(reference_date).alias("reference_date"),
                         F.lit(current_date).alias("current_date"), F.lit(strategy).alias("strategy"), "*")


def runs_index(spark: SparkSession, folder: str) -> DataFrame:
    """K7: every run whose metadata lies in the store, newest first (current date, then folder)."""
    if not path_exists(spark, f"{folder}/runs"):
        return spark.createDataFrame([], RUN_SCHEMA)
    rows = spark.read.schema(f"{RUN_SCHEMA}, {DATE} string").option("basePath", f"{folder}/runs").parquet(f"{folder}/runs").drop(DATE)
    return rows.orderBy(F.desc("current_date"), F.desc("dir"))

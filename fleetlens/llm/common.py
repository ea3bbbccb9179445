"""Helpers shared by the training-data operators.

Every operator takes and returns DataFrames.  Python runs only inside
``mapInArrow`` / ``applyInPandas`` tasks over rows that Spark partitioned, and
holds one slice of a batch at a time.  Intermediate tables go to the shared
folder named by ``spark.checkpoint.dir`` (never to a machine-local folder), so a
lost executor costs the recomputation of its tasks only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import cut_lineage, ensure_checkpoint_dir

__all__ = ["cut_lineage", "materialise", "slices", "shared_folder", "shuffle_width", "table", "text_rows"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder (as a full URI) below the cluster's shared checkpoint folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but keeps columns prunable, so a later
    step that needs two columns reads two columns.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) with nothing else, so clashing extra columns never reach an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``most_bytes`` of ``column`` (one row at least).

    Arrow batches are bounded by rows; with long texts a batch of Python strings
    could outgrow a worker, so operators convert one slice at a time.
    """
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(column))
        per_row = max(1, col.nbytes // b.num_rows)
        step = max(1, most_bytes // per_row)
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)

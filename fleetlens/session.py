"""Spark session helpers.

Every transform in the package takes and returns DataFrames; this module only
builds a session for tests / the bench and resolves the shared checkpoint
folder.  On a cluster the session is supplied by the caller and
``spark.checkpoint.dir`` names a shared (HDFS / object store) folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "fleetlens") -> SparkSession:
    """A local session configured like the cluster jobs (AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FLEETLENS_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.ansi.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch one only for a local master.

    The cluster names the folder in ``spark.checkpoint.dir`` or has set it on the
    context; neither is ever replaced.  Executors of a cluster don't see a folder
    of this machine, so without a setting only local runs (tests, bench) go on.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if known:
        if current is None:
            context.setCheckpointDir(known)
        return known
    if current is not None:
        return os.path.dirname(current.rstrip("/"))  # the context adds a folder of its own
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    scratch = tempfile.mkdtemp(prefix="fleetlens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", scratch)
    context.setCheckpointDir(scratch)
    return scratch


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared checkpoint folder (made by who writes there)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers (once per application).

    Tasks that run Python import it by name; a cluster's workers have neither the
    driver's working folder nor its path.
    """
    context = spark.sparkContext
    if getattr(context, "_fleetlens_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="fleetlens-ship-"), "fleetlens.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    context._fleetlens_shipped = True


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used where a plan is reused by several downstream jobs and recomputing it
    after a lost executor would be expensive.  Never ``localCheckpoint``: its
    blocks die with the executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def deal_by(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all shuffle partitions.

    For few groups that cost much each (a document per cluster): by their size alone AQE would put
    most of them into one task; a given number of partitions is left as it is.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

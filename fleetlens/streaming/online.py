"""Online folds over event streams: running executor counts (E1) and window counts whose state ends.

``fold_running_counts`` keeps keyed state per time bucket and shard of the applications (a hash),
so one call folds the rows of many applications at once.  A micro-batch touches only the groups
its rows fall in: new rows are put in event order among the rows of their application's bucket,
and what comes out are the rows from the first new one on, with their running count inside the
bucket, and one summary row of the bucket.  Carries between buckets are a window over the
summaries when the counts are read, so a row that arrives late changes its own bucket and nothing
is recomputed for the buckets after it.  An application's bucket that gets no row for ``keep``
lets its rows go and keeps its summary (a timer on the time of arrival, whose watermark no row
is ever behind); a row for such a bucket comes out marked as late, and reading recomputes just
that bucket from its landed rows.

``count_windows`` closes windows by its own watermark (the latest event time of earlier
batches less ``delay``): a closed window's count is written once and leaves the state; rows
for closed windows go to a side table, row by row, and are counted there.

Both write one folder per batch number, so a batch that is run again after a failure
overwrites its own output; ``compact`` joins finished batches into one table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship_package
from ..sources.files import make_folder, path_exists

APP = ["cluster_name", "recipe_filename"]
BUCKET = ["cluster_name", "recipe_filename", "bucket"]
FOLD_SCHEMA = ("kind string, cluster_name string, recipe_filename string, bucket long, event_id long, evt_us long, delta int, "
               "count long, most long, least long")
#: Per application of the group its name (JSON, a line each), when its bucket lets its rows go (GONE: it has) and its
#: summary (total, most, least); per row its application's number, id, time and step.  Packed.
STATE_SCHEMA = "apps string, until binary, sums binary, owners binary, ids binary, times binary, steps binary"
GONE = -1
#: Groups that a time bucket's applications are dealt to.
SHARDS = 64


def _held(state: GroupState) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Application names, times of letting go, sums (a row per application) and rows (owner, id, time, step) of a group."""
    if not state.exists:
        return [], np.zeros(0, np.int64), np.zeros((0, 3), np.int64), np.zeros((4, 0), np.int64)
    apps, until, sums, *rows = state.get
    unpack = lambda x: np.frombuffer(bytes(x), np.int64)
    return apps.split("\n"), unpack(until).copy(), unpack(sums).reshape(-1, 3).copy(), np.stack([unpack(x) for x in rows])


def _keep(state: GroupState, apps: list[str], until: np.ndarray, sums: np.ndarray, rows: np.ndarray, now: int) -> None:
    """Let the rows of buckets go whose time has come, keep the rest and wait for the next time."""
    until[(until != GONE) & (until <= now)] = GONE
    owners, ids, times, steps = rows[:, until[rows[0]] != GONE]
    state.update(("\n".join(apps), until.tobytes(), sums.tobytes(), owners.tobytes(), ids.tobytes(), times.tobytes(), steps.tobytes()))
    waiting = until[until != GONE]
    if len(waiting):
        state.setTimeoutTimestamp(int(waiting.min()))


def _fold(keep_ms: int):
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        apps, until, sums, rows = _held(state)
        now = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            _keep(state, apps, until, sums, rows, now)
            return
        new = pd.concat(list(frames))
        if not len(new):
            return
        code, seen = pd.factorize(new["app"])
        place = {app: k for k, app in enumerate(apps)}
        for app in seen:
            place.setdefault(app, len(place))
        apps, known = list(place), len(until)
        until = np.r_[until, np.zeros(len(apps) - known, np.int64)]
        sums = np.concatenate([sums, np.zeros((len(apps) - known, 3), np.int64)])
        names = [json.loads(app) for app in apps]
        cluster, recipe = (np.array([name.get(c) for name in names], object) for c in APP)

        def out(kind: str, owners: np.ndarray, **columns) -> pd.DataFrame:
            blank = {c: pd.array([pd.NA] * len(owners), "Int64") for c in ("event_id", "evt_us", "delta", "count", "most", "least") if c not in columns}
            return pd.DataFrame({"kind": kind, "cluster_name": cluster[owners], "recipe_filename": recipe[owners], "bucket": int(key[0])} | columns | blank,
                                index=range(len(owners)))[["kind", "cluster_name", "recipe_filename", "bucket", "event_id", "evt_us", "delta", "count", "most", "least"]]

        owner = np.array([place[app] for app in seen], np.int64)[code]
        came = np.stack([owner, *(new[c].to_numpy(np.int64) for c in ("event_id", "evt_us", "delta"))])
        late = until[came[0]] == GONE
        if late.any():
            yield out("late", came[0][late], event_id=came[1][late], evt_us=came[2][late], delta=came[3][late])
        came = came[:, ~late]
        touched = np.unique(came[0])
        until[touched] = int(new["arrived"].max().value // 1_000_000) + keep_ms
        if rows.shape[1]:  # a source that repeats a row counts it once
            came = came[:, ~pd.MultiIndex.from_arrays(came[:2]).isin(pd.MultiIndex.from_arrays(rows[:2]))]
        fresh = np.zeros(len(apps), bool)
        fresh[came[0]] = True
        of = fresh[rows[0]]  # rows of applications without a new one stay as they are
        mine, is_new = np.concatenate([rows[:, of], came], axis=1), np.r_[np.zeros(int(of.sum()), bool), np.ones(came.shape[1], bool)]
        order = np.lexsort((mine[1], mine[2], mine[0]))
        mine, is_new = mine[:, order], is_new[order]
        if mine.shape[1]:
            each = pd.DataFrame({"owner": mine[0], "step": mine[3], "new": is_new.astype(np.int8)}).groupby("owner", sort=False)
            count = each["step"].cumsum()
            ordered = count.groupby(mine[0], sort=False)
            most, least, changed = ordered.cummax().to_numpy(), ordered.cummin().to_numpy(), each["new"].cummax().to_numpy() > 0
            count = count.to_numpy()
            # rows before an application's first new one stay as they are
            yield out("event", mine[0][changed], event_id=mine[1][changed], evt_us=mine[2][changed], delta=mine[3][changed],
                      count=count[changed], most=most[changed], least=least[changed])
            last = np.r_[mine[0][1:] != mine[0][:-1], True]
            yield out("bucket", mine[0][last], count=count[last], most=most[last], least=least[last])
            sums[mine[0][last]] = np.stack([count[last], most[last], least[last]], axis=1)
            rows = np.concatenate([rows[:, ~of], mine], axis=1)
        _keep(state, apps, until, sums, rows, now)

    return fold


def fold_running_counts(events: DataFrame, work: str, bucket_seconds: int = 86400, keep: str = "30 days", shards: int = SHARDS) -> None:
    """Fold what the stream ``events`` (APP, event_id, evt_ts, executor_event) has into ``work`` and return when it is read.

    ``shards`` must stay the same over the runs of one ``work``.
    """
    spark = events.sparkSession
    ship_package(spark)
    out = make_folder(spark, f"{work}/batches")
    delta = F.when(F.col("executor_event") == "EXECUTOR_ADDED", 1).when(F.col("executor_event") == "EXECUTOR_REMOVED", -1)
    us = F.unix_micros("evt_ts")
    rows = events.select(F.to_json(F.struct(*APP)).alias("app"), F.floor(us / (bucket_seconds * 1_000_000)).cast("long").alias("bucket"),
                         F.pmod(F.xxhash64(*APP), F.lit(shards)).alias("shard"), "event_id", us.alias("evt_us"),
                         delta.alias("delta"), F.current_timestamp().alias("arrived")).where("delta is not null and evt_us is not null")
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    folded = rows.withWatermark("arrived", "0 seconds").groupBy("bucket", "shard").applyInPandasWithState(
        _fold(keep_ms), FOLD_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.EventTimeTimeout)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    (folded.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{work}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


def batches_of(spark: SparkSession, work: str, schema: str) -> DataFrame:
    """All batches written so far (a compacted table stands for the batches it joined)."""
    base, top = f"{work}/batches", _compacted(spark, work)
    new = spark.read.schema(f"{schema}, batch long").option("basePath", base).parquet(base).where(F.col("batch") > top)
    return new if top < 0 else spark.read.schema(f"{schema}, batch long").parquet(f"{work}/joined-{top}").union(new)


def _compacted(spark: SparkSession, work: str) -> int:
    """Number of the last batch that a finished compaction holds, or -1."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{work}/joined-*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    done = [f.getPath().toString() for f in found if path_exists(spark, f"{f.getPath().toString()}/_SUCCESS")]
    return max((int(x.rsplit("-", 1)[1]) for x in done), default=-1)


def compact(spark: SparkSession, work: str, schema: str = FOLD_SCHEMA, keys: tuple[str, ...] = ("kind", *BUCKET, "event_id")) -> None:
    """Join the batches into one table with the last version of every row, and drop what it replaces.

    The new table is complete before anything goes, so a stop in between loses nothing.
    """
    rows = batches_of(spark, work, schema)
    top, before = rows.agg(F.max("batch")).first()[0], _compacted(spark, work)
    if top is None or top == before:
        return
    last_of(rows, keys).write.mode("overwrite").parquet(f"{work}/joined-{top}")
    fs = spark._jvm.org.apache.hadoop.fs
    for old in ([f"{work}/joined-{before}"] if before >= 0 else []) + [f"{work}/batches/batch={k}" for k in range(max(before, -1) + 1, top + 1)]:
        path = fs.Path(old)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def last_of(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The version of the latest batch per key."""
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_v"), F.max("batch").alias("batch"))
    return picked.select(*[F.col(c) if c in keys or c == "batch" else F.col(f"_v.{c}").alias(c) for c in rows.columns])


def running_counts(spark: SparkSession, work: str) -> DataFrame:
    """Running count and its extrema per landed event: bucket-local values plus the carry of earlier buckets."""
    rows = last_of(batches_of(spark, work, FOLD_SCHEMA), ("kind", *BUCKET, "event_id")).drop("batch")
    late = rows.where("kind = 'late'").select(*BUCKET).distinct()
    events = rows.where("kind <> 'bucket'")
    inside = Window.partitionBy(*BUCKET).orderBy("evt_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    again = events.join(late, BUCKET, "left_semi").dropDuplicates([*BUCKET, "event_id"]).withColumn("count", F.sum("delta").over(inside))
    again = again.withColumn("most", F.max("count").over(inside)).withColumn("least", F.min("count").over(inside))
    settled = rows.join(late, BUCKET, "left_anti")
    local = settled.where("kind = 'event'").unionByName(again)
    sums = settled.where("kind = 'bucket'").select(*BUCKET, "count", "most", "least").unionByName(
        again.groupBy(*BUCKET).agg(F.sum("delta").alias("count"), F.max("most").alias("most"), F.min("least").alias("least")))
    before = Window.partitionBy(*APP).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    carry = sums.withColumn("_c", F.coalesce(F.sum("count").over(before), F.lit(0)))
    carry = carry.withColumn("_p", F.max(F.col("_c") + F.col("most")).over(before)).withColumn("_q", F.min(F.col("_c") + F.col("least")).over(before))
    joined = local.join(carry.select(*BUCKET, "_c", "_p", "_q"), BUCKET)
    kind = F.when(F.col("delta") > 0, "EXECUTOR_ADDED").otherwise("EXECUTOR_REMOVED")
    return joined.select(*APP, "event_id", F.timestamp_micros("evt_us").alias("evt_ts"), kind.alias("executor_event"),
                         (F.col("_c") + F.col("count")).alias("current_executors"),
                         F.greatest("_p", F.col("_c") + F.col("most")).alias("max_executors_seen"),
                         F.least("_q", F.col("_c") + F.col("least")).alias("min_executors_seen"))


# --- window counts with a watermark that closes windows -------------------------------------------

WINDOW_KEYS = ["window_start", "cluster_name", "executor_event"]
COUNTS = "window_start timestamp, cluster_name string, executor_event string, events long"
LATE = "window_start timestamp, cluster_name string, executor_event string, event_id long, evt_ts timestamp"
CLOCK = "clock_us long"


def count_windows(events: DataFrame, work: str, delay: str = "2 days", window: str = "1 day") -> None:
    """Count ``events`` per (window, cluster, kind) into ``work`` and return when the stream is read.

    Tables: ``closed`` (final counts), ``open`` (the state after each batch), ``late`` (rows that
    came for a closed window), ``clock`` (the watermark after each batch).  The state of a batch
    number is written from that of the number before, so running a batch again gives the same.
    """
    spark = events.sparkSession
    wait_us, width_us = (int(pd.Timedelta(x).total_seconds() * 1_000_000) for x in (delay, window))
    for name in ("closed", "open", "late", "clock"):
        make_folder(spark, f"{work}/{name}")

    def at(name: str, number: int, schema: str) -> DataFrame:
        path = f"{work}/{name}/batch={number}"
        return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)

    def write(batch: DataFrame, number: int) -> None:
        clock = at("clock", number - 1, CLOCK).agg(F.max("clock_us")).first()[0]
        rows = batch.select(F.window("evt_ts", window)["start"].alias("window_start"), "cluster_name", "executor_event", "event_id", "evt_ts")
        ends = F.unix_micros("window_start") + width_us
        gone = F.lit(False) if clock is None else ends <= clock
        rows.where(gone).write.mode("overwrite").parquet(f"{work}/late/batch={number}")
        latest = batch.agg(F.max(F.unix_micros("evt_ts"))).first()[0]
        clock = max((x for x in (clock, None if latest is None else latest - wait_us) if x is not None), default=None)
        spark.createDataFrame([(clock,)], CLOCK).write.mode("overwrite").parquet(f"{work}/clock/batch={number}")
        new = rows.where(~gone).groupBy(*WINDOW_KEYS).agg(F.count(F.lit(1)).alias("events"))
        counts = at("open", number - 1, COUNTS).unionByName(new).groupBy(*WINDOW_KEYS).agg(F.sum("events").alias("events"))
        over = F.lit(False) if clock is None else ends <= clock
        counts.where(over).write.mode("overwrite").parquet(f"{work}/closed/batch={number}")
        counts.where(~over).write.mode("overwrite").parquet(f"{work}/open/batch={number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{work}/open/batch={number - 2}")  # no batch goes back further than one
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    (events.writeStream.foreachBatch(write).option("checkpointLocation", f"{work}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


def window_counts(spark: SparkSession, work: str) -> DataFrame:
    """Per window, cluster and kind: events counted, whether the window is closed, and late events (not in ``events``)."""
    def every(name: str, schema: str) -> DataFrame:
        return spark.read.schema(f"{schema}, batch long").option("basePath", f"{work}/{name}").parquet(f"{work}/{name}")

    state = every("open", COUNTS)
    last = every("clock", CLOCK).agg(F.max("batch")).first()[0]  # each batch leaves a clock, an empty state no row
    zero = F.lit(0).cast("long")
    parts = [every("closed", COUNTS).select(*WINDOW_KEYS, "events", F.lit(True).alias("closed"), zero.alias("late")),
             state.where(F.col("batch") == F.lit(last)).select(*WINDOW_KEYS, "events", F.lit(False).alias("closed"), zero.alias("late")),
             every("late", LATE).select(*WINDOW_KEYS, zero.alias("events"), F.lit(True).alias("closed"), F.lit(1).cast("long").alias("late"))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy(*WINDOW_KEYS).agg(F.sum("events").alias("events"), F.bool_or("closed").alias("closed"), F.sum("late").alias("late"))

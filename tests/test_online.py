"""Online folds: shuffled files and restarts equal the batch queries, batches give changed rows only, state ends."""

import time

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from fleetlens import binding as B
from fleetlens import registry as R
from fleetlens.streaming import incremental as INC
from fleetlens.streaming import online as ON


@pytest.fixture()
def arrivals(spark, tmp_path):
    """A folder that takes parts of the events one after another, and the stream over it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ev = B.table(spark, SF_SMALL, "events").toPandas().sort_values("ts")
    folder = tmp_path / "arrived"
    folder.mkdir()

    def add(name, rows):
        rows.to_parquet(folder / f"{name}.parquet", index=False, coerce_timestamps="us")

    def stream():
        return B.executor_events(spark.readStream.schema(INC.EVENTS_SCHEMA).option("maxFileAge", "36500d").parquet(str(folder)))

    def batch(run, columns):
        return sorted(tuple(r) for r in run(B.executor_events(spark.read.schema(INC.EVENTS_SCHEMA).parquet(str(folder)))).select(*columns).collect())

    return ev, add, stream, batch, str(tmp_path / "work")


COLUMNS = ["cluster_name", "recipe_filename", "event_id", "evt_ts", "executor_event", "current_executors", "max_executors_seen", "min_executors_seen"]


def counted(events):
    from fleetlens.streaming.eventlog import executor_running_counts
    return executor_running_counts(events, ON.APP)


def online(spark, work):
    return sorted(tuple(r) for r in ON.running_counts(spark, work).select(*COLUMNS).collect())


def test_shuffled_files_restarts_changed_rows_and_compaction(spark, arrivals):
    ev, add, stream, batch, work = arrivals
    parts = [ev.iloc[500:], ev.iloc[:250], ev.iloc[250:500]]  # the newest rows come first
    for k, part in enumerate(parts):
        add(f"part-{k}", part)
        ON.fold_running_counts(stream(), work)  # a new query each time, from the state on disk
        assert online(spark, work) == batch(counted, COLUMNS)
        if k == 1:
            ON.compact(spark, work)
            assert online(spark, work) == batch(counted, COLUMNS)
    rows = ON.batches_of(spark, work, ON.FOLD_SCHEMA)
    last = rows.agg(F.max("batch")).first()[0]
    touched = {r.event_id for r in rows.where((F.col("batch") == last) & (F.col("kind") == "event")).collect()}
    steps = set(ev[ev.event_type.isin(["signup", "error"])].event_id)
    assert set(parts[2].event_id) & steps <= touched and len(touched) < len(steps)  # buckets without a new row stay as they are
    # the last event in time comes twice: it changes nothing
    add("again", ev.iloc[-1:])
    ON.fold_running_counts(stream(), work)
    assert online(spark, work) == sorted(set(batch(counted, COLUMNS)) & set(online(spark, work))) and len(online(spark, work)) == len(steps)


def test_quiet_buckets_let_their_rows_go_and_late_rows_still_count(spark, arrivals):
    ev, add, stream, batch, work = arrivals
    rare = ev.iloc[::40]
    add("first", ev.drop(rare.index).iloc[:600])
    ON.fold_running_counts(stream(), work, keep="1 second")
    time.sleep(1.2)
    add("second", ev.drop(rare.index).iloc[600:])
    ON.fold_running_counts(stream(), work, keep="1 second")
    time.sleep(1.2)
    for k in range(2):  # the timers run with the batches that follow
        add(f"late-{k}", rare.iloc[k::2])
        ON.fold_running_counts(stream(), work, keep="1 second")
    late = ON.batches_of(spark, work, ON.FOLD_SCHEMA).where("kind = 'late'").count()
    assert late > 0 and online(spark, work) == batch(counted, COLUMNS)


def test_windows_close_leave_the_state_and_count_late_rows(spark, arrivals):
    ev, add, stream, batch, work = arrivals
    rare = ev.iloc[::50]
    rest, sizes = ev.drop(rare.index), []
    for k in range(3):
        add(f"part-{k}", rest.iloc[k * 330 : (k + 1) * 330])
        ON.count_windows(stream(), work, delay="1 day")
        clock = spark.read.parquet(f"{work}/clock").agg(F.max("batch"), F.max("clock_us")).first()
        state = spark.read.parquet(f"{work}/open/batch={clock[0]}")
        sizes.append(state.count())
        assert state.where(F.unix_micros("window_start") + 86_400_000_000 <= clock[1]).count() == 0
    add("late", rare)
    ON.count_windows(stream(), work, delay="1 day")
    got = ON.window_counts(spark, work)
    total = {(r.window_start, r.cluster_name, r.executor_event): r.events + r.late for r in got.collect()}
    want = batch(lambda e: e.groupBy(F.window("evt_ts", "1 day")["start"].alias("w"), "cluster_name", "executor_event").agg(F.count("*").alias("n")), ["w", "cluster_name", "executor_event", "n"])
    assert total == {(w, c, e): n for w, c, e, n in want}
    assert max(sizes) < got.count() / 3  # open windows only
    assert got.agg(F.sum("late")).first()[0] > 0
    assert got.where("closed").count() > 0 and got.where("not closed").count() > 0


def test_registered_queries_are_here():
    assert {"online_executor_counts", "online_window_counts", "event_log_counts", "event_log_lifecycle"} <= set(R.queries())


def test_one_fold_call_takes_many_applications(spark, arrivals, monkeypatch):
    """A call per application and day made the time follow the number of applications: more calls than rows of a small fleet."""
    ev, add, stream, batch, work = arrivals
    calls = spark.sparkContext.accumulator(0)
    made = ON._fold

    def counting(keep_ms):
        fold = made(keep_ms)

        def counted_fold(key, frames, state):
            calls.add(1)
            yield from fold(key, frames, state)
        return counted_fold

    monkeypatch.setattr(ON, "_fold", counting)
    wide = ev.assign(user_id=range(len(ev)))  # an application per event
    for k in range(2):
        add(f"part-{k}", wide.iloc[k::2])
        ON.fold_running_counts(stream(), work, bucket_seconds=30 * 86400)
    assert online(spark, work) == batch(counted, COLUMNS)
    assert 0 < calls.value <= 2 * 2 * ON.SHARDS < len(online(spark, work))

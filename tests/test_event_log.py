"""Event logs: rolling files in order, odd lines, starts heard of once or twice, applications that still run."""

import datetime as dt
import json

from pyspark.sql import functions as F

from fleetlens.sources import event_log as EVL
from fleetlens.streaming import eventlog as EL

T0 = 1704067200000  # 2024-01-01 in milliseconds


def at(ms):
    return dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)


def executor(added, ms, name):
    return json.dumps({"Event": EVL.EXECUTOR_ADDED if added else EVL.EXECUTOR_REMOVED, "Timestamp": T0 + ms, "Executor ID": name,
                       "Executor Info": {"Host": "h", "Total Cores": 4}})


def test_rolling_files_odd_lines_and_order(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    log = tmp_path / "eventlog_v2_app-7"
    log.mkdir()
    start = json.dumps({"Event": EVL.APP_START, "App Name": "cluster-1/_R_.json", "App ID": "app-7", "Timestamp": T0})
    # all at one time: only the files' numbers and the lines' places tell the order; 10 comes after 2
    (log / "events_10_app-7").write_text("\n".join([executor(False, 5, "c"), executor(False, 5, "b")]))
    (log / "events_1_app-7").write_text("\n".join(["{broken", '"text"', '{"Event":"SparkListenerLogStart","Spark Version":"4"}', start, executor(True, 5, "a")]))
    (log / "events_2_app-7").write_text("\n".join([executor(True, 5, "b"), '{"Timestamp":1}', executor(True, 5, "c"), '{"Event":"SparkListenerExecutorAdded","Timestamp":"soon"}']))
    (tmp_path / "app-8.inprogress").write_text("\n".join([json.dumps({"Event": EVL.ENVIRONMENT, "Spark Properties": {EVL.APP_NAME_KEY: "cluster-2/x"}}), executor(False, 1, "z")]))
    events = EVL.executor_events_of(EVL.read_event_log(spark, str(tmp_path)))
    got = EL.executor_running_counts(events, ["cluster_name", "recipe_filename"], tie="place").orderBy("app_id", "place").collect()
    seven = [(r.executor_id, r.current_executors, r.max_executors_seen, r.min_executors_seen) for r in got if r.app_id == "app-7"]
    assert seven == [("a", 1, 1, 1), ("b", 2, 2, 1), ("c", 3, 3, 1), ("c", 2, 3, 1), ("b", 1, 3, 1)]
    assert [(r.cluster_name, r.recipe_filename, r.current_executors) for r in got if r.app_id == "app-8"] == [("cluster-2", "x", -1)]


def starts(spark, real, context):
    rows = lambda x: spark.createDataFrame([(a, at(ms)) for a, ms in x], "app_id string, ts timestamp_ntz").withColumn("ts", F.col("ts").cast("timestamp"))
    return EL.reconciled_starts(rows(real), rows(context))


def test_starts_are_counted_once(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    day = 86_400_000
    real = [("both", 1000), ("same", 0), ("late", 2001), ("real", 7), ("two", 1500), ("two", 1600), ("again", 500), ("again", 3 * day + 500), ("edge", day + 1)]
    context = [("both", 0), ("same", 0), ("late", 0), ("context", 9), ("two", 0), ("two", 1000), ("again", 0), ("again", 3 * day), ("edge", day - 1)]
    got = {}
    for r in starts(spark, real, context).select("app_id", F.unix_millis("start_ts").alias("s"), F.unix_millis("context_ts").alias("c"), "synthetic").collect():
        got.setdefault(r.app_id, []).append((r.s - T0, None if r.c is None else r.c - T0, r.synthetic))
    got = {k: sorted(v) for k, v in got.items()}
    assert got["both"] == [(1000, 0, False)] and got["same"] == [(0, 0, False)]
    assert got["late"] == [(0, 0, True), (2001, None, False)]
    assert got["real"] == [(7, None, False)] and got["context"] == [(9, 9, True)]
    assert got["two"] == [(0, 0, True), (1500, 1000, False), (1600, None, False)]
    assert got["again"] == [(500, 0, False), (3 * day + 500, 3 * day, False)]
    assert got["edge"] == [(day + 1, day - 1, False)]  # over the border of a time bucket


def test_ends_and_running_applications(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    s = starts(spark, [("a", 0), ("a", 10_000), ("b", 0)], [])
    ends = spark.createDataFrame([("a", at(4_000)), ("c", at(1))], "app_id string, ts timestamp_ntz").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(r.app_id, r.app_duration_millis, r.running, r.uptime_millis) for r in EL.started_lifecycle(s, ends, "2024-01-01 00:01:00").collect()}
    assert got == {("a", 4_000, False, 4_000), ("a", None, True, 50_000), ("b", None, True, 60_000)}


def test_joined_log_has_few_files_and_keeps_every_line(spark, tmp_path):
    """A file per application and roll made the number of files follow the number of applications."""
    odd = ["app-tab\tx", "app-é/ü", 'app-"q"', "app-\n"]
    apps = [*odd, *[f"app-{k}" for k in range(100)]]
    rows = [(a, roll, step, executor(step % 2 == 0, step, f"{roll}-{step}")) for a in apps for roll in (2, 10, -1) for step in range(4)]
    lines = spark.createDataFrame(rows, "app string, roll long, at int, line string").repartition(7)
    path = EVL.write_event_log(lines, str(tmp_path / "log"))
    files = [f for f in (tmp_path / "log").rglob("part-*") if f.is_file()]
    assert len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {}
    for r in sorted(EVL.read_event_log(spark, path).select("app_id", "place", "executor_id").collect(), key=lambda r: r.place):
        got.setdefault(r.app_id, []).append(r.executor_id)
    assert got == {a: [f"{roll}-{step}" for roll in (-1, 2, 10) for step in range(4)] for a in apps}

"""Steps whose cost must follow the rows they need: files of a stored log, events read per week."""

import datetime as dt
import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from fleetlens import binding as B
from fleetlens import registry as R
from fleetlens import registry_documents as RD
from fleetlens.operators import interval as IV
from fleetlens.plans import documents as DO
from fleetlens.plans import log_queries as LQ
from fleetlens.sources import sinks as SK
from fleetlens.sources import logs as L
from fleetlens.sources import store as SS


def test_a_large_partition_of_the_stored_log_gets_more_files(spark, tmp_path):
    """Four slices a date and type made tasks grow with the log."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "8KB")
    try:
        logs = B.raw_logs(B.table(spark, SF_SMALL, "events")).withColumn("timestamp", F.lit(dt.datetime(2024, 1, 1, 12)))
        logs = logs.repartition(16, "insert_id")  # many tasks, as a large log has
        L.with_partitions(logs).write.partitionBy(*L.PARTITIONS).parquet(str(tmp_path / "log"))
    finally:
        spark.conf.set(size, before)
    for kind in (L.RT_JOB, L.RT_CLUSTER):
        assert len(list((tmp_path / "log").glob(f"date=*/resource_type={kind}/part-*"))) > 4
    stored = L.read_stored_logs(spark, str(tmp_path / "log")).select(*logs.columns)
    assert stored.exceptAll(logs).count() == 0 and logs.exceptAll(stored).count() == 0


def test_a_week_reads_its_own_events_only(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events, folder = B.table(spark, SF_SMALL, "events"), str(tmp_path)
    weeks, total = RD.weeks_of(events), 0
    for week in weeks:
        own = RD.events_of_week(spark, folder, events, week)
        assert own.columns == events.columns
        assert own.select(F.date_format(F.date_trunc("week", F.col("ts").cast("timestamp")), "yyyy-MM-dd")).distinct().collect() == [(week,)]
        read = own.select(F.input_file_name().alias("f")).distinct().collect()
        assert read and all(f"week={week}" in r.f for r in read)
        total += own.count()
    assert len(weeks) > 1 and total == events.count()


def test_the_stored_log_is_decoded_once(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    plan = RD._stored_b13(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "json_tuple" not in plan
    assert SS.path_exists(spark, f"{RD._raw_log_folder(spark, SF_SMALL)}/telemetry/{SS.DATE}=all/_SUCCESS")


def _runs_and_events(spark):
    """Runs of minutes to two days, two of them at once, and events at their edges."""
    t0 = dt.datetime(2024, 1, 1, 20)
    spans = [(0, 5), (1, 60), (2, 26 * 60), (3, 48 * 60), (4, 0)]
    at = lambda m: t0 + dt.timedelta(minutes=m)
    runs = spark.createDataFrame([(f"r{i}", "c", f"j{i % 2}", at(i), at(i + m), m * 60000) for i, m in spans],
                                 "run_id string, cluster_name string, recipe_filename string, app_start_ts timestamp, app_end_ts timestamp, app_duration_millis long")
    events = spark.createDataFrame([(n, "c", f"j{n % 2}", at(m), "EXECUTOR_ADDED", n % 5, n % 7) for n, m in enumerate([0, 1, 2, 3, 4, 5, 60, 61, 239, 240, 241, 700, 1500, 1562, 2000, 2883])],
                                   "event_id long, cluster_name string, recipe_filename string, evt_ts timestamp, executor_event string, current_no_executors long, max_executors_seen long")
    return runs, events


def test_segments_of_runs_in_one_bucket_and_over_many(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    runs, events = _runs_and_events(spark)
    one, many = (LQ.events_in_runs(runs, events, reach=r) for r in ("one", "many"))
    assert one.count() and many.count()
    got = {(r.run_id, r.event_id): (r.next_evt_ts, r.seg_seconds) for r in LQ.run_segments(runs, events).collect()}
    want = {}
    for run in runs.collect():
        inside = sorted((e.evt_ts, e.event_id) for e in events.collect() if e.recipe_filename == run.recipe_filename and run.app_start_ts <= e.evt_ts <= run.app_end_ts)
        for i, (at, event) in enumerate(inside):
            after = inside[i + 1][0] if i + 1 < len(inside) else None
            want[run.run_id, event] = (after, int((min(after or run.app_end_ts, run.app_end_ts) - at).total_seconds()))
    assert got == want


def test_runs_of_a_day_are_not_multiplied_nor_moved_again(spark):
    """Six-hour buckets made up to five rows of a run, and each of its events went through a second exchange."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ev = B.table(spark, SF_SMALL, "events")
    runs, events = B.runs(ev), B.executor_events(ev)
    assert IV.dense_key_widths(events, LQ.KEYS, "evt_ts").count() == 0
    assert LQ.events_in_runs(runs, events, reach="many").count() == 0  # a run of the binding lies in its day
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # as for large tables
    try:
        plan = LQ.run_segments(runs, events)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, before)
    window = plan.index("Window")  # the first branch: its rows come from the join as they are
    assert "Exchange" not in plan[window:plan.index("SortMergeJoin", window)]


def _filters(df):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if re.match(r"[\s:+|-]*Filter", line)]


def test_log_fields_are_decoded_once(spark):
    """Filters on a decoded column repeated the decoding, and what the record is made of."""
    ev = B.table(spark, SF_SMALL, "events")
    for df in (LQ.b14_nonzero_exits(B.exit_code_logs(ev)), LQ.b20_incarnations(B.audit_logs(ev)), LQ.driver_log_signals(B.driver_logs(ev)),
               R.CO.cost_events(LQ.b21_recommendations(B.autoscaler_logs(ev), ordered=False))):
        assert _filters(df) and not any(re.search("get_json_object\\(to_json|to_json|regexp_extract", f) for f in _filters(df))


def test_stored_signals_and_exit_codes_are_not_sorted(spark):
    plan = R.exit_code_table(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" not in plan


def test_documents_are_dealt_over_the_tasks(spark):
    """By their size alone all files went to one task."""
    conf = spark.range(40).select(F.concat(F.lit("c-"), "id").alias("cluster_name"), F.lit(3).alias("num_workers"))
    recipes = conf.select("cluster_name", F.lit("_A.json").alias("recipe_filename"), F.create_map(F.lit("k"), F.lit("v")).alias("spark_opts"),
                          F.lit(1).alias("total_executor_minimum_allocated_memory_gb"), F.lit(1).alias("total_executor_maximum_allocated_memory_gb"),
                          F.create_map().cast("map<string,string>").alias("extra"))
    docs = SK.config_documents(conf, recipes)
    parts = docs.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1 and docs.count() == 40
    leaves = DO.flatten(docs).select(F.spark_partition_id().alias("p"), "path")
    assert "REPARTITION_BY_NUM" in leaves._jdf.queryExecution().executedPlan().toString()

"""Sources, sinks, diff / anonymisation, boosts and the streaming jobs."""
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import diff as DF
from fleetlens.plans import boosts as BO
from fleetlens.sources import inputs as IN
from fleetlens.sources import sinks as SK
from fleetlens.streaming import eventlog as EL
from conftest import SF_SMALL, ts


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_csv_first_row_wins_and_validation(spark):
    d = tempfile.mkdtemp(prefix="fleetlens-csv-")
    p = os.path.join(d, "dag.csv")
    _write(p, 'DAG_ID,CLUSTER_NAME\n dag-a , c1\n\ndag-b,c1\n,c2\ndag-c,c3\n')
    m = {r.cluster_name: r.dag_id for r in IN.dag_map(spark, p).collect()}
    assert m == {"c1": "dag-a", "c3": "dag-c"}
    v = IN.validate_input(IN.read_csv(spark, p), "dag", ["DAG_ID", "CLUSTER_NAME", "TIME"]).first()
    assert (v.valid, v.missing_columns, v.row_count) == (False, "TIME", 4)


def test_individual_merge_quirks(spark):
    k = "cluster_name string, recipe_filename string"
    b1 = spark.createDataFrame([("c", "r1", 3.0)], f"{k}, avg_executors_per_job double")
    b12 = spark.createDataFrame([("c", "r2", 7.0, None)], f"{k}, p95_run_max_executors double, runs long")
    b3 = spark.createDataFrame([("c", "r1", 100.0)], f"{k}, avg_job_duration_ms double")
    b8 = spark.createDataFrame([("c", "r1", None, 9), ("c", "r2", 50.0, 4)], f"{k}, p95_job_duration_ms double, runs long")
    b5 = spark.createDataFrame([], f"{k}, seconds_at_cap long, runs_reaching_cap long, total_runs long, "
                                   "fraction_reaching_cap double")
    b11 = spark.createDataFrame([("c", 3)], "cluster_name string, max_concurrent_jobs int")
    got = {r.recipe_filename: r for r in IN.merge_individual(b1, b12, b3, b8, b5, b11).collect()}
    assert got["r1"].runs == 0                      # no b12 row -> 0 even though b8 has 9
    assert got["r1"].p95_job_duration_ms == 100.0   # b8 row with null p95 -> average
    assert got["r2"].runs == 4                      # b12 runs null -> b8 runs
    assert got["r2"].avg_executors_per_job == 1.0 and got["r1"].max_concurrent_jobs == 3


def test_config_round_trip(spark):
    conf = spark.createDataFrame([("c1", 3, "n2-standard-32", "n2-standard-32")],
                                 "cluster_name string, num_workers int, master_machine_type string, "
                                 "worker_machine_type string")
    manual = spark.createDataFrame([("c1", "_A.json", 4, 8, 16)], "cluster_name string, recipe_filename string, "
                                   "spark_executor_instances int, spark_executor_cores int, spark_executor_memory_gb int")
    recipes = BO.configs_from_manual(manual)
    docs = SK.config_documents(conf, recipes).collect()
    assert docs[0].file_name == "c1-manually-tuned.json"
    doc = json.loads(docs[0].value)
    assert doc["clusterConf"]["c1"]["num_workers"] == 3
    assert doc["recipeSparkConf"]["_A.json"]["sparkOptsMap"]["spark.executor.memory"] == "16g"
    d = tempfile.mkdtemp(prefix="fleetlens-cfg-")
    _write(os.path.join(d, "c1-manually-tuned.json"), docs[0].value)
    _write(os.path.join(d, "broken-manually-tuned.json"), "{not json")
    clusters, rec = IN.read_configs(spark, os.path.join(d, "*-tuned.json"))
    assert [r.cluster_name for r in clusters.collect()] == ["c1"]
    r = rec.first()
    assert (r.recipe_filename, r.total_executor_maximum_allocated_memory_gb) == ("_A.json", 64)


def test_table_diff_and_anonymise(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k int, s string, v double")
    b = spark.createDataFrame([(2, "y", 2.5), (3, "z", 3.0)], "k int, s string, v double")
    rows = sorted((r.key, r.category, r.column) for r in DF.table_diff(a, b, "k").collect())
    assert rows == [("1", "only_in_A", None), ("2", "field_diff", "v"), ("3", "only_in_B", None)]
    t1 = spark.createDataFrame([("cb", "r2"), ("ca", "r1")], "cluster_name string, recipe_filename string")
    t2 = spark.createDataFrame([("cc", 1)], "cluster_name string, x int")
    clusters, recipes = DF.anonymise_dictionary([t1, t2])
    m = {r.cluster_name: r.anon_cluster_name for r in clusters.collect()}
    assert m == {"ca": "cluster-wf_spark_1", "cb": "cluster-wf_spark_2", "cc": "cluster-wf_spark_3"}


def test_dense_index_matches_sorted_order(spark):
    df = spark.range(0, 500).select((F.col("id") * 7919 % 1000).cast("string").alias("v"))
    got = sorted((r.v, r.idx) for r in DF.dense_index(df, "v", partitions=7).collect())
    want = [(v, i + 1) for i, v in enumerate(sorted({r.v for r in df.collect()}))]
    assert got == want


CONF = ("cluster_name string, recipe_filename string, spark_opts map<string,string>, "
        "total_executor_minimum_allocated_memory_gb int, total_executor_maximum_allocated_memory_gb int, "
        "extra map<string,string>")


def test_heap_boost_lifecycle(spark):
    conf = spark.createDataFrame([
        ("c", "new.json", {"spark.executor.memory": "3g"}, 3, 3, {}),
        ("c", "again.json", {"spark.executor.memory": "5g"}, 5, 5, {"appliedMemoryHeapBoostFactor": "1.5"}),
        ("c", "hold.json", {"spark.executor.memory": "5g"}, 5, 5, {"appliedMemoryHeapBoostFactor": "1.5"}),
        ("c", "quiet.json", {"spark.executor.memory": "4g"}, 4, 4, {}),
    ], CONF)
    cur = spark.createDataFrame([("c", "new.json"), ("c", "again.json")], "cluster_name string, recipe_filename string")
    st = {r.recipe_filename: r for r in BO.heap_boost_state(conf, cur, cur).collect()}
    assert (st["new.json"].state, st["new.json"].boosted_memory) == ("new", "5g")       # ceil(3 x 1.5)
    assert (st["again.json"].state, st["again.json"].cumulative_factor) == ("re-boost", 2.25)
    assert (st["hold.json"].state, st["hold.json"].boosted_memory) == ("holding", "5g")
    assert "quiet.json" not in st
    applied = {r.recipe_filename: r for r in BO.flat_config(BO.apply_heap_boosts(
        conf, BO.heap_boost_state(conf, cur, cur))).collect()}
    assert applied["new.json"].executor_memory == "5g"
    assert applied["new.json"].total_executor_maximum_allocated_memory_gb == 5


def test_scale_boost_skips_fixed_size(spark):
    conf = spark.createDataFrame([
        ("c", "da.json", {"spark.dynamicAllocation.enabled": "true", "spark.dynamicAllocation.minExecutors": "2",
                          "spark.dynamicAllocation.maxExecutors": "3", "spark.executor.memory": "4g"}, 8, 12, {}),
        ("c", "fixed.json", {"spark.executor.instances": "4", "spark.executor.memory": "4g"}, 16, 16, {}),
    ], CONF)
    sig = spark.createDataFrame([("c", "da.json"), ("c", "fixed.json")], "cluster_name string, recipe_filename string")
    st = {r.recipe_filename: r for r in BO.scale_boost_state(conf, sig, sig).collect()}
    assert set(st) == {"da.json"}
    assert st["da.json"].boosted_max_executors == 5     # max(3 + 1, ceil(3 x 1.5))


def test_signal_resolution_by_sibling_and_name(spark):
    conf = spark.createDataFrame([("c", "_ETL_M_LOAD.json", {}, 0, 0, {})], CONF)
    sig = spark.createDataFrame([
        ("etl-m-load-20260411-0438", "c", None), ("etl-x-20260411-0438", "c", "_X.json"),
        ("etl-x-20260412-0100", "c", ""), ("other-20260411-0438", "c", None)],
        "job_id string, cluster_name string, recipe_filename string")
    got = {r.job_id: (r.recipe_filename, r.resolution) for r in BO.resolve_signals(sig, conf).collect()}
    assert got["etl-m-load-20260411-0438"] == ("_ETL_M_LOAD.json", "derived")
    assert got["etl-x-20260412-0100"] == ("_X.json", "sibling")
    assert got["other-20260411-0438"] == (None, "none")


def test_streaming_window_counts_match_batch(spark):
    from fleetlens import registry as R
    s = R.queries()["stream_counts"](spark, SF_SMALL)
    ev = R.B.executor_events(R.B.table(spark, SF_SMALL, "events"))
    b = ev.groupBy(F.date_trunc("day", "evt_ts").alias("window_start"), "cluster_name", "executor_event").count()
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def test_prioritised_signals_prefer_current(spark):
    schema = "job_id string, cluster_name string, recipe_filename string, latest_driver_log_ts string"
    cur = spark.createDataFrame([("j2", "c", "a.json", "2026-01-02"), ("j3", "c", "", "2026-01-02")], schema)
    ref = spark.createDataFrame([("j1", "c", "a.json", "2026-01-01"), ("j0", "c", "b.json", "2026-01-01")], schema)
    got = {r.recipe_filename: (r.job_id, r.from_reference) for r in BO.prioritised_signals(cur, ref).collect()}
    assert got == {"a.json": ("j2", 0), "b.json": ("j0", 1)}


def test_oom_signal_source_filters_heap(spark):
    df = spark.createDataFrame([("j1", '"c1"', "a.json", "t", "m", "TRUE"), ("j2", "c1", None, "t", "m", "false"),
                                ("", "c1", "x", "t", "m", "TRUE")],
                               "job_id string, cluster_name string, recipe_filename string, "
                               "latest_driver_log_ts string, latest_driver_message string, is_java_heap string")
    rows = IN.oom_signals_table(df).collect()
    assert [(r.job_id, r.cluster_name) for r in rows] == [("j1", "c1")]


def test_kept_cluster_cost_uses_deployed_shapes(spark):
    from fleetlens.plans import catalog as CA
    from fleetlens.plans import cost as CO
    conf = spark.createDataFrame([("c1", 9, "e2-standard-32", "e2-standard-32")],
                                 "cluster_name string, num_workers int, worker_machine_type string, "
                                 "master_machine_type string")
    spans = spark.createDataFrame([("c1", 1, ts("2099-01-02T00:00:00"), ts("2099-01-02T06:00:00"), True, True)],
                                  "cluster_name string, incarnation_idx int, span_start_ts timestamp, "
                                  "span_end_ts timestamp, has_explicit_create boolean, has_explicit_delete boolean")
    events = CO.cost_events(spark.createDataFrame([], "cluster_name string, event_ts timestamp, state string, "
                                                      "current_primary_workers int, target_primary_workers int, "
                                                      "recommendation_id string"))
    c = CO.kept_cluster_costs(conf, CA.machine_prices(spark), spans, events).first()
    # (9 workers + 1 master) x e2-standard-32 for 6 hours, the published golden cost
    assert c.estimated_cost_eur == pytest.approx(96.768, abs=1e-3)
    assert c.wall_clock_minutes == pytest.approx(360.0)


def test_file_inventory(spark):
    a, b = tempfile.mkdtemp(prefix="fleetlens-a-"), tempfile.mkdtemp(prefix="fleetlens-b-")
    _write(os.path.join(a, "same.csv"), "x\n1\n")
    _write(os.path.join(b, "same.csv"), "x\n1\n")
    _write(os.path.join(a, "changed.csv"), "x\n1\n")
    _write(os.path.join(b, "changed.csv"), "x\n2\n")
    _write(os.path.join(a, "gone.csv"), "x\n")
    got = {r.file: (r.presence, r.equal) for r in DF.file_inventory(spark, a, b).collect()}
    assert got == {"same.csv": ("in_both", True), "changed.csv": ("in_both", False), "gone.csv": ("only_in_A", None)}


def test_raw_log_round_trip_matches_direct_binding(spark):
    """Production path: raw log table on disk -> fixed-schema read -> parse -> b13."""
    from fleetlens import binding as B
    from fleetlens.plans import log_queries as LQ
    from fleetlens.sources import logs as L
    ev = B.table(spark, SF_SMALL, "events")
    path = os.path.join(tempfile.mkdtemp(prefix="fleetlens-raw-"), "raw")
    B.telemetry_logs(ev).write.parquet(path)
    parsed = L.parse_telemetry(L.read_raw_logs(spark, path))
    cap = B.capacity(spark)
    via_logs = LQ.b13_metrics(L.runs_from_telemetry(parsed), L.executor_events_from_telemetry(parsed), cap)
    direct = LQ.b13_metrics(B.runs(ev), B.executor_events(ev), cap)
    norm = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert norm(via_logs) == norm(direct)


def test_carry_boosts_and_keep_recipes(spark):
    ref = spark.createDataFrame([
        ("c", "boosted.json", {"spark.executor.memory": "12g", "spark.executor.instances": "2"}, 24, 24,
         {"appliedMemoryHeapBoostFactor": "1.5"}),
        ("c", "dropped.json", {"spark.executor.memory": "8g", "spark.executor.instances": "1"}, 8, 8, {}),
    ], CONF)
    new = spark.createDataFrame([
        ("c", "boosted.json", {"spark.executor.memory": "8g", "spark.dynamicAllocation.enabled": "true",
                               "spark.dynamicAllocation.minExecutors": "2",
                               "spark.dynamicAllocation.maxExecutors": "5"}, 16, 40, {}),
    ], CONF)
    carried = {r.recipe_filename: r for r in BO.flat_config(BO.carry_boosts(new, ref)).collect()}
    b = carried["boosted.json"]
    assert (b.executor_memory, b.total_executor_minimum_allocated_memory_gb,
            b.total_executor_maximum_allocated_memory_gb, b.appliedMemoryHeapBoostFactor) == ("12g", 24, 60, "1.5")
    dropped = spark.createDataFrame([("c", "dropped.json")], "cluster_name string, recipe_filename string")
    kept = {r.recipe_filename: r for r in BO.flat_config(BO.keep_recipes(new, ref, dropped, "2099_01_01")).collect()}
    assert set(kept) == {"boosted.json", "dropped.json"}
    assert (kept["dropped.json"].lastTunedDate, kept["dropped.json"].keptWithoutCurrentDate) == ("2099_01_01", "true")
    assert kept["boosted.json"].lastTunedDate is None


def test_evolution_keeps_stable_and_replans_degraded(spark):
    from fleetlens.plans import evolution as EV
    schema = ("cluster_name string, recipe_filename string, avg_executors_per_job double, "
              "p95_run_max_executors double, avg_job_duration_ms double, p95_job_duration_ms double, runs long, "
              "seconds_at_cap long, runs_reaching_cap long, total_runs long, fraction_reaching_cap double, "
              "max_concurrent_jobs int")
    ref = spark.createDataFrame([("keep", "k.json", 2.0, 4.0, 1e5, 1e5, 20, None, None, None, 0.0, 2),
                                 ("slow", "s.json", 6.0, 12.0, 1e5, 1e5, 20, None, None, None, 0.0, 4)], schema)
    cur = spark.createDataFrame([("keep", "k.json", 2.0, 4.0, 1e5, 1e5, 20, None, None, None, 0.0, 2),
                                 ("slow", "s.json", 6.0, 12.0, 1e5, 2e5, 20, None, None, None, 0.0, 4)], schema)
    configs = spark.createDataFrame([
        ("keep", "k.json", {"spark.executor.memory": "4g", "spark.executor.instances": "4"}, 16, 16, {}),
        ("slow", "s.json", {"spark.executor.memory": "4g", "spark.executor.instances": "12"}, 48, 48, {}),
    ], CONF)
    sig = "job_id string, cluster_name string, recipe_filename string, latest_driver_log_ts string"
    cur_oom = spark.createDataFrame([("j", "keep", "k.json", "2099-01-02")], sig)
    ref_oom = spark.createDataFrame([], sig)
    out = {r.recipe_filename: r for r in EV.evolve_configs(ref, cur, configs, cur_oom, ref_oom, None,
                                                            "2099_01_01").collect()}
    assert out["k.json"].cluster_action == "keep_as_is"
    assert out["k.json"].spark_opts["spark.executor.memory"] == "6g"          # reference 4g x 1.5 OOM boost
    assert out["s.json"].cluster_action == "boost_resources"
    assert out["s.json"].spark_opts["spark.dynamicAllocation.enabled"] == "true"   # re-planned (DA)

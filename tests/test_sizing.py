"""Sizing formulas and the golden four-cluster plan of the comparison fixture."""
import pytest
from pyspark.sql import functions as F

from fleetlens.plans import sizing as SZ

SCHEMA = ("cluster_name string, recipe_filename string, avg_executors_per_job double, p95_run_max_executors double, "
          "avg_job_duration_ms double, p95_job_duration_ms double, runs long, seconds_at_cap long, "
          "runs_reaching_cap long, total_runs long, fraction_reaching_cap double, max_concurrent_jobs int")

# re-planned clusters of the published comparison fixture (metric rows as published)
FIXTURE = [
    ("mock-cluster-show-oom", "_DQ3_OOM_RECURRING.json", 6, 12, 420000, 672000, 20, 120, 2, 20, 0.1, 4),
    ("mock-cluster-show-oom", "_DQ3_OOM_COMPANION.json", 2, 4, 60000, 90000, 50, 0, 0, 50, 0.0, 2),
    ("mock-cluster-show-needs-execs", "_DWH_NEEDS_MORE_EXECUTORS.json", 12, 14, 12000000, 19200000, 20, 120, 2, 20, 0.1, 4),
    ("mock-cluster-show-holding", "_RDM_BOOST_HOLDING.json", 6, 12, 300000, 480000, 20, 120, 2, 20, 0.1, 4),
    ("mock-cluster-show-holding", "_RDM_DEGRADED_COMPANION.json", 6, 12, 420000, 672000, 20, 120, 2, 20, 0.1, 4),
] + [("mock-cluster-show-ctrl-3", r, 2, 4, 60000, 90000, 50, 0, 0, 50, 0.0, 2)
     for r in ["_CTRL_export_1.json", "_CTRL_export_2.json", "_CTRL_export_3.json", "_CTRL_export_4.json",
               "_CTRL_NEWCOMER.json"]]


def metrics(spark):
    rows = [tuple(float(x) if i in (2, 3, 4, 5, 10) else x for i, x in enumerate(r)) for r in FIXTURE]
    return spark.createDataFrame(rows, SCHEMA)


def test_executors_per_worker(spark):
    df = spark.createDataFrame([("e2-standard-8", 8, 32), ("n2-standard-32", 32, 128)],
                               "m string, cores int, mem int")
    got = {r.m: r.epw for r in df.select("m", SZ.executors_per_worker(
        F.col("cores"), F.col("mem"), 8, 8, 0.10, 4).alias("epw")).collect()}
    assert got == {"e2-standard-8": 1, "n2-standard-32": 4}


def test_candidates_are_the_23_shapes(spark):
    assert len(SZ.candidate_shapes()) == 23
    sc = SZ.candidate_scores(metrics(spark))
    assert sc.groupBy("cluster_name").count().filter("count <> 23").count() == 0
    assert sc.filter(F.col("workers") < 2).count() == 0


def test_golden_plan_with_topology_4cx2(spark):
    s = SZ.STRATEGIES["default"].with_topology("4cx2GBpc")
    plans = {r.cluster_name: (r.worker_machine_type, r.workers)
             for r in SZ.cluster_plans(SZ.candidate_scores(metrics(spark), s), s, order="name").collect()}
    assert plans == {
        "mock-cluster-show-needs-execs": ("e2-standard-32", 9),
        "mock-cluster-show-holding": ("n2d-standard-48", 5),
        "mock-cluster-show-oom": ("n2d-standard-48", 5),
        "mock-cluster-show-ctrl-3": ("e2-highcpu-32", 2),
    }


def test_manual_and_da_plans(spark):
    s = SZ.STRATEGIES["default"].with_topology("4cx2GBpc")
    m = metrics(spark)
    plans = SZ.cluster_plans(SZ.candidate_scores(m, s), s, order="name")
    man = {r.recipe_filename: r for r in SZ.manual_plans(plans, m, s).collect()}
    da = {r.recipe_filename: r for r in SZ.da_plans(plans, m, s).collect()}
    assert man["_DWH_NEEDS_MORE_EXECUTORS.json"].spark_executor_instances == 14
    assert da["_DQ3_OOM_COMPANION.json"].min_executors == 2
    assert all(r.spark_executor_memory_gb >= 1 for r in man.values())
    summ = SZ.generation_totals(plans).first()
    assert summ.total_predicted_nodes == 9 + 5 + 5 + 2 + 4

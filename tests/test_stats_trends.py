"""Population statistics, trend thresholds and evolution decisions."""
import pytest
from pyspark.sql import functions as F

from fleetlens.functions.stats import pearson, pop_variance
from fleetlens.plans import snapshots as SN
from fleetlens.plans import statistics as ST

METRIC_SCHEMA = ("cluster_name string, recipe_filename string, avg_executors_per_job double, "
                 "p95_run_max_executors double, avg_job_duration_ms double, p95_job_duration_ms double, "
                 "runs long, seconds_at_cap long, runs_reaching_cap long, total_runs long, "
                 "fraction_reaching_cap double, max_concurrent_jobs int")


def metrics(spark, rows):
    full = [(c, r, a, p, d, p95, n, None, None, None, f, 1) for c, r, a, p, d, p95, n, f in rows]
    return spark.createDataFrame(full, METRIC_SCHEMA)


def test_population_variance(spark):
    df = spark.createDataFrame([(2.0,), (4.0,), (6.0,)], "x double")
    assert df.agg(pop_variance("x")).first()[0] == pytest.approx(2.6667, abs=1e-4)
    one = spark.createDataFrame([(2.0,)], "x double")
    assert one.agg(pop_variance("x")).first()[0] == 0.0


def test_pearson_sign_and_zero_sigma(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0)], "x double, y double, c double")
    r = df.agg(pearson(F.covar_pop("x", "y"), F.stddev_pop("x"), F.stddev_pop("y")).alias("r"),
               pearson(F.covar_pop("x", "c"), F.stddev_pop("x"), F.stddev_pop("c")).alias("z")).first()
    assert r.r == pytest.approx(1.0) and r.z == 0.0


def _trend(spark, ref, cur):
    a = metrics(spark, [("c", "r", 1.0, 1.0, 100.0, ref[0], 10, ref[1])])
    b = metrics(spark, [("c", "r", 1.0, 1.0, 100.0, cur[0], 10, cur[1])])
    return SN.trend_class(SN.pair_snapshots(a, b)).first().trend


def test_trend_thresholds(spark):
    assert _trend(spark, (100.0, 0.0), (111.0, 0.0)) == "degraded"      # p95 > +10 %
    assert _trend(spark, (100.0, 0.0), (110.0, 0.0)) == "stable"        # exactly +10 % is not
    assert _trend(spark, (100.0, 0.2), (100.0, 0.5)) == "degraded"      # cap > +15 % and cur > 0
    assert _trend(spark, (100.0, 0.0), (94.0, 0.0)) == "improved"       # p95 < -5 %
    assert _trend(spark, (100.0, 0.2), (94.0, 0.3)) == "degraded"       # cap worsened beats improvement
    assert _trend(spark, (0.0, 0.0), (0.0, 0.0)) == "stable"            # 0 -> 0 = 0 %


def test_new_dropped_and_decisions(spark):
    ref = metrics(spark, [("c", "a", 1.0, 1.0, 100.0, 100.0, 3, None),
                          ("c", "gone", 1.0, 1.0, 100.0, 100.0, 3, None)])
    cur = metrics(spark, [("c", "a", 1.0, 1.0, 100.0, 150.0, 12, None),
                          ("c", "fresh", 1.0, 1.0, 100.0, 100.0, 3, None)])
    t = SN.trend_class(SN.pair_snapshots(ref, cur))
    d = {r.recipe_filename: r for r in SN.evolution_decisions(t).collect()}
    assert d["a"].action == "boost_resources"
    assert d["a"].reason == "Performance degraded: p95_job_duration_ms changed 50.0%. Re-planning with current metrics."
    assert d["a"].confidence == pytest.approx(0.3)
    assert d["fresh"].trend == "new_entry" and d["fresh"].action == "generate_fresh"
    assert d["gone"].trend == "dropped_entry" and d["gone"].action == "preserve_historical"
    act = SN.cluster_actions(SN.evolution_decisions(t)).first().cluster_action
    assert act == "boost_resources"
    roll = SN.cluster_trend_rollup(t).first().overall_trend
    assert roll == "degraded"


def test_zscore_one_outlier_of_fifteen(spark):
    ref = metrics(spark, [("c", f"r{i}", 1.0, 1.0, 100.0, 100.0, 10, 0.0) for i in range(15)])
    cur = metrics(spark, [("c", f"r{i}", 1.0, 1.0, 100.0, 100.0 + (1000.0 if i == 0 else 0.0), 10, 0.0)
                          for i in range(15)])
    z = ST.zscore_delta(SN.pair_snapshots(ref, cur)).collect()
    assert len(z) == 1 and z[0].recipe_filename == "r0"
    assert z[0].metric_name == "delta_p95_job_duration_ms"
    assert z[0].z_score == pytest.approx(14 ** 0.5, abs=1e-4)

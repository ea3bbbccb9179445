"""Snapshot store, stored raw log, boost chains, documents that keep their order, content diffs."""

import json

from pyspark.sql import functions as F

from conftest import SF_SMALL
from fleetlens import binding as B
from fleetlens import registry_documents as RD
from fleetlens.operators.scan import bucketed_lead
from fleetlens.plans import boosts as BO
from fleetlens.plans import documents as DO
from fleetlens.sources import logs as L
from fleetlens.sources import store as SS


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_a_date_is_written_once_and_absent_tables_are_empty(spark, tmp_path):
    folder, made = str(tmp_path), []

    def make(n):
        def build():
            made.append(n)
            return spark.range(n).withColumn("x", F.lit(str(n)))
        return build

    for n in (3, 5):  # the second finds the first's rows
        SS.write_once(spark, folder, "metrics", "2024-01-01", make(n))
    SS.write_once(spark, folder, "metrics", "2024-01-08", make(7))
    assert made == [3, 7]
    every = SS.every_date(spark, folder, "metrics")
    assert {r.snapshot_date: r.n for r in every.groupBy("snapshot_date").agg(F.count("*").alias("n")).collect()} == {"2024-01-01": 3, "2024-01-08": 7}
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan_of(every.where("snapshot_date = '2024-01-08'"))
    got = SS.load_snapshot(spark, folder, "2024-01-08", {"metrics": "id long, x string", "spans": "cluster_name string, idx int"})
    assert got["metrics"].count() == 7 and got["spans"].count() == 0 and got["spans"].columns == ["cluster_name", "idx"]
    assert SS.load_snapshot(spark, folder, "1999-01-01", {"metrics": "id long"})["metrics"].count() == 0
    assert SS.runs_index(spark, folder).count() == 0


def test_runs_index_is_newest_first(spark):
    rows = RD.runs_index(spark, SF_SMALL).collect()
    assert [r.current_date for r in rows] == sorted((r.current_date for r in rows), reverse=True) and len(rows) >= 3
    again = RD.weekly_store(spark, SF_SMALL)[0]
    assert SS.runs_index(spark, again).count() == len(rows)


def test_stored_logs_read_only_the_dates_and_types_asked_for(spark, tmp_path):
    logs = RD.raw_log_store(spark, SF_SMALL)
    plan = plan_of(L.scan(logs.where("date = date'2024-01-05'"), resource_type=L.RT_JOB).select("insert_id"))
    assert "PartitionFilters: [" in plan and "date#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    days = [(f"2024-01-{d:02d}", "rerun" if d == 5 else "done") for d in range(1, 31)]
    spark.createDataFrame(days, "day string, state string").select(F.to_date("day").alias("date"), "state").write.parquet(str(tmp_path / "days"))
    joined = L.of_dates(logs, spark.read.parquet(str(tmp_path / "days")).where("state = 'rerun'")).select("insert_id")
    assert "dynamicpruning" in plan_of(joined).lower()
    assert joined.count() == B.raw_logs(B.table(spark, SF_SMALL, "events")).where("to_date(timestamp) = date'2024-01-05'").count()


def test_lead_moves_the_rows_once(spark):
    rows = spark.createDataFrame([(k % 3, (k * 7) % 11, k, k * 10) for k in range(200)], "p long, b long, o long, v long").withColumn("o", F.col("b") * 1000 + F.col("o"))
    got = bucketed_lead(rows, ["p"], "b", ["o"], "v", "n")
    from pyspark.sql import Window
    want = rows.withColumn("n", F.lead("v").over(Window.partitionBy("p").orderBy("o")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in final and final.count("hashpartitioning(p") - final.split("== Initial Plan ==")[-1].count("hashpartitioning(p") <= 3


def test_chain_equals_runs_one_after_another(spark):
    configs = spark.createDataFrame(
        [("c", f"r{k}", {BO.MEMORY_KEY: f"{4 + k}g"} if k else {}, 1, 1, {BO.HEAP_TAG: "1.5"} if k % 3 == 0 else {}) for k in range(6)], BO.CONFIG_SCHEMA)
    dates = [f"d{k}" for k in range(5)]
    signals = spark.createDataFrame([("c", f"r{k}", d) for k in range(6) for i, d in enumerate(dates) if (k * 5 + i * 3) % 4 == 0] + [("c", "r1", "other"), ("c", "gone", "d1")],
                                    "cluster_name string, recipe_filename string, snapshot_date string")
    want, now = [], configs
    for d in dates:
        own = signals.where(F.col("snapshot_date") == d)
        state = BO.heap_boost_state(now, own, own)
        want += [(r.recipe_filename, d, r.state, int(r.original_memory[:-1]), int(r.boosted_memory[:-1]), r.cumulative_factor) for r in state.collect()]
        now = spark.createDataFrame(BO.apply_heap_boosts(now, state).collect(), BO.CONFIG_SCHEMA)
    got = [tuple(r)[1:] for r in BO.heap_boost_chain(configs, signals, dates).collect()]
    assert sorted(got) == sorted(want) and {x[2] for x in got} == {"new", "re-boost", "holding"}


DOC = {"clusterConf": {"c-1": {"num_workers": 4, "z_field": "text", "a_field": 1.5, "boostedMemoryHeapJobCount": 9, "boostedMemoryHeapJobList": ["old"]}},
       "recipeSparkConf": {
           "_z.json": {"parallelizationFactor": 7, "sparkOptsMap": {"spark.executor.memory": "8g", "my.option": "1", "spark.executor.instances": "3", "a.option": "2"},
                       "total_executor_minimum_allocated_memory_gb": 24, "total_executor_maximum_allocated_memory_gb": 24},
           "_a.json": {"sparkOptsMap": {"spark.executor.memory": "10g"}, "total_executor_minimum_allocated_memory_gb": 10, "total_executor_maximum_allocated_memory_gb": 10,
                       "appliedMemoryHeapBoostFactor": 1.5}}}


def docs_of(spark, *docs):
    return spark.createDataFrame([(f"f{i}", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "file_name string, value string")


def test_rewritten_documents_keep_their_order(spark):
    docs = docs_of(spark, DOC, "{broken", "{}", {"clusterConf": {"c-2": {"num_workers": 1}}, "recipeSparkConf": {}})
    boosts = spark.createDataFrame([("c-1", "_z.json", "8g", "12g", 1.5, 1.5, "new")],
                                   "cluster_name string, recipe_filename string, original_memory string, boosted_memory string, boost_factor double, cumulative_factor double, state string")
    got = {r.file_name: json.loads(r.value) for r in DO.rewrite_documents(docs, boosts).collect()}
    assert set(got) == {"f0", "f3"}
    cluster = got["f0"]["clusterConf"]["c-1"]
    assert list(cluster.items()) == [("num_workers", 4), ("z_field", "text"), ("a_field", 1.5), ("boostedMemoryHeapJobCount", 1), ("boostedMemoryHeapJobList", ["_z.json"])]
    recipes = got["f0"]["recipeSparkConf"]
    assert list(recipes) == ["_z.json", "_a.json"]
    assert list(recipes["_z.json"]["sparkOptsMap"].items()) == [("spark.executor.instances", "3"), ("spark.executor.memory", "12g"), ("my.option", "1"), ("a.option", "2")]
    assert recipes["_z.json"]["parallelizationFactor"] == 7 and recipes["_z.json"]["total_executor_maximum_allocated_memory_gb"] == 36
    assert recipes["_z.json"]["appliedMemoryHeapBoostFactor"] == 1.5 and recipes["_a.json"]["appliedMemoryHeapBoostFactor"] == 1.5
    assert recipes["_a.json"]["sparkOptsMap"] == {"spark.executor.memory": "10g"} and recipes["_a.json"]["parallelizationFactor"] == 5


def test_content_and_path_diff(spark):
    turned = {"recipeSparkConf": dict(reversed(DOC["recipeSparkConf"].items())), "clusterConf": {"c-1": dict(reversed(DOC["clusterConf"]["c-1"].items()))}}
    other, fields = json.loads(json.dumps(DOC)), json.loads(json.dumps(DOC))
    other["recipeSparkConf"]["_a.json"]["sparkOptsMap"]["new"] = "x"
    other["clusterConf"]["c-1"]["boostedMemoryHeapJobList"] = ["old", "more"]
    fields["clusterConf"]["c-1"]["num_workers"] = 5
    del fields["recipeSparkConf"]["_a.json"]
    a, b = docs_of(spark, DOC, DOC, DOC, DOC), docs_of(spark, DOC, turned, other, fields)
    assert sorted(map(tuple, DO.content_diff(a, b).collect())) == [("f2", "content_other", "differs", "differs"), ("f3", "num_workers", "4", "5"), ("f3", "recipe_count", "2", "1")]
    paths = {(r.file_name, r.path): (r.value_A, r.value_B) for r in DO.path_diff(a, b).collect()}
    assert paths[("f2", "$.recipeSparkConf._a.json.sparkOptsMap.new")] == (None, '"x"')
    assert paths[("f2", "$.clusterConf.c-1.boostedMemoryHeapJobList[1]")] == (None, '"more"')
    assert paths[("f3", "$.clusterConf.c-1.num_workers")] == ("4", "5")
    assert {f for f, _ in paths} == {"f2", "f3"} and len([p for f, p in paths if f == "f2"]) == 2


def test_analysis_documents_in_parts(spark):
    from fleetlens import registry as R
    from fleetlens.plans import snapshots as SN
    ref, cur = R.snapshot_metrics(spark, SF_SMALL)
    pairs = SN.pair_snapshots(ref, cur)
    trends = SN.trend_class(pairs)
    args = (pairs, trends, SN.evolution_decisions(trends), SN.cluster_trend_rollup(trends))
    whole, parts = DO.analysis_documents(*args), DO.analysis_documents(*args, recipes_per_document=1)
    fields = lambda d: sorted(map(str, DO.analysis_fields(d).drop("part", "recipe_pos").collect()))
    assert fields(whole) == fields(parts) and parts.count() > whole.count()
    doc = json.loads(DO.analysis_json(whole).first().value)
    names = [r["recipe"] for r in doc["recipes"]]
    assert names == sorted(names) and {"recipe", "trend", "confidence", "action", "reason", "deltas"} <= set(doc["recipes"][0])


def test_cost_timeline_documents(spark):
    from fleetlens import registry as R
    from fleetlens.plans import cost as CO
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spans, events = R.fleet_spans_events(spark, SF_SMALL)
    every = CO.with_synthetic(spans, events)
    segments = CO.span_segments(every, events)
    whole, parts = (CO.cost_timeline_documents(every, segments, events, per_document=n) for n in (1000, 2))
    assert parts.count() > whole.count() == every.select("cluster_name").distinct().count()
    total = {r.cluster_name: r.estimated_cost_eur for r in CO.cluster_cost(every, segments).collect()}
    docs = {r.cluster_name: json.loads(r.cost_timeline) for r in CO.cost_timeline_json(whole).collect()}
    assert any(d["has_synthetic_span"] for d in docs.values()) and not all(d["has_synthetic_span"] for d in docs.values())
    for name, d in docs.items():
        assert abs(d["total_cost_eur"] - total[name]) < 1e-4 and d["worker_machine_type"] == "e2-standard-8"
        assert [i["idx"] for i in d["incarnations"]] == sorted(i["idx"] for i in d["incarnations"])
        assert all({"synthetic_span", "events_count", "intervals"} <= set(i) for i in d["incarnations"])
        for i in d["incarnations"]:
            assert abs(sum(s["seg_cost_eur"] for s in i["intervals"]) - i["total_cost_eur"]) < 0.001 * (1 + len(i["intervals"]))

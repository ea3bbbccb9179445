"""Registered queries over the snapshot store, the stored raw log, boost chains and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import binding as B
from . import registry as R
from .plans import boosts as BO
from .plans import cost as CO
from .plans import diagnostics as DG
from .plans import documents as DO
from .plans import evolution as EV
from .plans import integrity as IG
from .plans import log_queries as LQ
from .plans import sizing as SZ
from .plans import snapshots as SN
from .plans import statistics as ST
from .session import cut_lineage, deal_by
from .sources import logs as L
from .sources import sinks as SK
from .sources import store as SS


# --- S12 / K7: one snapshot per week -----------------------------------------------------------------

def weeks_of(events: DataFrame) -> list[str]:
    """Mondays of the weeks that have an event (a value per week)."""
    return sorted(r[0] for r in events.select(_week("ts").alias("week")).distinct().collect() if r[0] is not None)


def _week(ts: str) -> Column:
    return F.date_format(F.date_trunc("week", F.col(ts).cast("timestamp")), "yyyy-MM-dd")


def events_of_week(spark: SparkSession, folder: str, events: DataFrame, week: str) -> DataFrame:
    """One week's events from a copy of them that is dealt by weeks (written once), so that no week reads the others'."""
    path = SS.write_once(spark, folder, "events", "all", lambda: events.withColumn("week", _week("ts")).hint("rebalance", "week"), ("week",))
    return spark.read.schema(T.StructType([*events.schema.fields, T.StructField("week", T.StringType())])).parquet(path).where(F.col("week") == week).drop("week")


def weekly_store(spark: SparkSession, sf_dir: str) -> tuple[str, list[str]]:
    """The b13 table of every week, each written once, and the metadata of each comparison of two weeks."""
    folder = SS.folder_of_input(spark, "weekly", f"{sf_dir}/events*.parquet")
    ev = B.table(spark, sf_dir, "events")
    weeks, cap = weeks_of(ev), B.capacity(spark)

    def metrics(week: str):
        def make() -> DataFrame:
            own = events_of_week(spark, folder, ev, week)
            return LQ.b13_metrics(B.runs(own), B.executor_events(own), cap)
        return make

    for week in weeks:
        SS.write_once(spark, folder, "metrics", week, metrics(week))

    def run(before: str, now: str):
        def make() -> DataFrame:
            schema = {"metrics": spark.read.parquet(f"{folder}/metrics").drop(SS.DATE).schema}
            ref, cur = (SS.load_snapshot(spark, folder, d, schema)["metrics"] for d in (before, now))
            return SS.run_metadata(SN.trend_class(SN.pair_snapshots(ref, cur)), f"{before}_{now}", before, now)
        return make

    for before, now in zip(weeks, weeks[1:]):
        SS.write_once(spark, folder, "runs", now, run(before, now))
    return folder, weeks


def snapshot_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SS.every_date(spark, weekly_store(spark, sf_dir)[0], "metrics")


def runs_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SS.runs_index(spark, weekly_store(spark, sf_dir)[0])


# --- S1: the raw log as a stored table -------------------------------------------------------------------

def _raw_log_folder(spark: SparkSession, sf_dir: str) -> str:
    return SS.folder_of_input(spark, "raw-log", f"{sf_dir}/events*.parquet")


def raw_log_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound raw log, written once by date and resource type."""
    folder = _raw_log_folder(spark, sf_dir)
    path = SS.write_once(spark, folder, "logs", "all", lambda: L.with_partitions(B.raw_logs(B.table(spark, sf_dir, "events"))), L.PARTITIONS)
    return L.read_stored_logs(spark, path)


def _stored_b13(spark: SparkSession, sf_dir: str) -> DataFrame:
    # b13 reads runs and events in many branches: the messages are decoded once
    parsed = SS.stored(spark, _raw_log_folder(spark, sf_dir), "telemetry", "all", lambda: L.parse_telemetry(raw_log_store(spark, sf_dir)))
    return LQ.b13_metrics(L.runs_from_telemetry(parsed), L.executor_events_from_telemetry(parsed), B.capacity(spark))


# --- D7, D8, W8, K9, O4 ------------------------------------------------------------------------------------

def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly boost runs over the deployed configs, of which every sixth user's are tagged before the first week."""
    weeks = weeks_of(B.table(spark, sf_dir, "events"))
    ref, _ = R.snapshot_metrics(spark, sf_dir)
    user = F.regexp_extract("recipe_filename", r"_RECIPE_(\d+)", 1).cast("long")
    configs = B.deployed_configs(ref, ref.where(user % 6 == 0))
    signals = R.all_oom_signals(spark, sf_dir).where("recipe_filename is not null")
    week = F.date_format(F.date_trunc("week", "latest_driver_log_ts"), "yyyy-MM-dd")
    return BO.heap_boost_chain(configs, signals.select(*BO.KEYS, week.alias("snapshot_date")), weeks)


def single(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs, cur, _, _, _ = R.boost_inputs(spark, sf_dir)
    return BO.heap_boost_single(configs, cur.where("recipe_filename is not null"))


def prioritised(spark: SparkSession, sf_dir: str) -> DataFrame:
    cur, ref = R.oom_signals(spark, sf_dir)
    return BO.prioritised_signals(cur, ref)


def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals that a fleet without the recipes of every other user can't place."""
    configs, cur, ref, _, _ = R.boost_inputs(spark, sf_dir)
    user = F.regexp_extract("recipe_filename", r"_RECIPE_(\d+)", 1).cast("long")
    signals = cur.unionByName(ref).withColumn("recipe_filename", F.when(user % 2 == 1, F.col("recipe_filename")))
    return BO.unresolved_signals(BO.resolve_signals(signals, configs.where(user % 2 == 1)), "memory_heap", "b16_oom_job_driver_exceptions.csv")


def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = R.snapshot_metrics(spark, sf_dir)
    return ST.divergences_report(ST.zscore_delta(SN.pair_snapshots(ref, cur)))


# --- K6, K10, G3: documents ------------------------------------------------------------------------------------

def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, cur = R.snapshot_metrics(spark, sf_dir)
    pairs = cut_lineage(SN.pair_snapshots(ref, cur))
    trends = SN.trend_class(pairs)
    return DO.analysis_fields(DO.analysis_documents(pairs, trends, SN.evolution_decisions(trends), SN.cluster_trend_rollup(trends)))


def _reversed_options(configs: DataFrame) -> DataFrame:
    return configs.withColumn("spark_opts", F.map_from_entries(F.reverse(F.map_entries("spark_opts"))))


def _positions(configs: DataFrame) -> DataFrame:
    """Recipes against the order of their names (a place per recipe of the cluster, from the name's characters)."""
    user = F.regexp_extract("recipe_filename", r"_RECIPE_(\d+)", 1).cast("long")
    return configs.withColumn("position", -user)


def _fleet_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cluster configs of the fleet plan, deployed recipe configs, their heap boosts."""
    configs, cur, ref, _, _ = R.boost_inputs(spark, sf_dir)
    m, plans = R.fleet_plans(spark, sf_dir)
    conf = cut_lineage(SZ.cluster_config(plans, SZ.manual_plans(plans, m)))
    return conf, configs, cut_lineage(BO.heap_boost_state(configs, cur.unionByName(ref), cur))


def boosted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read, boosted, written and read again: a row per recipe with its place, options and totals."""
    conf, configs, boosts = _fleet_documents(spark, sf_dir)
    docs = cut_lineage(SK.config_documents(conf, _positions(_reversed_options(configs))))
    # written once: the clusters and the recipes are both read from it
    clusters, recipes = DO.parse_documents(cut_lineage(DO.rewrite_documents(docs, boosts)))
    recipes = deal_by(recipes, "file_name", "recipe_filename")  # each row gets its file's whole list, so rows are dealt first
    count, names = BO.HEAP_COUNTERS
    counters = clusters.select("file_name", F.try_element_at("fields", F.lit(count)).cast("int").alias("boosted_count"),
                               F.array_join(F.try_element_at("fields", F.lit(names)).cast("array<string>"), ";").alias("boosted_list"),
                               F.array_join(F.map_keys("fields"), ";").alias("field_order"))
    options = F.array_join(F.transform(F.map_entries("conf.sparkOptsMap"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return recipes.join(counters, "file_name").select(
        "cluster_name", "position", "recipe_filename", options.alias("options"),
        F.col("conf.total_executor_minimum_allocated_memory_gb").alias("min_gb"), F.col("conf.total_executor_maximum_allocated_memory_gb").alias("max_gb"),
        F.col("conf")[BO.HEAP_TAG].alias("factor"), "boosted_count", "boosted_list", "field_order")


def _two_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents before and after a run that gave every third cluster a worker more and boosted every third; all in another order."""
    conf, configs, boosts = _fleet_documents(spark, sf_dir)
    third = F.regexp_extract("cluster_name", r"(\d+)$", 1).cast("int") % 3
    boosted = BO.apply_heap_boosts(configs, boosts)
    after = boosted.where(third == 2).unionByName(configs.where(third != 2))
    a = SK.config_documents(conf, configs)
    b = SK.config_documents(conf.withColumn("num_workers", F.col("num_workers") + F.when(third == 1, 1).otherwise(0)), _positions(_reversed_options(after)))
    return cut_lineage(a.select("file_name", "value")), cut_lineage(b.select("file_name", "value"))


# --- D14, N6 --------------------------------------------------------------------------------------------------------

def evolved_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs, cur, ref, ref_m, cur_m = R.boost_inputs(spark, sf_dir)
    out, heap, scale = EV.evolve(ref_m, cur_m, configs, cur, ref, ST.scale_signals(cur_m, ref_m), R.REFERENCE_DATE,
                                 reference_scale=ST.scale_signals(ref_m, cur_m))
    exits = cut_lineage(R.exit_code_table(spark, sf_dir))
    now, before = (DG.exit_signals(exits.where(x)) for x in (B.is_current("_ts"), ~B.is_current("_ts")))
    promotions = DG.master_promotions(spark, now, before, B.cluster_masters(exits.where(B.is_current("_ts")), exits.where(~B.is_current("_ts"))))
    spans, segments = (cut_lineage(B.at_home(x)) for x in R.spans_and_segments(spark, sf_dir))
    return EV.evolved_clusters(cut_lineage(out), heap, scale, promotions, DG.driver_overrides(now), CO.cluster_cost(spans, segments))


def cost_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested cost timeline, opened again: a row per interval with the header, the incarnation and the interval's place."""
    spans, events = R.fleet_spans_events(spark, sf_dir)
    every = CO.with_synthetic(spans, events)
    doc = CO.cost_timeline_documents(every, CO.span_segments(every, events), events)
    inc = doc.select("cluster_name", "worker_machine_type", "worker_hourly_eur", "real_used_avg_num_of_workers", "real_used_min_workers",
                     "real_used_max_workers", "total_cost_eur", "has_synthetic_span", F.posexplode("incarnations").alias("incarnation_pos", "i"))
    flat = inc.select("*", F.col("i.idx").alias("idx"), F.col("i.span_minutes").alias("span_minutes"), F.col("i.total_cost_eur").alias("span_cost_eur"),
                      F.col("i.synthetic_span").alias("synthetic_span"), F.col("i.events_count").alias("events_count"),
                      F.posexplode("i.intervals").alias("interval_pos", "s")).drop("i")
    return flat.select("*", "s.*").drop("s")


# --- G7, K8 ---------------------------------------------------------------------------------------------------------

def config_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all events against the configs of the reference window, of which every ninth user's is there twice."""
    configs = R.boost_inputs(spark, sf_dir)[0]
    user = F.regexp_extract("recipe_filename", r"_RECIPE_(\d+)", 1).cast("long")
    return IG.config_violations(configs.unionByName(configs.where(user % 9 == 0)), B.runs(B.table(spark, sf_dir, "events")))


def boost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8 with its boost section."""
    configs, cur, ref, ref_m, cur_m = R.boost_inputs(spark, sf_dir)
    decisions = SN.evolution_decisions(SN.trend_class(SN.pair_snapshots(ref_m, cur_m)))
    return SK.run_summary(decisions, BO.heap_boost_state(configs, cur.unionByName(ref), cur))


def queries() -> dict[str, R.Query]:
    return {
        "snapshot_store": snapshot_store,
        "runs_index": runs_index,
        "stored_b13_metrics": _stored_b13,
        "stored_b14_nonzero_exits": lambda s, d: LQ.b14_nonzero_exits(raw_log_store(s, d)),
        "stored_b20_incarnations": lambda s, d: LQ.b20_incarnations(raw_log_store(s, d).where(
            F.col("log_name").isin(L.AUDIT_LOG, L.CLUSTER_LOG) & L.label("cluster_name").startswith("fleet-"))),
        "evolved_clusters": evolved_clusters,
        "cost_documents": cost_documents,
        "config_integrity": config_integrity,
        "run_summary_boosts": boost_summary,
        "heap_boost_chain": chain,
        "heap_boost_single": single,
        "prioritised_signals": prioritised,
        "unresolved_signals": unresolved,
        "divergence_report": divergences,
        "analysis_document": analysis,
        "boosted_documents": boosted_documents,
        "content_diff": lambda s, d: DO.content_diff(*_two_versions(s, d)),
        "path_diff": lambda s, d: DO.path_diff(*_two_versions(s, d)),
    }

"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (through ``fleetlens.binding``) in full.
Double columns are rounded to 6 places (summation order differs between
engines; the oracle rounds the same way).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import binding as B
from .plans import log_queries as LQ
from .plans import cost as CO
from .operators import diff as DF
from .plans import boosts as BO
from .sources import inputs as IN
from .streaming import eventlog as EL
from .streaming import incremental as INC
from .streaming import online as ON
from .plans import diagnostics as DG
from .plans import integrity as IG
from .plans import sizing as SZ
from .plans import snapshots as SN
from .plans import statistics as ST
from .session import cut_lineage, new_folder
from .sources import event_log as EVL
from .sources import logs as L
from .sources import store as SS

Query = Callable[[SparkSession, str], DataFrame]


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "events")


def _runs_events(spark: SparkSession, sf_dir: str):
    ev = _events(spark, sf_dir)
    return B.runs(ev), B.executor_events(ev)


def _q(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # driver tables carry zone-less timestamps; the binding reads them as UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return round_doubles(fn(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _log_queries() -> dict[str, Query]:
    def with_runs(f, cap=False):
        def q(spark, sf_dir):
            r, e = _runs_events(spark, sf_dir)
            return f(r, e, B.capacity(spark)) if cap else f(r, e)
        return q

    def runs_only(f):
        return lambda spark, sf_dir: f(B.runs(_events(spark, sf_dir)))

    def logs_of(f, *builders):
        def q(spark, sf_dir):
            ev = _events(spark, sf_dir)
            parts = [b(ev) for b in builders]
            logs = parts[0]
            for p in parts[1:]:
                logs = logs.unionByName(p)
            return f(logs)
        return q

    return {
        "telemetry_parse": lambda s, d: L.parse_telemetry(B.telemetry_logs(_events(s, d))),
        "b1_avg_executors": with_runs(LQ.b1_avg_executors),
        "b2_peak_executors": lambda s, d: LQ.b2_peak_executors(B.executor_events(_events(s, d))),
        "b3_avg_duration": runs_only(LQ.b3_avg_duration),
        "b4_peak_duration": runs_only(LQ.b4_peak_duration),
        "b5_runs_reaching_cap": with_runs(LQ.b5_runs_reaching_cap, cap=True),
        "b6_total_jobs": runs_only(LQ.b6_total_jobs),
        "b7_total_runtime": runs_only(LQ.b7_total_runtime),
        "b8_p95_duration": runs_only(LQ.b8_p95_duration),
        "b9_seconds_at_cap": with_runs(LQ.b9_seconds_at_cap, cap=True),
        "b10_executor_churn": with_runs(LQ.b10_executor_churn),
        "b11_max_concurrent": runs_only(LQ.b11_max_concurrent),
        "b12_p95_max_executors": with_runs(LQ.b12_p95_max_executors),
        "b13_metrics": with_runs(LQ.b13_metrics, cap=True),
        "b14_nonzero_exits": logs_of(LQ.b14_nonzero_exits, B.exit_code_logs),
        "b15_latest_status": logs_of(LQ.b15_latest_status, B.telemetry_logs, B.status_logs),
        "b16_oom_latest": logs_of(LQ.b16_oom_latest, B.driver_logs, B.telemetry_logs),
        "b20_incarnations": logs_of(LQ.b20_incarnations, B.audit_logs),
        "b21_recommendations": logs_of(LQ.b21_recommendations, B.autoscaler_logs),
    }


def snapshot_metrics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """b13 metric tables of the reference and current comparison windows, from the snapshot store (written once)."""
    ev, cap = _events(spark, sf_dir), B.capacity(spark)
    folder = _store(spark, sf_dir)

    def one(which: str) -> DataFrame:
        def make() -> DataFrame:
            e = B.snapshot_events(ev, which)
            return LQ.b13_metrics(B.runs(e), B.executor_events(e), cap)
        return SS.stored(spark, folder, "metrics", which, make)

    return one("reference"), one("current")


def _store(spark: SparkSession, sf_dir: str) -> str:
    """The snapshot store of an events table: tables that many queries read are computed once."""
    return SS.folder_of_input(spark, "snapshots", f"{sf_dir}/events*.parquet")


def _snapshot_queries() -> dict[str, Query]:
    def pairs(s, d):
        ref, cur = snapshot_metrics(s, d)
        return SN.pair_snapshots(ref, cur)

    def trends(s, d):
        return SN.trend_class(pairs(s, d))

    def decisions(s, d):
        return SN.evolution_decisions(trends(s, d))

    def run_summary(s, d):
        from .sources.sinks import run_summary as summary
        return summary(decisions(s, d))

    def trend_summary(s, d):
        return SN.trend_summary(trends(s, d))

    def scatter(s, d):
        ref, cur = snapshot_metrics(s, d)
        return ST.scatter_points(SN.pair_snapshots(ref, cur), cur, ref)

    def with_ref_cur(f):
        def q(s, d):
            ref, cur = snapshot_metrics(s, d)
            return f(cur, ref)
        return q

    metric_cols = [c for m in SN.METRICS for c in (f"ref_{m}", f"cur_{m}")]
    return {
        "snapshot_pairing": lambda s, d: pairs(s, d).select(*SN.KEYS, "status", *metric_cols),
        "metric_deltas": lambda s, d: SN.metric_deltas(pairs(s, d)),
        "trend_class": lambda s, d: trends(s, d).select(*SN.KEYS, "trend", "confidence",
                                                         "p95_pct_change", "cap_pct_change"),
        "evolution_decisions": decisions,
        "cluster_trend_rollup": lambda s, d: SN.cluster_trend_rollup(trends(s, d)),
        "cluster_actions": lambda s, d: SN.cluster_actions(decisions(s, d)),
        "trend_counts": lambda s, d: SN.trend_counts(trends(s, d)),
        "run_summary": run_summary,
        "active_minutes": lambda s, d: SN.cluster_active_minutes(snapshot_metrics(s, d)[1]),
        "trend_summary": trend_summary,
        "corr_delta_fleet": lambda s, d: ST.corr_delta_fleet(pairs(s, d)),
        "corr_delta_cluster": lambda s, d: ST.corr_delta_cluster(pairs(s, d)),
        "corr_current": with_ref_cur(ST.corr_current),
        "zscore_delta": lambda s, d: ST.zscore_delta(pairs(s, d)),
        "zscore_cluster": lambda s, d: ST.zscore_cluster(pairs(s, d)),
        "zscore_current_new": with_ref_cur(ST.zscore_current),
        "scatter_points": scatter,
        "scale_signals": with_ref_cur(ST.scale_signals),
    }


ALIVE_AT = "2024-01-15 12:00:00"


def fleet_spans_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Incarnations (b20) and cost-moving autoscaler events (b21 + S8)."""
    ev = _events(spark, sf_dir)
    folder = _store(spark, sf_dir)
    return (SS.stored(spark, folder, "spans", "all", lambda: LQ.b20_incarnations(B.audit_logs(ev), ordered=False)),
            SS.stored(spark, folder, "autoscaler", "all", lambda: CO.cost_events(LQ.b21_recommendations(B.autoscaler_logs(ev), ordered=False))))


def spans_and_segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    spans, events = fleet_spans_events(spark, sf_dir)
    all_spans = CO.with_synthetic(spans, events)
    return all_spans, CO.span_segments(all_spans, events)


def _cost_queries() -> dict[str, Query]:
    def segments(s, d):
        return spans_and_segments(s, d)[1]

    def integrity(s, d):
        ev = _events(s, d)
        spans = LQ.b20_incarnations(B.audit_logs(ev), ordered=False)
        return IG.integrity_violations(spans, LQ.b21_recommendations(B.autoscaler_logs(ev), ordered=False))

    return {
        "span_segments": segments,
        "cluster_cost": lambda s, d: CO.cluster_cost(*spans_and_segments(s, d)),
        "incarnation_cost": lambda s, d: CO.incarnation_cost(*spans_and_segments(s, d)),
        "worker_stats": lambda s, d: CO.worker_stats(segments(s, d)),
        "synthetic_spans": lambda s, d: CO.synthetic_spans(*fleet_spans_events(s, d)),
        "address_peak": lambda s, d: CO.address_peak(segments(s, d)),
        "address_timeline": lambda s, d: CO.address_timeline(segments(s, d)),
        "alive_at": lambda s, d: CO.alive_at(segments(s, d), ALIVE_AT),
        "integrity_violations": integrity,
        "cost_timeline": lambda s, d: CO.cost_timeline(*spans_and_segments(s, d)),
    }


def exit_code_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 over the b14 output of the bound cluster logs."""
    ev = _events(spark, sf_dir)
    return DG.exit_codes(LQ.b14_nonzero_exits(B.exit_code_logs(ev), ordered=False))


def _diagnostic_queries() -> dict[str, Query]:
    def signals(s, d):
        return DG.exit_signals(exit_code_table(s, d))

    def promotions(s, d):
        exits = cut_lineage(exit_code_table(s, d))
        cur, ref = exits.filter(B.is_current("_ts")), exits.filter(~B.is_current("_ts"))
        return DG.master_promotions(s, DG.exit_signals(cur), DG.exit_signals(ref), B.cluster_masters(cur, ref))

    return {
        "exit_signals": signals,
        "driver_overrides": lambda s, d: DG.driver_overrides(signals(s, d)),
        "master_promotion": promotions,
    }


def fleet_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """b13 metric table over the whole events table (the single-snapshot tuner input)."""
    ev = _events(spark, sf_dir)
    return SS.stored(spark, _store(spark, sf_dir), "metrics", "fleet", lambda: LQ.b13_metrics(B.runs(ev), B.executor_events(ev), B.capacity(spark)))


def fleet_plans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = fleet_metrics(spark, sf_dir)
    plans = cut_lineage(SZ.cluster_plans(SZ.candidate_scores(m)))
    return m, plans


def _sizing_queries() -> dict[str, Query]:
    def config(s, d):
        m, plans = fleet_plans(s, d)
        return SZ.cluster_config(plans, SZ.manual_plans(plans, m))

    def summary(s, d):
        m, plans = fleet_plans(s, d)
        spans, segments = (cut_lineage(B.at_home(x)) for x in spans_and_segments(s, d))
        region = B.table(s, d, "region")
        return SZ.summary_report(SZ.cluster_summary(
            plans, m, CO.cluster_cost(spans, segments), CO.worker_stats(segments),
            B.dag_map(region), B.timer_map(region)), "by_cost")

    return {
        "candidate_scores": lambda s, d: SZ.candidate_scores(fleet_metrics(s, d)).select(
            "cluster_name", "machine_type", "demand", "req_slots", "executors_per_worker", "workers",
            "capacity_slots", "total_cores", "core_sufficiency", "utilization", "hourly_cost", "base_score"),
        "cluster_plan": lambda s, d: fleet_plans(s, d)[1],
        "strategy_plans": lambda s, d: SZ.strategy_plans(fleet_metrics(s, d)),
        "generation_entries": lambda s, d: SZ.generation_summary(fleet_plans(s, d)[1]),
        "manual_plan": lambda s, d: SZ.manual_plans(*fleet_plans(s, d)[::-1], SZ.STRATEGIES["default"]),
        "da_plan": lambda s, d: SZ.da_plans(*fleet_plans(s, d)[::-1], SZ.STRATEGIES["default"]),
        "cluster_config": config,
        "machine_rollup": lambda s, d: SZ.machine_rollup(fleet_plans(s, d)[1]),
        "quota_usage": lambda s, d: SZ.quota_usage(fleet_plans(s, d)[1]),
        "generation_totals": lambda s, d: SZ.generation_totals(fleet_plans(s, d)[1]),
        "cluster_summary_sorted": summary,
    }


REFERENCE_DATE = "2024_01_15"


def all_oom_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir)
    return SS.stored(spark, _store(spark, sf_dir), "oom", "all", lambda: LQ.b16_oom_latest(B.driver_logs(ev).unionByName(B.telemetry_logs(ev)), ordered=False).select(
        "job_id", "cluster_name", "recipe_filename", "latest_driver_log_ts"))


def oom_signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """b16 heap-OOM signals of the current and reference windows."""
    b16 = all_oom_signals(spark, sf_dir)
    return b16.filter(B.is_current("latest_driver_log_ts")), b16.filter(~B.is_current("latest_driver_log_ts"))


def boost_inputs(spark: SparkSession, sf_dir: str):
    ref_metrics, cur_metrics = snapshot_metrics(spark, sf_dir)
    cur_sig, ref_sig = oom_signals(spark, sf_dir)
    configs = cut_lineage(B.deployed_configs(ref_metrics, ref_sig))
    return configs, cur_sig, ref_sig, ref_metrics, cur_metrics


def _boost_queries() -> dict[str, Query]:
    def heap_states(s, d):
        configs, cur, ref, _, _ = boost_inputs(s, d)
        return BO.heap_boost_state(configs, cur.unionByName(ref), cur)

    def resolution(s, d):
        configs, cur, ref, _, _ = boost_inputs(s, d)
        return BO.resolve_signals(cur.unionByName(ref), configs)

    def scale_states(s, d):
        configs, _, _, ref_m, cur_m = boost_inputs(s, d)
        now, before = (cut_lineage(BO.cap_touching(x, configs)) for x in (ST.scale_signals(cur_m, ref_m), ST.scale_signals(ref_m, cur_m)))
        return BO.scale_boost_state(B.with_scale_tags(configs, before), before.unionByName(now), now)

    def boosted(s, d):
        configs, cur, ref, _, _ = boost_inputs(s, d)
        return BO.flat_config(BO.apply_heap_boosts(configs, BO.heap_boost_state(configs, cur.unionByName(ref), cur)))

    def carried(s, d):
        configs, cur, ref, _, _ = boost_inputs(s, d)
        applied = BO.apply_heap_boosts(configs, BO.heap_boost_state(configs, cur.unionByName(ref), cur))
        m, plans = fleet_plans(s, d)
        new = BO.configs_from_manual(SZ.manual_plans(plans, m))
        out = BO.carry_boosts(new, applied)
        return BO.flat_config(out).join(out.select(*BO.KEYS, "carried"), BO.KEYS)

    def evolved(s, d):
        from .plans import evolution as EV
        configs, cur, ref, ref_m, cur_m = boost_inputs(s, d)
        out = EV.evolve_configs(ref_m, cur_m, configs, cur, ref, ST.scale_signals(cur_m, ref_m), REFERENCE_DATE,
                                reference_scale=ST.scale_signals(ref_m, cur_m))
        return BO.flat_config(out).join(out.select(*BO.KEYS, "cluster_action"), BO.KEYS)

    def kept(s, d):
        configs, _, _, ref_m, cur_m = boost_inputs(s, d)
        dropped = SN.trend_class(SN.pair_snapshots(ref_m, cur_m)).filter(F.col("trend") == SN.DROPPED_ENTRY)
        plans = SZ.cluster_plans(SZ.candidate_scores(cur_m))
        new = BO.configs_from_da(SZ.da_plans(plans, cur_m))
        out = BO.keep_recipes(new, configs, dropped, REFERENCE_DATE)
        return BO.flat_config(out).join(out.select(*BO.KEYS, "kept"), BO.KEYS)

    return {
        "signal_resolution": resolution,
        "heap_boost_state": heap_states,
        "heap_boost_counters": lambda s, d: BO.boost_counters(heap_states(s, d), "heap"),
        "scale_boost_state": scale_states,
        "boosted_configs": boosted,
        "carry_boosts": carried,
        "kept_recipes": kept,
        "evolved_configs": evolved,
    }


def perturbed_customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two copies of ``customer`` to diff: B drops one market segment, rounds the
    balance and gains the suppliers as extra keys."""
    a = B.table(spark, sf_dir, "customer")
    sup = B.table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 1_000_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"),
        F.lit("SUPPLIER").alias("c_mktsegment"))
    b = (a.filter(F.col("c_mktsegment") != "HOUSEHOLD")
         .withColumn("c_acctbal", F.round("c_acctbal", 0)).unionByName(sup))
    return a, b


def _misc_queries() -> dict[str, Query]:
    def anonymised(s, d):
        m = fleet_metrics(s, d)
        exits = exit_code_table(s, d)
        clusters, recipes = DF.anonymise_dictionary([m, exits])
        return DF.anonymise(m, clusters, recipes).select("cluster_name", "recipe_filename", "runs",
                                                         "p95_job_duration_ms")

    return {
        "table_diff": lambda s, d: DF.table_diff(*perturbed_customers(s, d), "c_custkey"),
        "diff_counts": lambda s, d: DF.diff_counts(DF.table_diff(*perturbed_customers(s, d), "c_custkey")),
        "anonymise_names": anonymised,
    }


AS_OF = "2024-02-01 00:00:00"


def _event_queries() -> dict[str, Query]:
    app = ["cluster_name", "recipe_filename"]

    def running(s, d):
        return EL.executor_running_counts(B.executor_events(_events(s, d)), app).select(
            *app, "event_id", "evt_ts", "executor_event", "current_executors", "max_executors_seen",
            "min_executors_seen")

    def lifecycle(s, d):
        ev = _events(s, d)
        return EL.app_lifecycle(B.runs(ev), LQ.status_events(B.status_logs(ev)), AS_OF)

    def logged(s, d):
        return EVL.read_event_log(s, EVL.write_event_log(B.event_log_lines(_events(s, d)), new_folder(s, "event-log")))

    def logged_counts(s, d):
        counts = EL.executor_running_counts(EVL.executor_events_of(logged(s, d)), app, tie="place")
        return counts.select(*app, F.col("executor_id").cast("long").alias("event_id"), "evt_ts", "executor_event",
                             "current_executors", "max_executors_seen", "min_executors_seen")

    def logged_lifecycle(s, d):
        log = logged(s, d)
        real, context, ends = EVL.starts_of(log)
        lived = EL.started_lifecycle(EL.reconciled_starts(real, context), ends, AS_OF)
        return lived.join(EVL.app_names(log), "app_id").drop("app_id")

    def in_parts(s, d, run, parts=3):
        """The events as files that arrive one after another, each with every parts-th event of the whole time span;
        a stream that is started anew for each file, from the state the last run left."""
        work, ev = new_folder(s, "online"), _events(s, d)
        for k in range(parts):
            ev.where(F.col("event_id") % parts == k).write.parquet(f"{work}/arrived/part={k}")
            stream = (s.readStream.schema(INC.EVENTS_SCHEMA).option("maxFileAge", "36500d").option("recursiveFileLookup", "true")
                      .option("pathGlobFilter", "*.parquet").parquet(f"{work}/arrived"))
            run(B.executor_events(stream), work)
        return work

    def online_counts(s, d):
        return ON.running_counts(s, in_parts(s, d, ON.fold_running_counts))

    def online_windows(s, d):
        return ON.window_counts(s, in_parts(s, d, ON.count_windows))

    return {
        "executor_running_counts": running,
        "app_lifecycle": lifecycle,
        "stream_counts": INC.stream_counts,
        "stream_executor_counts": INC.stream_executor_counts,
        "event_log_counts": logged_counts,
        "event_log_lifecycle": logged_lifecycle,
        "online_executor_counts": online_counts,
        "online_window_counts": online_windows,
    }


EXPECTED_COLUMNS = {  # fixed values: the driver table headers checked by input validation
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}


def _io_queries() -> dict[str, Query]:
    def merged(s, d):
        r, e = _runs_events(s, d)
        cap = B.capacity(s)
        b5 = LQ.b5_runs_reaching_cap(r, e, cap).withColumn("seconds_at_cap", F.lit(None).cast("long"))
        return IN.merge_individual(LQ.b1_avg_executors(r, e), LQ.b12_p95_max_executors(r, e), LQ.b3_avg_duration(r),
                                   LQ.b8_p95_duration(r), b5, LQ.b11_max_concurrent(r))

    def validation(s, d):
        out = None
        for name, cols in EXPECTED_COLUMNS.items():
            v = IN.validate_input(s.read.parquet(f"{d}/{name}.parquet"), name, cols)
            out = v if out is None else out.unionByName(v)
        return out

    return {
        "metrics_merge_individual": merged,
        "input_validation": validation,
    }


def queries() -> dict[str, Query]:
    from . import registry_documents
    out: dict[str, Query] = {}
    for group in (_log_queries(), _snapshot_queries(), _cost_queries(), _diagnostic_queries(),
                  _sizing_queries(), _boost_queries(), _misc_queries(), _event_queries(), _io_queries(),
                  registry_documents.queries()):
        for name, fn in group.items():
            out[name] = _q(fn)
    return out


def oracle_sql() -> dict[str, str]:
    from .checks.oracle import log_query_sql
    from .checks.oracle_cost import cost_sql
    from .checks.oracle_documents import document_sql
    from .checks.oracle_diag import diagnostics_sql
    from .checks.oracle_boosts import boost_sql
    from .checks.oracle_misc import misc_sql
    from .checks.oracle_events import events_sql
    from .checks.oracle_evolution import evolution_sql
    from .checks.oracle_fold import fold_sql
    from .checks.oracle_io import io_sql
    from .checks.oracle_sizing import sizing_sql
    from .checks.oracle_snapshots import snapshot_sql
    return {**log_query_sql(), **snapshot_sql(), **cost_sql(), **diagnostics_sql(), **sizing_sql(),
            **boost_sql(), **misc_sql(), **events_sql(), **io_sql(), **fold_sql(),
            **evolution_sql(), **document_sql()}

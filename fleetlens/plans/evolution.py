"""The two-snapshot evolution job, as one DataFrame composition.

Per cluster action (T5):
  keep / preserve  -> the reference configs, dropped recipes tagged as kept (D13);
  boost / fresh    -> a fresh plan on the current metrics (P4-P10), dropped
                      reference recipes merged in as kept (D13), prior heap
                      boosts carried into the re-planned recipes (D12);
then, for every cluster, the heap-OOM lifecycle (D7) and the executor
scale-up lifecycle (D9) are applied, heap first.  No per-cluster loop: every
step is a join / union over all clusters at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import boosts as BO
from . import sizing as SZ
from . import snapshots as SN

KEYS = ["cluster_name", "recipe_filename"]


def evolve(reference_metrics: DataFrame, current_metrics: DataFrame, reference_configs: DataFrame,
           current_oom: DataFrame, reference_oom: DataFrame, scale_signals: DataFrame | None,
           reference_date: str, strategy: SZ.Strategy = SZ.STRATEGIES["default"],
           reference_scale: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Evolved recipe configs (with their cluster's action), and the heap and scale boosts that were applied."""
    # Each step below reads the previous one in several branches; checkpoints at
    # the step boundaries keep the plans (and a retry after a lost executor) small.
    trends = cut_lineage(SN.trend_class(SN.pair_snapshots(reference_metrics, current_metrics)))
    decisions = SN.evolution_decisions(trends)
    actions = SN.cluster_actions(decisions)
    replan = actions.filter(F.col("cluster_action").isin(SN.BOOST_RESOURCES, SN.GENERATE_FRESH)).select("cluster_name")
    keep = actions.join(replan, "cluster_name", "left_anti").select("cluster_name")
    dropped = trends.filter(F.col("trend") == SN.DROPPED_ENTRY).select(*KEYS)

    # keep / preserve: reference configs with dropped recipes tagged
    kept_ref = reference_configs.join(keep, "cluster_name", "left_semi")
    kept_ref = BO.keep_recipes(kept_ref.join(dropped, KEYS, "left_anti"), kept_ref, dropped, reference_date)

    # boost / fresh: fresh plan on the current metrics of those clusters
    cur = current_metrics.join(replan, "cluster_name", "left_semi")
    plans = SZ.cluster_plans(SZ.candidate_scores(cur, strategy), strategy, order="name")
    fresh = BO.configs_from_da(SZ.da_plans(plans, cur, strategy))
    fresh = BO.carry_boosts(fresh, reference_configs).drop("carried")
    ref_of_replanned = reference_configs.join(replan, "cluster_name", "left_semi")
    fresh = BO.keep_recipes(fresh, ref_of_replanned, dropped, reference_date)

    configs = cut_lineage(kept_ref.unionByName(fresh).drop("kept"))
    all_oom = current_oom.unionByName(reference_oom)
    heap = cut_lineage(BO.heap_boost_state(configs, all_oom, current_oom))
    configs = cut_lineage(BO.apply_heap_boosts(configs, heap))
    scale = None
    if scale_signals is not None:
        now = BO.cap_touching(scale_signals, configs)
        ever = now if reference_scale is None else now.unionByName(BO.cap_touching(reference_scale, configs))
        scale = cut_lineage(BO.scale_boost_state(configs, ever, now))
        configs = BO.apply_scale_boosts(configs, scale)
    return configs.join(actions, "cluster_name", "left"), heap, scale


def evolve_configs(*args, **more) -> DataFrame:
    """The configs of ``evolve``."""
    return evolve(*args, **more)[0]


def evolved_clusters(configs: DataFrame, heap: DataFrame, scale: DataFrame | None, promotions: DataFrame, overrides: DataFrame,
                     cost: DataFrame) -> DataFrame:
    """One row per cluster of what the evolution job decides besides the recipes: action, master promotion (a promoted
    master replaces the deployed one; "holding" keeps it), driver overrides, boost counters with the recipes' names, cost."""
    def counters(boosts: DataFrame | None, names: tuple[str, str]) -> DataFrame:
        some = configs.limit(0).select(*KEYS) if boosts is None else boosts.select(*KEYS)
        return some.groupBy("cluster_name").agg(F.count_distinct("recipe_filename").alias(names[0]),
                                                F.array_join(F.array_sort(F.collect_set("recipe_filename")), ";").alias(names[1]))

    out = configs.groupBy("cluster_name").agg(F.first("cluster_action").alias("cluster_action"), F.count(F.lit(1)).alias("recipes"),
                                              F.count(BO.opt("extra", BO.KEPT_TAG)).alias("kept_recipes"))
    promoted = promotions.select("cluster_name", "promoted_master", F.col("reason").alias("promotion_reason"), F.col("state").alias("promotion_state"))
    for more in (promoted, overrides, counters(heap, BO.HEAP_COUNTERS), counters(scale, BO.SCALE_COUNTERS),
                 cost.select("cluster_name", "wall_clock_minutes", "estimated_cost_eur")):
        out = out.join(more, "cluster_name", "left")
    return out.na.fill(0, [BO.HEAP_COUNTERS[0], BO.SCALE_COUNTERS[0]])

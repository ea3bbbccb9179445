"""Cost integration over cluster incarnations.

Inputs: incarnation spans (b20 shape: cluster_name, incarnation_idx,
span_start_ts, span_end_ts, ...) and autoscaler events (b21 shape).  Workers
are a step function per incarnation; each piece is a segment with a price.

Scale: events are matched to spans with the bucketed interval join (a
long-lived cluster with very many autoscaler events is spread over its time
buckets), ``LEAD`` is the bucketed scan, and everything after that is
aggregation.  Segments are built once and reused by cost, worker statistics
and the address timeline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.interval import BUCKET, interval_join
from ..operators.scan import bucketed_lead, bucketed_running, time_bucket
from .catalog import price_of

SPAN_COLS = ["cluster_name", "incarnation_idx", "span_start_ts", "span_end_ts"]
DAY = 86400

# Address quota and its warn / critical percentages.
IP_QUOTA = 256
IP_WARN_PCT = 70
IP_CRIT_PCT = 90


def cost_events(autoscaler: DataFrame) -> DataFrame:
    """Events that move the step function -- RECOMMENDING with a target."""
    a = autoscaler.filter(
        (F.upper(F.trim("state")) == "RECOMMENDING") & F.col("target_primary_workers").isNotNull()
        & F.col("event_ts").isNotNull() & (F.trim("cluster_name") != ""))
    return a.select(F.trim("cluster_name").alias("cluster_name"), "event_ts",
                    F.col("current_primary_workers").cast("int").alias("current_primary_workers"),
                    F.col("target_primary_workers").cast("int").alias("target_primary_workers"),
                    F.coalesce(F.col("recommendation_id"), F.lit("")).alias("_tie"))


def synthetic_spans(spans: DataFrame, events: DataFrame) -> DataFrame:
    """A span [first, last event] for clusters with >= 2 events and no span."""
    g = (events.groupBy("cluster_name")
         .agg(F.count(F.lit(1)).alias("_n"), F.min("event_ts").alias("span_start_ts"),
              F.max("event_ts").alias("span_end_ts"))
         .filter((F.col("_n") >= 2) & (F.col("span_end_ts") > F.col("span_start_ts"))))
    have = spans.select("cluster_name").distinct()
    return g.join(have, "cluster_name", "left_anti").select(
        "cluster_name", F.lit(1).alias("incarnation_idx"), "span_start_ts", "span_end_ts",
        F.lit(False).alias("has_explicit_create"), F.lit(False).alias("has_explicit_delete"),
        F.lit(True).alias("synthetic"))


def with_synthetic(spans: DataFrame, events: DataFrame, synthesize: bool = True) -> DataFrame:
    """Spans plus synthetic ones (single-snapshot path only, Q15)."""
    base = spans.select(*SPAN_COLS, "has_explicit_create", "has_explicit_delete",
                        F.lit(False).alias("synthetic"))
    return base.unionByName(synthetic_spans(spans, events)) if synthesize else base


def _pricing(spans: DataFrame, pricing: DataFrame | None, worker: str, master: str,
             fallback_workers: int) -> DataFrame:
    if pricing is None:
        return spans.select("*", F.lit(price_of(worker)).alias("worker_hourly_eur"),
                            F.lit(price_of(master)).alias("master_hourly_eur"),
                            F.lit(float(fallback_workers)).alias("fallback_workers"))
    priced = spans.join(pricing.select("cluster_name", "worker_hourly_eur", "master_hourly_eur",
                                       F.col("fallback_workers").cast("double").alias("fallback_workers")),
                        "cluster_name", "left")
    # a cluster without a pricing row has the default shapes, not a cost of nothing
    return priced.withColumns({"worker_hourly_eur": F.coalesce("worker_hourly_eur", F.lit(price_of(worker))),
                               "master_hourly_eur": F.coalesce("master_hourly_eur", F.lit(price_of(master))),
                               "fallback_workers": F.coalesce("fallback_workers", F.lit(float(fallback_workers)))})


def span_segments(spans: DataFrame, events: DataFrame, pricing: DataFrame | None = None,
                  worker: str = "e2-standard-8", master: str = "e2-standard-8",
                  fallback_workers: int = 2) -> DataFrame:
    """N1 + N2: piecewise-constant worker segments with their cost.

    Per incarnation: before the first event the first event's *current*
    workers (or the fallback); between events the previous *target*; after the
    last event its target; no events -> one fallback segment.  Events belong to
    every span that contains them (both ends inclusive).  Non-positive
    segments are dropped.  ``pricing`` (cluster_name, worker_hourly_eur,
    master_hourly_eur, fallback_workers) overrides the default shapes.
    """
    sp = _pricing(spans.select(*SPAN_COLS), pricing, worker, master, fallback_workers)
    ev = events.select("cluster_name", "event_ts", "current_primary_workers",
                       "target_primary_workers", "_tie")
    span_cols = [*SPAN_COLS, "worker_hourly_eur", "master_hourly_eur", "fallback_workers"]
    inside = interval_join(sp, ev, ["cluster_name"], "span_start_ts", "span_end_ts", "event_ts",
                           how="inner", bucket_seconds=DAY, keep_bucket=True)
    # One marker row per span at its start, ahead of any event at the same
    # instant; then a single ordered LEAD gives every segment:
    #   marker  -> [start, first event or end), first event's *current* workers
    #   event i -> [ts_i, ts_i+1 or end), event i's *target* workers
    # A span without events is its marker alone: [start, end), fallback workers.
    markers = sp.select(*span_cols, F.col("span_start_ts").alias("event_ts"),
                        F.lit(None).cast("int").alias("current_primary_workers"),
                        F.lit(None).cast("int").alias("target_primary_workers"),
                        F.lit("").alias("_tie"), F.lit(0).alias("_kind"),
                        time_bucket("span_start_ts", DAY).alias(BUCKET))
    rows = inside.select(*span_cols, "event_ts", "current_primary_workers", "target_primary_workers",
                         "_tie", F.lit(1).alias("_kind"), BUCKET).unionByName(markers)
    part = ["cluster_name", "incarnation_idx"]
    rows = bucketed_lead(rows, part, BUCKET, ["event_ts", "_kind", "_tie"],
                         ["event_ts", "current_primary_workers"], ["_next_ts", "_next_current"])
    fb = F.col("fallback_workers")
    workers = F.when(F.col("_kind") == 0, F.coalesce(F.col("_next_current").cast("double"), fb)) \
        .otherwise(F.coalesce(F.col("target_primary_workers").cast("double"), fb))
    segs = rows.select(*span_cols, F.col("event_ts").alias("from_ts"),
                       F.coalesce("_next_ts", "span_end_ts").alias("to_ts"), workers.alias("workers"))
    sec = (F.unix_millis("to_ts") - F.unix_millis("from_ts")) / 1000.0
    segs = segs.withColumn("seg_seconds", sec).filter(F.col("seg_seconds") > 0)
    hours = F.col("seg_seconds") / 3600.0
    return segs.select(
        "cluster_name", "incarnation_idx", "from_ts", "to_ts", "workers", "seg_seconds",
        (F.col("worker_hourly_eur") * F.col("workers") * hours).alias("worker_cost_eur"),
        (F.col("master_hourly_eur") * hours).alias("master_cost_eur"))


def span_minutes(spans: DataFrame) -> Column:
    return (F.unix_millis("span_end_ts") - F.unix_millis("span_start_ts")) / 60000.0


def incarnation_cost(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """Per-incarnation totals (the rows of the cost timeline)."""
    per = segments.groupBy("cluster_name", "incarnation_idx").agg(
        F.sum("worker_cost_eur").alias("worker_cost_eur"), F.sum("master_cost_eur").alias("master_cost_eur"),
        F.sum(F.col("workers") * F.col("seg_seconds")).alias("_ws"), F.sum("seg_seconds").alias("_s"),
        F.min("workers").alias("_min"), F.max("workers").alias("_max"),
        F.count(F.lit(1)).alias("segments"))
    s = spans.select(*SPAN_COLS, span_minutes(spans).alias("span_minutes"))
    j = s.join(per, ["cluster_name", "incarnation_idx"], "left")
    return j.select(
        *SPAN_COLS, "span_minutes",
        F.coalesce(F.try_divide("_ws", "_s"), F.lit(0.0)).alias("avg_workers"),
        F.coalesce(F.col("_min").cast("int"), F.lit(0)).alias("min_workers"),
        F.coalesce(F.col("_max").cast("int"), F.lit(0)).alias("max_workers"),
        F.coalesce("worker_cost_eur", F.lit(0.0)).alias("worker_cost_eur"),
        F.coalesce("master_cost_eur", F.lit(0.0)).alias("master_cost_eur"),
        (F.coalesce("worker_cost_eur", F.lit(0.0)) + F.coalesce("master_cost_eur", F.lit(0.0)))
        .alias("total_cost_eur"),
        F.coalesce("segments", F.lit(0)).alias("segments"))


def cluster_cost(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """Wall-clock minutes and estimated cost per cluster."""
    inc = incarnation_cost(spans, segments)
    return inc.groupBy("cluster_name").agg(
        F.count(F.lit(1)).alias("incarnations"),
        F.sum("span_minutes").alias("wall_clock_minutes"),
        F.sum("worker_cost_eur").alias("worker_cost_eur"),
        F.sum("master_cost_eur").alias("master_cost_eur"),
        F.sum("total_cost_eur").alias("estimated_cost_eur"))


def worker_stats(segments: DataFrame) -> DataFrame:
    """Global time-weighted average; max of per-span mins; max of per-span maxes."""
    per_span = segments.groupBy("cluster_name", "incarnation_idx").agg(
        F.sum(F.col("workers") * F.col("seg_seconds")).alias("_ws"), F.sum("seg_seconds").alias("_s"),
        F.min("workers").cast("int").alias("_min"), F.max("workers").cast("int").alias("_max"))
    return per_span.groupBy("cluster_name").agg(
        F.coalesce(F.try_divide(F.sum("_ws"), F.sum("_s")), F.lit(0.0)).alias("avg_workers"),
        F.max("_min").alias("min_workers"), F.max("_max").alias("max_workers"))


def cost_timeline(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """N6 in flat form: one row per interval with its incarnation totals."""
    inc = incarnation_cost(spans, segments).select(
        "cluster_name", "incarnation_idx", "span_start_ts", "span_end_ts", "span_minutes",
        F.col("avg_workers").alias("span_avg_workers"), F.col("total_cost_eur").alias("span_total_cost_eur"))
    return segments.withColumn("seg_cost_eur", F.col("worker_cost_eur") + F.col("master_cost_eur")) \
        .join(inc, ["cluster_name", "incarnation_idx"])


INCARNATIONS_PER_DOCUMENT = 1000


def cost_timeline_documents(spans: DataFrame, segments: DataFrame, events: DataFrame, worker: str = "e2-standard-8",
                            master: str = "e2-standard-8", per_document: int = INCARNATIONS_PER_DOCUMENT) -> DataFrame:
    """N6 nested: cluster -> incarnations -> intervals, with machine types, hourly prices, the workers really used and flags.

    A document holds ``per_document`` incarnations of a cluster (``part`` numbers them); its
    header and totals are the cluster's.  ``spans`` say which are ``synthetic``; the events
    inside a span are counted.
    """
    key = ["cluster_name", "incarnation_idx"]
    inside = interval_join(spans.select(*SPAN_COLS), events.select("cluster_name", "event_ts", "_tie"), ["cluster_name"], "span_start_ts",
                           "span_end_ts", "event_ts", how="inner", bucket_seconds=DAY).groupBy(*key).agg(F.count(F.lit(1)).alias("events_count"))
    intervals = segments.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(
        "from_ts", "to_ts", "workers", "seg_seconds", (F.col("worker_cost_eur") + F.col("master_cost_eur")).alias("seg_cost_eur")))).alias("intervals"))
    inc = (incarnation_cost(spans, segments).join(spans.select(*key, F.col("synthetic").alias("synthetic_span")), key)
           .join(inside, key, "left").join(intervals, key, "left"))
    totals = inc.groupBy("cluster_name").agg(F.sum("total_cost_eur").alias("total_cost_eur"), F.bool_or("synthetic_span").alias("has_synthetic_span"))
    used = worker_stats(segments).select("cluster_name", F.col("avg_workers").alias("real_used_avg_num_of_workers"),
                                         F.col("min_workers").alias("real_used_min_workers"), F.col("max_workers").alias("real_used_max_workers"))
    one = F.struct(F.col("incarnation_idx").alias("idx"), "span_start_ts", "span_end_ts", "span_minutes", "avg_workers", "min_workers", "max_workers",
                   "worker_cost_eur", "master_cost_eur", "total_cost_eur", "synthetic_span",
                   F.coalesce("events_count", F.lit(0)).alias("events_count"),
                   F.coalesce("intervals", F.array().cast(intervals.schema["intervals"].dataType)).alias("intervals"))
    docs = inc.groupBy("cluster_name", F.floor(F.col("incarnation_idx") / per_document).cast("int").alias("part")).agg(
        F.array_sort(F.collect_list(one), lambda a, b: a["idx"] - b["idx"]).alias("incarnations"))
    return docs.join(totals, "cluster_name").join(used, "cluster_name", "left").select(
        "cluster_name", "part", F.lit(worker).alias("worker_machine_type"), F.lit(master).alias("master_machine_type"),
        F.lit(price_of(worker)).alias("worker_hourly_eur"), F.lit(price_of(master)).alias("master_hourly_eur"),
        F.coalesce("real_used_avg_num_of_workers", F.lit(0.0)).alias("real_used_avg_num_of_workers"),
        F.coalesce("real_used_min_workers", F.lit(0)).alias("real_used_min_workers"),
        F.coalesce("real_used_max_workers", F.lit(0)).alias("real_used_max_workers"), "total_cost_eur", "has_synthetic_span", "incarnations")


def cost_timeline_json(documents: DataFrame) -> DataFrame:
    """The documents as JSON text (cluster_name, part, cost_timeline), numbers rounded as in the report."""
    places = {"span_minutes": 2, "avg_workers": 2, "worker_cost_eur": 4, "master_cost_eur": 4, "total_cost_eur": 4, "seg_seconds": 0, "seg_cost_eur": 4}
    field = lambda r, c: (F.round(r[c], places[c]) if c in places else r[c]).alias(c)
    kind = documents.schema["incarnations"].dataType.elementType
    part = kind["intervals"].dataType.elementType
    incarnations = F.transform("incarnations", lambda r: F.struct(
        *[field(r, c) for c in kind.names if c != "intervals"],
        F.transform(r["intervals"], lambda s: F.struct(*[field(s, c) for c in part.names])).alias("intervals")))
    head = [F.round(c, 4).alias(c) if c.endswith("_eur") else F.round(c, 2).alias(c) if c == "real_used_avg_num_of_workers" else F.col(c)
            for c in documents.columns if c not in ("cluster_name", "part", "incarnations")]
    return documents.select("cluster_name", "part", F.to_json(F.struct(*head, incarnations.alias("incarnations"))).alias("cost_timeline"))


def address_level(ips: Column, quota: int = IP_QUOTA, warn_pct: int = IP_WARN_PCT,
                  crit_pct: int = IP_CRIT_PCT) -> Column:
    return (F.when(ips >= quota, "over").when(ips >= quota * crit_pct / 100.0, "crit")
            .when(ips >= quota * warn_pct / 100.0, "warn").otherwise(""))


def address_timeline(segments: DataFrame) -> DataFrame:
    """Fleet address count (workers + 1 master per segment) at every segment start.

    Sweep line: +ips at from, -ips at to, summed per millisecond boundary,
    running sum by the bucketed scan (hour buckets; the carry window runs over
    one row per hour).
    """
    s = segments.select(F.unix_millis("from_ts").alias("f"), F.unix_millis("to_ts").alias("t"),
                        (F.col("workers") + 1).alias("ips"))
    edges = s.select(F.inline(F.array(
        F.struct(F.col("f").alias("ms"), F.col("ips").alias("d"), F.lit(True).alias("start")),
        F.struct(F.col("t").alias("ms"), (-F.col("ips")).alias("d"), F.lit(False).alias("start")))))
    per_ms = (edges.groupBy("ms").agg(F.sum("d").alias("d"), F.bool_or("start").alias("start"))
              .withColumn("_b", (F.col("ms") / 3_600_000).cast("long")))
    level = bucketed_running(per_ms, [], "_b", "ms", "d", "fleet_ips", fn="sum", strict=False)
    return level.filter("start").select(F.timestamp_millis("ms").alias("ts"),
                                        F.col("fleet_ips").cast("double").alias("fleet_ips"))


def address_peak(segments: DataFrame, quota: int = IP_QUOTA) -> DataFrame:
    """The peak fleet address count, its first time and its quota level."""
    tl = address_timeline(segments)
    # max of (ips, -time): the highest count, and the earliest time among equals
    peak = tl.agg(F.max(F.struct("fleet_ips", (-F.unix_millis("ts")).alias("_neg"))).alias("p"))
    return peak.select(F.timestamp_millis(-F.col("p._neg")).alias("peak_ts"),
                       F.col("p.fleet_ips").alias("peak_ips"),
                       address_level(F.col("p.fleet_ips"), quota).alias("level"))


def alive_at(segments: DataFrame, at_ts: str) -> DataFrame:
    """Clusters alive at ``at_ts`` (from <= t < to), highest-address segment per cluster."""
    t = F.unix_millis(F.to_timestamp(F.lit(at_ts)))
    live = segments.filter((F.unix_millis("from_ts") <= t) & (t < F.unix_millis("to_ts")))
    pick = live.groupBy("cluster_name").agg(
        F.max_by(F.struct("incarnation_idx", "workers"), F.struct(F.col("workers"), -F.col("incarnation_idx")))
        .alias("s"))
    return pick.select("cluster_name", F.col("s.incarnation_idx").alias("incarnation_idx"),
                       F.col("s.workers").alias("workers"), (F.col("s.workers") + 1).alias("ips")) \
        .orderBy(F.desc("ips"), "cluster_name")


def deployed_pricing(cluster_conf: DataFrame, prices: DataFrame, default_machine: str = "e2-standard-8",
                     default_workers: int = 2) -> DataFrame:
    """N9 input: per cluster the deployed worker / master hourly prices (from its
    config's machine types, default shape when unknown) and ``num_workers`` as the
    fallback worker count."""
    p = prices.select(F.col("machine_type"), F.col("price_eur_per_hour"))
    default_price = price_of(default_machine)
    w = p.select(F.col("machine_type").alias("worker_machine_type"), F.col("price_eur_per_hour").alias("_wp"))
    m = p.select(F.col("machine_type").alias("master_machine_type"), F.col("price_eur_per_hour").alias("_mp"))
    c = cluster_conf.join(w, "worker_machine_type", "left").join(m, "master_machine_type", "left")
    return c.select("cluster_name", F.coalesce("_wp", F.lit(default_price)).alias("worker_hourly_eur"),
                    F.coalesce("_mp", F.lit(default_price)).alias("master_hourly_eur"),
                    F.coalesce(F.col("num_workers").cast("double"), F.lit(float(default_workers))).alias("fallback_workers"))


def kept_cluster_costs(cluster_conf: DataFrame, prices: DataFrame, spans: DataFrame, events: DataFrame) -> DataFrame:
    """Cost of kept clusters re-computed from the current spans / events with
    the machine types that are actually deployed."""
    pricing = deployed_pricing(cluster_conf, prices)
    kept = spans.join(cluster_conf.select("cluster_name"), "cluster_name", "left_semi")
    return cluster_cost(kept, span_segments(kept, events, pricing))

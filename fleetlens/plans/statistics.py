"""Fleet statistics over snapshot pairs: correlations, z-score outliers, scatter.

Views (as in the comparison report):
  * ``delta``            -- current minus reference, paired recipes only;
  * ``current_snapshot`` -- raw current values, new recipes included.
Scopes: fleet-wide, or per cluster for clusters with at least 5 recipes.

Every statistic is a mergeable aggregate (``covar_pop``, ``stddev_pop``,
``avg``) reduced to one row per (scope, metric) and joined back; no global
window, nothing collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import pearson, z_score
from ..operators.params import broadcast_bounded
from .snapshots import KEYS, METRICS, metric_value, normalize_metrics

# The four correlated metric pairs, group-size floor, thresholds.
CORRELATION_PAIRS = [
    ("p95_run_max_executors", "p95_job_duration_ms"),
    ("avg_executors_per_job", "avg_job_duration_ms"),
    ("fraction_reaching_cap", "p95_job_duration_ms"),
    ("runs", "avg_job_duration_ms"),
]
MIN_GROUP_SIZE = 5
Z_THRESHOLD = 2.0
SCALE_Z_THRESHOLD = 3.0
DURATION_METRICS = ["avg_job_duration_ms", "p95_job_duration_ms"]


def delta_values(pairs: DataFrame) -> DataFrame:
    """Wide table of ``delta_<metric>`` (paired recipes), plus ref/cur values."""
    p = pairs.filter(F.col("status") == "paired")
    cols = []
    for m in METRICS:
        r, c = metric_value("ref_", m), metric_value("cur_", m)
        cols += [r.alias(f"ref_{m}"), c.alias(f"cur_{m}"), (c - r).alias(f"delta_{m}")]
    return p.select(*KEYS, *cols)


def current_values(current: DataFrame, reference: DataFrame) -> DataFrame:
    """Wide table of raw current values with ``is_new_entry``."""
    cur = normalize_metrics(current)
    ref_keys = reference.select(*KEYS).distinct().withColumn("_in_ref", F.lit(True))
    cols = [metric_value("", m).alias(m) for m in METRICS]
    return (cur.join(ref_keys, KEYS, "left")
            .select(*KEYS, *cols, F.col("_in_ref").isNull().alias("is_new_entry")))


def _corr_aggs(prefix: str) -> list[Column]:
    out = [F.count(F.lit(1)).alias("sample_size")]
    for i, (a, b) in enumerate(CORRELATION_PAIRS):
        x, y = F.col(f"{prefix}{a}"), F.col(f"{prefix}{b}")
        out += [F.covar_pop(x, y).alias(f"_cov{i}"), F.stddev_pop(x).alias(f"_sx{i}"),
                F.stddev_pop(y).alias(f"_sy{i}")]
    return out


def _corr_rows(agg: DataFrame, prefix: str, view: str, scope: list[str]) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(f"{prefix}{a}").alias("metric_a"), F.lit(f"{prefix}{b}").alias("metric_b"),
                 F.col(f"_cov{i}").alias("covariance"),
                 pearson(F.col(f"_cov{i}"), F.col(f"_sx{i}"), F.col(f"_sy{i}")).alias("pearson_correlation"))
        for i, (a, b) in enumerate(CORRELATION_PAIRS)])
    cluster = F.col("cluster_name") if scope else F.lit(None).cast("string")
    return agg.select(cluster.alias("cluster_scope"), "sample_size", F.inline(rows)).select(
        "metric_a", "metric_b", "covariance", "pearson_correlation", "sample_size",
        F.lit(view).alias("view"), "cluster_scope")


def correlations(wide: DataFrame, prefix: str, view: str, per_cluster: bool = False,
                 min_group: int = MIN_GROUP_SIZE) -> DataFrame:
    """Population covariance + Pearson for the four pairs."""
    scope = ["cluster_name"] if per_cluster else []
    agg = wide.groupBy(*scope).agg(*_corr_aggs(prefix))
    floor = min_group if per_cluster else 2
    return _corr_rows(agg.filter(F.col("sample_size") >= floor), prefix, view, scope)


def corr_delta_fleet(pairs: DataFrame) -> DataFrame:
    return correlations(delta_values(pairs), "delta_", "delta")


def corr_delta_cluster(pairs: DataFrame) -> DataFrame:
    return correlations(delta_values(pairs), "delta_", "delta", per_cluster=True)


def corr_current(current: DataFrame, reference: DataFrame) -> DataFrame:
    return correlations(current_values(current, reference), "", "current_snapshot")


def _long(wide: DataFrame, view: str) -> DataFrame:
    if view == "delta":
        items = [F.struct(F.lit(f"delta_{m}").alias("metric_name"), F.col(f"ref_{m}").alias("reference_value"),
                          F.col(f"cur_{m}").alias("current_value"), F.col(f"delta_{m}").alias("v"))
                 for m in METRICS]
        new = F.lit(False)
    else:
        items = [F.struct(F.lit(m).alias("metric_name"), F.lit(0.0).alias("reference_value"),
                          F.col(m).alias("current_value"), F.col(m).alias("v")) for m in METRICS]
        new = F.col("is_new_entry")
    return wide.select(*KEYS, new.alias("is_new_entry"), F.inline(F.array(*items)))


def zscores(wide: DataFrame, view: str, per_cluster: bool = False,
            threshold: float = Z_THRESHOLD, min_group: int = MIN_GROUP_SIZE) -> DataFrame:
    """Outliers with ``|z| >= threshold``; sigma = 0 metrics skipped."""
    long = _long(wide, view)
    scope = ["cluster_name"] if per_cluster else []
    stats = (long.groupBy(*scope, "metric_name")
             .agg(F.avg("v").alias("_mean"), F.stddev_pop("v").alias("_sd"), F.count(F.lit(1)).alias("_n"))
             .filter((F.col("_n") >= (min_group if per_cluster else 2)) & (F.col("_sd") != 0)))
    # fleet scope: one stats row per metric name of a fixed list -> broadcast;
    # per-cluster scope grows with the fleet, so it stays a plain join (AQE).
    if not per_cluster:
        stats = broadcast_bounded(stats, len(METRICS), "one row per metric name")
    z = z_score(F.col("v"), F.col("_mean"), F.col("_sd"))
    out = long.join(stats, [*scope, "metric_name"]).withColumn("z_score", z) \
        .filter(F.abs(F.col("z_score")) >= threshold)
    return out.select(*KEYS, "metric_name", "reference_value", "current_value", "z_score",
                      F.lit(True).alias("is_outlier"), F.lit(view).alias("view"), "is_new_entry",
                      (F.col("cluster_name") if per_cluster else F.lit(None).cast("string"))
                      .alias("cluster_scope"))


def zscore_delta(pairs: DataFrame, threshold: float = Z_THRESHOLD) -> DataFrame:
    return zscores(delta_values(pairs), "delta", threshold=threshold)


def zscore_cluster(pairs: DataFrame, threshold: float = Z_THRESHOLD) -> DataFrame:
    return zscores(delta_values(pairs), "delta", per_cluster=True, threshold=threshold)


def zscore_current(current: DataFrame, reference: DataFrame, threshold: float = Z_THRESHOLD) -> DataFrame:
    return zscores(current_values(current, reference), "current_snapshot", threshold=threshold)


def scatter_points(pairs: DataFrame, current: DataFrame, reference: DataFrame) -> DataFrame:
    """x/y points per metric pair for both views; key ``a__b``."""
    d = delta_values(pairs)
    delta_items = [F.struct(F.lit(f"delta_{a}__delta_{b}").alias("scatter_key"),
                            F.col(f"delta_{a}").alias("x"), F.col(f"delta_{b}").alias("y"))
                   for a, b in CORRELATION_PAIRS]
    dp = d.select(*KEYS, F.lit("delta").alias("view"), F.lit(False).alias("is_new"),
                  F.inline(F.array(*delta_items)))
    c = current_values(current, reference)
    cur_items = [F.struct(F.concat_ws("__", F.lit(a), F.lit(b)).alias("scatter_key"),
                          F.col(a).alias("x"), F.col(b).alias("y")) for a, b in CORRELATION_PAIRS]
    cp = c.select(*KEYS, F.lit("current_snapshot").alias("view"), F.col("is_new_entry").alias("is_new"),
                  F.inline(F.array(*cur_items)))
    return dp.unionByName(cp).select("scatter_key", "view", *KEYS, "x", "y", "is_new")


def scale_signals(current: DataFrame, reference: DataFrame, threshold: float = Z_THRESHOLD,
                  scale_z: float = SCALE_Z_THRESHOLD) -> DataFrame:
    """Positive duration outliers (z >= 3) of paired recipes, current view."""
    z = zscore_current(current, reference, threshold)
    sig = z.filter(F.col("is_outlier") & ~F.col("is_new_entry")
                   & F.col("metric_name").isin(*DURATION_METRICS) & (F.col("z_score") >= scale_z))
    cur = normalize_metrics(current).select(*KEYS, "p95_run_max_executors")
    return sig.join(cur, KEYS).select(*KEYS, "metric_name", "z_score", "p95_run_max_executors")


def divergences_report(z: DataFrame) -> DataFrame:
    """Divergences ordered by |z| descending (then key, for a stable order)."""
    return z.orderBy(F.desc(F.abs("z_score")), *KEYS, "metric_name")

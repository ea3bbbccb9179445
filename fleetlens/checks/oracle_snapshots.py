"""Oracle SQL for the snapshot comparison and statistics queries.

Both snapshots run the b13 SQL over their slice of ``events`` (prefix ``r_``
for the reference window, ``c_`` for the current one), then the comparison
is written the direct way: full outer join, CASE chains, UNION ALL of the
metric columns, aggregates joined back.
"""

from __future__ import annotations

from .oracle import CAPACITY, EV, metric_ctes


def _renamed(residues: str, every: int, offset: int, window: str) -> str:
    """The rows of a window: users that share a recipe, and those that go by another id in it."""
    return f"""SELECT * REPLACE (CASE WHEN (user_id // 7) % 20 BETWEEN 1 AND 5 AND user_id % 7 IN ({residues})
      THEN user_id - 7 * ((user_id // 7) % 20) WHEN user_id % {every} = 0 THEN user_id + {offset} ELSE user_id END AS user_id)
    FROM ev WHERE ts {window} TIMESTAMP '2024-01-16'"""


SNAP_EVENTS = {"r_": _renamed("1, 2, 5", 11, 7000000, "<"), "c_": _renamed("1, 3, 5", 13, 14000000, ">=")}


def snapshot_ctes(p: str) -> str:
    """b13 of one window ({p}b13), and with defaults for what is missing ({p}m)."""
    return metric_ctes(p, SNAP_EVENTS[p]) + f""",
{p}m AS (
  SELECT cluster_name, recipe_filename, COALESCE(CAST(avg_executors_per_job AS DOUBLE), 1.0) AS avg_executors_per_job,
         COALESCE(CAST(p95_run_max_executors AS DOUBLE), 1.0) AS p95_run_max_executors,
         COALESCE(CAST(avg_job_duration_ms AS DOUBLE), 0.0) AS avg_job_duration_ms,
         COALESCE(CAST(p95_job_duration_ms AS DOUBLE), avg_job_duration_ms, 0.0) AS p95_job_duration_ms, runs, fraction_reaching_cap
  FROM {p}b13)"""


METRICS = ["avg_executors_per_job", "p95_run_max_executors", "avg_job_duration_ms",
           "p95_job_duration_ms", "fraction_reaching_cap", "runs"]
PAIRS = [("p95_run_max_executors", "p95_job_duration_ms"),
         ("avg_executors_per_job", "avg_job_duration_ms"),
         ("fraction_reaching_cap", "p95_job_duration_ms"),
         ("runs", "avg_job_duration_ms")]


def _val(alias: str, m: str) -> str:
    if m == "fraction_reaching_cap":
        return f"COALESCE({alias}.{m}, 0.0)"
    return f"CAST({alias}.{m} AS DOUBLE)"


def _pct(r: str, c: str) -> str:
    return (f"CASE WHEN ({r}) = 0 AND ({c}) = 0 THEN 0.0 WHEN ({r}) = 0 THEN 100.0 "
            f"ELSE (({c}) - ({r})) / ABS({r}) * 100.0 END")


PAIRS_CTE = "pairs AS (\n  SELECT COALESCE(r.cluster_name, c.cluster_name) AS cluster_name,\n" \
    "         COALESCE(r.recipe_filename, c.recipe_filename) AS recipe_filename,\n" \
    "         CASE WHEN r.cluster_name IS NOT NULL AND c.cluster_name IS NOT NULL THEN 'paired'\n" \
    "              WHEN c.cluster_name IS NOT NULL THEN 'new' ELSE 'dropped' END AS status,\n" + \
    ",\n".join(f"         r.{m} AS ref_{m}, c.{m} AS cur_{m}" for m in METRICS) + \
    "\n  FROM r_m r FULL OUTER JOIN c_m c\n" \
    "    ON r.cluster_name = c.cluster_name AND r.recipe_filename = c.recipe_filename)"

TRENDS_CTE = f"""trends AS (
  SELECT cluster_name, recipe_filename, status,
         CASE WHEN status = 'new' THEN 'new_entry' WHEN status = 'dropped' THEN 'dropped_entry'
              WHEN p95_pct > 10.0 OR (cap_pct > 15.0 AND cap_cur > 0) THEN 'degraded'
              WHEN p95_pct < -5.0 AND cap_pct <= 15.0 THEN 'improved' ELSE 'stable' END AS trend,
         CASE WHEN status = 'paired' THEN LEAST(1.0, LEAST(ref_runs, cur_runs) / 10.0) ELSE 0.0 END
           AS confidence,
         CASE WHEN status = 'paired' THEN p95_pct END AS p95_pct_change,
         CASE WHEN status = 'paired' THEN cap_pct END AS cap_pct_change,
         CASE WHEN status = 'paired' THEN CAST(ref_p95_job_duration_ms AS DOUBLE) END AS p95_duration_ref,
         CASE WHEN status = 'paired' THEN CAST(cur_p95_job_duration_ms AS DOUBLE) END AS p95_duration_cur
  FROM (SELECT *, {_pct('CAST(ref_p95_job_duration_ms AS DOUBLE)', 'CAST(cur_p95_job_duration_ms AS DOUBLE)')} AS p95_pct,
               {_pct('COALESCE(ref_fraction_reaching_cap, 0.0)', 'COALESCE(cur_fraction_reaching_cap, 0.0)')} AS cap_pct,
               COALESCE(cur_fraction_reaching_cap, 0.0) AS cap_cur
        FROM pairs))"""

DECISIONS_CTE = """decisions AS (
  SELECT cluster_name, recipe_filename, trend, confidence,
         CASE trend WHEN 'degraded' THEN 'boost_resources' WHEN 'new_entry' THEN 'generate_fresh'
                    WHEN 'dropped_entry' THEN 'preserve_historical' ELSE 'keep_as_is' END AS action,
         CASE trend
           WHEN 'improved' THEN 'Performance improved (confidence=' || printf('%.1f', confidence)
                                || '). Keeping reference config.'
           WHEN 'degraded' THEN 'Performance degraded: '
                || CASE WHEN ABS(cap_pct_change) >= ABS(p95_pct_change) THEN 'fraction_reaching_cap'
                        ELSE 'p95_job_duration_ms' END
                || ' changed '
                || printf('%.1f', CASE WHEN ABS(cap_pct_change) >= ABS(p95_pct_change) THEN cap_pct_change
                                       ELSE p95_pct_change END)
                || '%. Re-planning with current metrics.'
           WHEN 'stable' THEN 'Performance stable (confidence=' || printf('%.1f', confidence)
                              || '). Keeping reference config.'
           WHEN 'new_entry' THEN 'New recipe not present in reference date. Generating fresh config.'
           ELSE 'Recipe absent from current date. Preserving historical config for future evolution.' END
           AS reason
  FROM trends)"""

SNAP_CTES = [EV, CAPACITY,
             snapshot_ctes("r_"),
             snapshot_ctes("c_"),
             PAIRS_CTE]


def _with(*extra: str) -> str:
    return "WITH " + ",\n".join([*SNAP_CTES, *extra]) + "\n"


def _r6(x: str) -> str:
    return f"ROUND({x}, 6)"


SNAPSHOT_PAIRING = _with() + "SELECT cluster_name, recipe_filename, status, " + ", ".join(
    f"{_r6('ref_' + m) if m != 'runs' else 'ref_runs'} AS ref_{m}, "
    f"{_r6('cur_' + m) if m != 'runs' else 'cur_runs'} AS cur_{m}" for m in METRICS) + " FROM pairs"

DELTA_CTE = "dv AS (SELECT cluster_name, recipe_filename, " + ", ".join(
    f"{_val('p', 'ref_' + m) if m != 'fraction_reaching_cap' else 'COALESCE(p.ref_fraction_reaching_cap, 0.0)'} AS ref_{m}, "
    f"{_val('p', 'cur_' + m) if m != 'fraction_reaching_cap' else 'COALESCE(p.cur_fraction_reaching_cap, 0.0)'} AS cur_{m}"
    for m in METRICS) + " FROM pairs p WHERE status = 'paired')"

METRIC_DELTAS = _with(DELTA_CTE) + "\nUNION ALL\n".join(
    f"SELECT cluster_name, recipe_filename, '{m}' AS metric_name, ROUND(ref_{m}, 6) AS reference_value, "
    f"ROUND(cur_{m}, 6) AS current_value, ROUND(cur_{m} - ref_{m}, 6) AS absolute_change, "
    f"ROUND({_pct(f'ref_{m}', f'cur_{m}')}, 6) AS percentage_change FROM dv" for m in METRICS)

TREND_CLASS = _with(TRENDS_CTE) + """SELECT cluster_name, recipe_filename, trend, ROUND(confidence, 6) AS confidence,
  ROUND(p95_pct_change, 6) AS p95_pct_change, ROUND(cap_pct_change, 6) AS cap_pct_change FROM trends"""

EVOLUTION_DECISIONS = _with(TRENDS_CTE, DECISIONS_CTE) + """SELECT cluster_name, recipe_filename, trend,
  ROUND(confidence, 6) AS confidence, action, reason FROM decisions"""

CLUSTER_TREND_ROLLUP = _with(TRENDS_CTE) + """SELECT cluster_name,
  CASE WHEN bool_or(trend = 'degraded') THEN 'degraded' WHEN bool_and(trend = 'improved') THEN 'improved'
       WHEN bool_or(trend = 'improved') THEN 'mixed' ELSE 'stable' END AS overall_trend,
  COUNT(*) AS recipes
FROM trends GROUP BY cluster_name"""

CLUSTER_ACTIONS = _with(TRENDS_CTE, DECISIONS_CTE) + """SELECT cluster_name,
  CASE WHEN bool_or(action = 'boost_resources') THEN 'boost_resources'
       WHEN bool_or(action = 'generate_fresh') THEN 'generate_fresh'
       WHEN bool_or(action = 'keep_as_is') THEN 'keep_as_is' ELSE 'preserve_historical' END AS cluster_action
FROM decisions GROUP BY cluster_name"""

TREND_COUNTS = _with(TRENDS_CTE) + """SELECT trend, COUNT(*) AS recipes, COUNT(DISTINCT cluster_name) AS clusters
FROM trends GROUP BY trend"""

TREND_SUMMARY = _with(TRENDS_CTE, DECISIONS_CTE) + """SELECT t.cluster_name, t.recipe_filename, t.trend,
  ROUND(t.confidence, 6) AS confidence, d.action, d.reason, ROUND(t.p95_duration_ref, 6) AS p95_duration_ref,
  ROUND(t.p95_duration_cur, 6) AS p95_duration_cur, ROUND(t.p95_pct_change, 6) AS p95_duration_pct_change
FROM trends t LEFT JOIN decisions d USING (cluster_name, recipe_filename)"""

CURRENT_CTE = "cv AS (SELECT c.cluster_name, c.recipe_filename, " + ", ".join(
    f"{_val('c', m)} AS {m}" for m in METRICS) + \
    ", r.cluster_name IS NULL AS is_new_entry FROM c_m c LEFT JOIN r_m r " \
    "ON r.cluster_name = c.cluster_name AND r.recipe_filename = c.recipe_filename)"


def _corr_sql(src: str, prefix: str, view: str, per_cluster: bool) -> str:
    parts = []
    for a, b in PAIRS:
        x, y = f"{prefix}{a}", f"{prefix}{b}"
        grp = "cluster_name" if per_cluster else "NULL"
        floor = 5 if per_cluster else 2
        parts.append(f"""SELECT '{x}' AS metric_a, '{y}' AS metric_b,
  ROUND(covar_pop({x}, {y}), 6) AS covariance,
  ROUND(CASE WHEN stddev_pop({x}) = 0 OR stddev_pop({y}) = 0 THEN 0.0
        ELSE GREATEST(-1.0, LEAST(1.0, covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})))) END, 6)
    AS pearson_correlation,
  COUNT(*) AS sample_size, '{view}' AS view, CAST({grp} AS VARCHAR) AS cluster_scope
FROM {src} {'GROUP BY cluster_name' if per_cluster else ''} HAVING COUNT(*) >= {floor}""")
    return "\nUNION ALL\n".join(parts)


DV_WIDE = "dw AS (SELECT cluster_name, recipe_filename, " + ", ".join(
    f"cur_{m} - ref_{m} AS delta_{m}" for m in METRICS) + " FROM dv)"

CORR_DELTA_FLEET = _with(DELTA_CTE, DV_WIDE) + _corr_sql("dw", "delta_", "delta", False)
CORR_DELTA_CLUSTER = _with(DELTA_CTE, DV_WIDE) + _corr_sql("dw", "delta_", "delta", True)
CORR_CURRENT = _with(CURRENT_CTE) + _corr_sql("cv", "", "current_snapshot", False)


def _z_sql(long_cte: str, view: str, per_cluster: bool, extra_filter: str = "") -> str:
    scope = "cluster_name, " if per_cluster else ""
    floor = 5 if per_cluster else 2
    join_on = "l.cluster_name = s.cluster_name AND " if per_cluster else ""
    return long_cte + f""",
st AS (SELECT {scope}metric_name, AVG(v) AS mean, STDDEV_POP(v) AS sd FROM long
       GROUP BY {scope}metric_name HAVING COUNT(*) >= {floor} AND STDDEV_POP(v) <> 0),
z AS (SELECT l.*, (l.v - s.mean) / s.sd AS z_score FROM long l JOIN st s
      ON {join_on}l.metric_name = s.metric_name)
SELECT cluster_name, recipe_filename, metric_name, ROUND(reference_value, 6) AS reference_value,
  ROUND(current_value, 6) AS current_value, ROUND(z_score, 6) AS z_score, TRUE AS is_outlier,
  '{view}' AS view, is_new_entry, {'cluster_name' if per_cluster else 'CAST(NULL AS VARCHAR)'} AS cluster_scope
FROM z WHERE ABS(z_score) >= 2.0 {extra_filter}"""


DELTA_LONG = "long AS (" + "\nUNION ALL\n".join(
    f"SELECT cluster_name, recipe_filename, 'delta_{m}' AS metric_name, ref_{m} AS reference_value, "
    f"cur_{m} AS current_value, cur_{m} - ref_{m} AS v, FALSE AS is_new_entry FROM dv" for m in METRICS) + ")"
CUR_LONG = "long AS (" + "\nUNION ALL\n".join(
    f"SELECT cluster_name, recipe_filename, '{m}' AS metric_name, 0.0 AS reference_value, "
    f"{m} AS current_value, {m} AS v, is_new_entry FROM cv" for m in METRICS) + ")"

def _with_open(*extra: str) -> str:
    return "WITH " + ",\n".join([*SNAP_CTES, *extra]) + ",\n"


ZSCORE_DELTA = _with_open(DELTA_CTE) + _z_sql(DELTA_LONG, "delta", False)
ZSCORE_CLUSTER = _with_open(DELTA_CTE) + _z_sql(DELTA_LONG, "delta", True)
ZSCORE_CURRENT = _with_open(CURRENT_CTE) + _z_sql(CUR_LONG, "current_snapshot", False)

SCALE_SIGNALS = _with_open(CURRENT_CTE) + CUR_LONG + """,
st AS (SELECT metric_name, AVG(v) AS mean, STDDEV_POP(v) AS sd FROM long
       GROUP BY metric_name HAVING COUNT(*) >= 2 AND STDDEV_POP(v) <> 0),
z AS (SELECT l.*, (l.v - s.mean) / s.sd AS z_score FROM long l JOIN st s ON l.metric_name = s.metric_name)
SELECT z.cluster_name, z.recipe_filename, z.metric_name, ROUND(z.z_score, 6) AS z_score,
       ROUND(cv.p95_run_max_executors, 6) AS p95_run_max_executors
FROM z JOIN cv USING (cluster_name, recipe_filename)
WHERE ABS(z.z_score) >= 2.0 AND NOT z.is_new_entry
  AND z.metric_name IN ('avg_job_duration_ms', 'p95_job_duration_ms') AND z.z_score >= 3.0"""

SCATTER_POINTS = _with(DELTA_CTE, CURRENT_CTE) + "\nUNION ALL\n".join(
    [f"SELECT 'delta_{a}__delta_{b}' AS scatter_key, 'delta' AS view, cluster_name, recipe_filename, "
     f"ROUND(cur_{a} - ref_{a}, 6) AS x, ROUND(cur_{b} - ref_{b}, 6) AS y, FALSE AS is_new FROM dv"
     for a, b in PAIRS] +
    [f"SELECT '{a}__{b}', 'current_snapshot', cluster_name, recipe_filename, ROUND({a}, 6), "
     f"ROUND({b}, 6), is_new_entry FROM cv" for a, b in PAIRS])


RUN_SUMMARY = _with(TRENDS_CTE, DECISIONS_CTE) + """SELECT 'trend' AS section, trend AS label, COUNT(*) AS n
FROM trends GROUP BY trend
UNION ALL SELECT 'action', action, COUNT(*) FROM decisions GROUP BY action"""

ACTIVE_MINUTES = _with() + """SELECT cluster_name, ROUND(SUM(avg_job_duration_ms / 60000.0), 6) AS active_minutes
FROM c_m GROUP BY cluster_name"""


def snapshot_sql() -> dict[str, str]:
    return {
        "snapshot_pairing": SNAPSHOT_PAIRING, "metric_deltas": METRIC_DELTAS,
        "trend_class": TREND_CLASS, "evolution_decisions": EVOLUTION_DECISIONS,
        "cluster_trend_rollup": CLUSTER_TREND_ROLLUP, "cluster_actions": CLUSTER_ACTIONS,
        "trend_counts": TREND_COUNTS, "trend_summary": TREND_SUMMARY,
        "corr_delta_fleet": CORR_DELTA_FLEET, "corr_delta_cluster": CORR_DELTA_CLUSTER,
        "corr_current": CORR_CURRENT, "zscore_delta": ZSCORE_DELTA, "zscore_cluster": ZSCORE_CLUSTER,
        "zscore_current_new": ZSCORE_CURRENT, "scatter_points": SCATTER_POINTS,
        "scale_signals": SCALE_SIGNALS, "run_summary": RUN_SUMMARY, "active_minutes": ACTIVE_MINUTES,
    }

"""Oracle SQL for the snapshot store, the stored raw log, boost chains and documents."""

from __future__ import annotations

from .oracle import B13, B14, B20, CAPACITY, EV, metric_ctes
from .oracle_boosts import CTES
from .oracle_cost import COST_CTES, PRICE
from .oracle_diag import B14_CTES, MASTER_PROMOTION, _signals
from .oracle_evolution import EVOLVED, WINDOWS
from .oracle_fold import CLUSTER_CONFIG, CLUSTER_SUMMARY
from .oracle_snapshots import METRICS, SNAP_CTES, ZSCORE_DELTA, _pct
from .oracle_snapshots import DECISIONS_CTE, TRENDS_CTE

# the weeks of the driver's events, by their Mondays
WEEKS = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29"]


def _weekly() -> str:
    ctes = [EV, CAPACITY] + [metric_ctes(f"w{i}_", f"SELECT * FROM ev WHERE date_trunc('week', ts) = DATE '{w}'") for i, w in enumerate(WEEKS)]
    rows = "\nUNION ALL ".join(f"SELECT *, '{w}' AS snapshot_date FROM w{i}_b13" for i, w in enumerate(WEEKS))
    return "WITH " + ",\n".join(ctes) + f",\nweekly AS ({rows})\n"


SNAPSHOT_STORE = _weekly() + """SELECT * REPLACE (ROUND(avg_executors_per_job, 6) AS avg_executors_per_job,
  ROUND(avg_job_duration_ms, 6) AS avg_job_duration_ms, ROUND(fraction_reaching_cap, 6) AS fraction_reaching_cap) FROM weekly"""

_P95 = _pct("r.p95", "c.p95")
_CAP = _pct("r.cap", "c.cap")
RUNS_INDEX = _weekly() + f""", m AS (
  SELECT cluster_name, recipe_filename, snapshot_date, CAST(COALESCE(p95_job_duration_ms, avg_job_duration_ms, 0) AS DOUBLE) AS p95,
         COALESCE(fraction_reaching_cap, 0.0) AS cap FROM weekly),
d AS (SELECT snapshot_date AS now, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS before FROM (SELECT DISTINCT snapshot_date FROM weekly)),
j AS (
  SELECT d.before, d.now, COALESCE(r.cluster_name, c.cluster_name) AS cluster_name,
         CASE WHEN r.p95 IS NULL THEN 'new' WHEN c.p95 IS NULL THEN 'dropped' WHEN {_P95} > 10.0 OR ({_CAP} > 15.0 AND c.cap > 0) THEN 'degraded'
              WHEN {_P95} < -5.0 AND {_CAP} <= 15.0 THEN 'improved' ELSE 'stable' END AS trend
  FROM d JOIN (SELECT DISTINCT d.now AS at, x.cluster_name, x.recipe_filename FROM d JOIN m x ON x.snapshot_date IN (d.now, d.before)) k ON k.at = d.now
  LEFT JOIN m r ON r.snapshot_date = d.before AND r.cluster_name = k.cluster_name AND r.recipe_filename = k.recipe_filename
  LEFT JOIN m c ON c.snapshot_date = d.now AND c.cluster_name = k.cluster_name AND c.recipe_filename = k.recipe_filename
  WHERE d.before IS NOT NULL)
SELECT before || '_' || now AS dir, before AS reference_date, now AS current_date, 'default' AS strategy,
       COUNT(DISTINCT cluster_name) AS total_clusters, COUNT(*) AS total_recipes, COUNT(*) FILTER (trend = 'improved') AS improved,
       COUNT(*) FILTER (trend = 'degraded') AS degraded, COUNT(*) FILTER (trend = 'stable') AS stable,
       COUNT(*) FILTER (trend = 'new') AS new_entries, COUNT(*) FILTER (trend = 'dropped') AS dropped_entries
FROM j GROUP BY before, now"""

HEAP_BOOST_CHAIN = "WITH RECURSIVE " + ",\n".join(CTES) + """,
weeks AS (
  SELECT CAST(w AS VARCHAR) AS snapshot_date, row_number() OVER (ORDER BY w) AS i
  FROM (SELECT DISTINCT CAST(date_trunc('week', ts) AS DATE) AS w FROM ev)),
hits AS (
  SELECT DISTINCT cluster_name, recipe_filename, CAST(CAST(date_trunc('week', latest_driver_log_ts) AS DATE) AS VARCHAR) AS snapshot_date FROM sig),
steps AS (
  SELECT cluster_name, recipe_filename, 0 AS i, CAST(NULL AS VARCHAR) AS snapshot_date, CAST(NULL AS VARCHAR) AS state, 0 AS before_gb,
         CAST(replace(mem, 'g', '') AS INTEGER) AS gb,
         CASE WHEN CAST(regexp_extract(recipe_filename, '_RECIPE_(\\d+)', 1) AS BIGINT) % 6 = 0 THEN 1.5::DOUBLE END AS factor
  FROM cfg
  UNION ALL
  SELECT s.cluster_name, s.recipe_filename, s.i + 1, w.snapshot_date,
         CASE WHEN h.cluster_name IS NOT NULL AND s.factor IS NULL THEN 'new' WHEN h.cluster_name IS NOT NULL THEN 're-boost'
              WHEN s.factor IS NOT NULL THEN 'holding' END,
         s.gb, CASE WHEN h.cluster_name IS NULL THEN s.gb ELSE CAST(CEIL(s.gb * 1.5) AS INTEGER) END,
         CASE WHEN h.cluster_name IS NULL THEN s.factor ELSE COALESCE(s.factor, 1.0) * 1.5 END
  FROM steps s JOIN weeks w ON w.i = s.i + 1
  LEFT JOIN hits h ON h.cluster_name = s.cluster_name AND h.recipe_filename = s.recipe_filename AND h.snapshot_date = w.snapshot_date)
SELECT cluster_name, recipe_filename, snapshot_date, state, before_gb AS original_memory_gb, gb AS boosted_memory_gb,
       ROUND(factor, 6) AS cumulative_factor
FROM steps WHERE state IS NOT NULL"""

HEAP_BOOST_SINGLE = "WITH " + ",\n".join(CTES) + """
SELECT cluster_name, recipe_filename, mem AS original_memory,
       CASE WHEN prior IS NOT NULL THEN mem ELSE CAST(CAST(CEIL(CAST(replace(mem, 'g', '') AS INTEGER) * 1.5) AS INTEGER) AS VARCHAR) || 'g' END AS boosted_memory,
       1.5 AS boost_factor, 1.5 AS cumulative_factor, CASE WHEN prior IS NOT NULL THEN 'holding' ELSE 'new' END AS state
FROM cfg JOIN curs USING (cluster_name, recipe_filename)"""

PRIORITISED = "WITH " + ",\n".join(CTES) + """, every AS (
  SELECT *, CASE WHEN latest_driver_log_ts >= TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS from_reference FROM sig WHERE recipe_filename <> '')
SELECT cluster_name, recipe_filename, job_id, latest_driver_log_ts, from_reference
FROM every QUALIFY row_number() OVER (PARTITION BY cluster_name, recipe_filename ORDER BY from_reference, latest_driver_log_ts) = 1"""

UNRESOLVED = "WITH " + ",\n".join(CTES) + """, s AS (
  SELECT job_id, cluster_name, latest_driver_log_ts, regexp_replace(job_id, '-\\d{8}-\\d{4}$', '') AS prefix,
         CASE WHEN CAST(regexp_extract(recipe_filename, '_RECIPE_(\\d+)', 1) AS BIGINT) % 2 = 1 THEN recipe_filename END AS given FROM sig),
lost AS (
  SELECT job_id, cluster_name, MAX(latest_driver_log_ts) AS latest_driver_log_ts
  FROM s WHERE given IS NULL AND NOT EXISTS (SELECT 1 FROM s o WHERE o.cluster_name = s.cluster_name AND o.prefix = s.prefix AND o.given IS NOT NULL)
  GROUP BY 1, 2)
SELECT 'memory_heap' AS vitamin_name, 'b16_oom_job_driver_exceptions.csv' AS csv_source, job_id, cluster_name, latest_driver_log_ts,
       COUNT(*) OVER () AS unresolved_count
FROM lost"""

ANALYSIS = "WITH " + ",\n".join([*SNAP_CTES, TRENDS_CTE, DECISIONS_CTE]) + """, roll AS (
  SELECT cluster_name, CASE WHEN bool_or(trend = 'degraded') THEN 'degraded' WHEN bool_and(trend = 'improved') THEN 'improved'
         WHEN bool_or(trend = 'improved') THEN 'mixed' ELSE 'stable' END AS overall_trend FROM trends GROUP BY 1),
v AS (""" + "\nUNION ALL\n".join(
    f"""SELECT cluster_name, recipe_filename, {i} AS metric_pos, '{m}' AS metric,
         CASE WHEN status <> 'new' THEN {f"COALESCE(ref_{m}, 0.0)" if m == "fraction_reaching_cap" else f"CAST(ref_{m} AS DOUBLE)"} END AS r,
         CASE WHEN status <> 'dropped' THEN {f"COALESCE(cur_{m}, 0.0)" if m == "fraction_reaching_cap" else f"CAST(cur_{m} AS DOUBLE)"} END AS c,
         ref_{m} IS NULL AS ref_gone, cur_{m} IS NULL AS cur_gone, status FROM pairs""" for i, m in enumerate(METRICS)) + f""")
SELECT cluster_name, overall_trend, 0 AS part, CAST(dense_rank() OVER (PARTITION BY cluster_name ORDER BY recipe_filename) - 1 AS INTEGER) AS recipe_pos,
       recipe_filename, trend, ROUND(confidence, 6) AS confidence, action, reason, metric_pos, metric,
       ROUND(CASE WHEN status = 'paired' OR NOT ref_gone THEN r END, 6) AS reference, ROUND(CASE WHEN status = 'paired' OR NOT cur_gone THEN c END, 6) AS current,
       ROUND(CASE WHEN status = 'paired' THEN {_pct('r', 'c')} END, 6) AS pct_change
FROM v JOIN trends USING (cluster_name, recipe_filename, status) JOIN decisions USING (cluster_name, recipe_filename, trend, confidence) JOIN roll USING (cluster_name)"""

_CHANGED = """heaped AS (
  SELECT c.cluster_name, c.recipe_filename, c.manual, c.mn, c.mx, c.inst, c.prior, h.state,
         CAST(replace(c.mem, 'g', '') AS INTEGER) AS gb, CAST(replace(COALESCE(h.boosted_memory, c.mem), 'g', '') AS INTEGER) AS gb2,
         CASE WHEN h.state IS NULL THEN CAST(c.prior AS DOUBLE) ELSE CAST(h.cumulative_factor AS DOUBLE) END AS factor,
         CAST(regexp_extract(c.recipe_filename, '_RECIPE_(\\d+)', 1) AS BIGINT) AS uid
  FROM cfg c LEFT JOIN heap h USING (cluster_name, recipe_filename))"""

BOOSTED_DOCUMENTS = "WITH " + ",\n".join([*CTES, _CHANGED]) + f""", conf AS ({CLUSTER_CONFIG}),
counted AS (SELECT cluster_name, COUNT(*) AS n, string_agg(recipe_filename, ';' ORDER BY uid DESC) AS names FROM heaped WHERE state IS NOT NULL GROUP BY 1)
SELECT cluster_name, CAST(row_number() OVER (PARTITION BY cluster_name ORDER BY uid DESC) - 1 AS INTEGER) AS position, recipe_filename,
       CASE WHEN manual THEN 'spark.executor.instances=' || inst || ';spark.executor.memory=' || gb2 || 'g'
            ELSE 'spark.dynamicAllocation.enabled=true;spark.dynamicAllocation.minExecutors=' || mn || ';spark.dynamicAllocation.maxExecutors=' || mx
                 || ';spark.executor.memory=' || gb2 || 'g' END AS options,
       CAST(CASE WHEN manual THEN inst ELSE mn END * gb2 AS INTEGER) AS min_gb, CAST(CASE WHEN manual THEN inst ELSE mx END * gb2 AS INTEGER) AS max_gb,
       ROUND(factor, 6) AS factor, CAST(n AS INTEGER) AS boosted_count, names AS boosted_list,
       'num_workers;master_machine_type;worker_machine_type;autoscaling_policy;total_no_of_jobs;cluster_max_total_memory_gb;cluster_max_total_cores;accumulated_max_total_memory_per_jobs_gb'
       || CASE WHEN n > 0 THEN ';boostedMemoryHeapJobCount;boostedMemoryHeapJobList' ELSE '' END AS field_order
FROM heaped JOIN conf USING (cluster_name) LEFT JOIN counted USING (cluster_name)"""

_DIFF = "WITH " + ",\n".join([*CTES, _CHANGED]) + f""", conf AS (
  SELECT *, CAST(regexp_extract(cluster_name, '(\\d+)$', 1) AS INTEGER) % 3 AS third, cluster_name || '-manually-tuned.json' AS file_name FROM ({CLUSTER_CONFIG}))
"""
CONTENT_DIFF = _DIFF + """SELECT file_name, 'num_workers' AS "column", CAST(num_workers AS VARCHAR) AS value_A, CAST(num_workers + 1 AS VARCHAR) AS value_B
FROM conf WHERE third = 1
UNION ALL
SELECT file_name, 'content_other', 'differs', 'differs' FROM conf
WHERE third = 2 AND cluster_name IN (SELECT cluster_name FROM heaped WHERE state <> 'holding')"""

PATH_DIFF = _DIFF + """, b AS (SELECT h.*, '$.recipeSparkConf.' || recipe_filename AS place, file_name FROM heaped h JOIN conf USING (cluster_name) WHERE third = 2 AND state <> 'holding')
SELECT file_name, '$.clusterConf.' || cluster_name || '.num_workers' AS path, CAST(num_workers AS VARCHAR) AS value_A, CAST(num_workers + 1 AS VARCHAR) AS value_B
FROM conf WHERE third = 1
UNION ALL SELECT file_name, place || '.sparkOptsMap.spark.executor.memory', '"' || gb || 'g"', '"' || gb2 || 'g"' FROM b
UNION ALL SELECT file_name, place || '.total_executor_minimum_allocated_memory_gb', CAST(CASE WHEN manual THEN inst ELSE mn END * gb AS VARCHAR),
                 CAST(CASE WHEN manual THEN inst ELSE mn END * gb2 AS VARCHAR) FROM b
UNION ALL SELECT file_name, place || '.total_executor_maximum_allocated_memory_gb', CAST(CASE WHEN manual THEN inst ELSE mx END * gb AS VARCHAR),
                 CAST(CASE WHEN manual THEN inst ELSE mx END * gb2 AS VARCHAR) FROM b
UNION ALL SELECT file_name, place || '.appliedMemoryHeapBoostFactor', CAST(CAST(prior AS DOUBLE) AS VARCHAR), CAST(factor AS VARCHAR) FROM b"""


COST_DOCUMENTS = "WITH " + ",\n".join(COST_CTES) + f""", held AS (
  SELECT s.cluster_name, s.incarnation_idx, COUNT(e.event_ts) AS events_count
  FROM spans s LEFT JOIN cev e ON e.cluster_name = s.cluster_name AND e.event_ts BETWEEN s.span_start_ts AND s.span_end_ts GROUP BY 1, 2),
used AS (
  SELECT cluster_name, SUM(ws) / SUM(secs) AS mean_w, MAX(least_w) AS least_w, MAX(most_w) AS most_w
  FROM (SELECT cluster_name, incarnation_idx, SUM(workers * seg_seconds) AS ws, SUM(seg_seconds) AS secs, MIN(workers) AS least_w, MAX(workers) AS most_w
        FROM seg2 GROUP BY 1, 2) GROUP BY 1),
total AS (SELECT cluster_name, SUM(total_cost_eur) AS cost, bool_or(cluster_name IN (SELECT cluster_name FROM synth)) AS made FROM inc GROUP BY 1)
SELECT g.cluster_name, 'e2-standard-8' AS worker_machine_type, ROUND({PRICE}, 6) AS worker_hourly_eur, ROUND(u.mean_w, 6) AS real_used_avg_num_of_workers,
       CAST(u.least_w AS INTEGER) AS real_used_min_workers, CAST(u.most_w AS INTEGER) AS real_used_max_workers, ROUND(t.cost, 6) AS total_cost_eur,
       t.made AS has_synthetic_span, CAST(p.pos AS INTEGER) AS incarnation_pos, CAST(i.incarnation_idx AS INTEGER) AS idx, ROUND(i.span_minutes, 6) AS span_minutes,
       ROUND(i.total_cost_eur, 6) AS span_cost_eur, t.made AS synthetic_span, h.events_count,
       CAST(row_number() OVER (PARTITION BY g.cluster_name, g.incarnation_idx ORDER BY g.from_ts, g.to_ts) - 1 AS INTEGER) AS interval_pos,
       g.from_ts, g.to_ts, g.workers, ROUND(g.seg_seconds, 6) AS seg_seconds, ROUND(g.worker_cost_eur + g.master_cost_eur, 6) AS seg_cost_eur
FROM seg2 g JOIN inc i USING (cluster_name, incarnation_idx) JOIN held h USING (cluster_name, incarnation_idx) JOIN used u USING (cluster_name)
JOIN total t USING (cluster_name)
JOIN (SELECT cluster_name, incarnation_idx, row_number() OVER (PARTITION BY cluster_name ORDER BY incarnation_idx) - 1 AS pos FROM spans) p USING (cluster_name, incarnation_idx)"""

EVOLVED_CLUSTERS = f"""WITH e AS ({EVOLVED}), p AS ({MASTER_PROMOTION}), s AS ({CLUSTER_SUMMARY}), o AS (
  SELECT cluster_name, eviction_description AS diagnostic_reason FROM (
    {"WITH " + ", ".join([B14_CTES, "cur_x AS (SELECT * FROM b14 WHERE timestamp >= TIMESTAMP '2024-01-16')", _signals("cur", "cur_x")])} SELECT * FROM cur) WHERE eviction_count > 0),
g AS (
  SELECT cluster_name, any_value(cluster_action) AS cluster_action, COUNT(*) AS recipes, COUNT(keptWithoutCurrentDate) AS kept_recipes,
         COUNT(appliedMemoryHeapBoostFactor) AS heaps, string_agg(recipe_filename, ';' ORDER BY recipe_filename) FILTER (appliedMemoryHeapBoostFactor IS NOT NULL) AS heap_names,
         COUNT(appliedExecutorScaleFactor) AS scales, string_agg(recipe_filename, ';' ORDER BY recipe_filename) FILTER (appliedExecutorScaleFactor IS NOT NULL) AS scale_names
  FROM e GROUP BY 1)
SELECT g.cluster_name, cluster_action, recipes, kept_recipes, p.promoted_master, p.reason AS promotion_reason, p.state AS promotion_state,
       CASE WHEN o.cluster_name IS NOT NULL THEN 8 END AS driver_memory_gb, CASE WHEN o.cluster_name IS NOT NULL THEN 4 END AS driver_cores,
       CASE WHEN o.cluster_name IS NOT NULL THEN 2 END AS driver_memory_overhead_gb, o.diagnostic_reason,
       heaps AS "boostedMemoryHeapJobCount", heap_names AS "boostedMemoryHeapJobList", scales AS "scaledMaxExecutorsJobCount", scale_names AS "scaledMaxExecutorsJobList",
       s.total_active_minutes AS wall_clock_minutes, s.estimated_cost_eur
FROM g LEFT JOIN p USING (cluster_name) LEFT JOIN o USING (cluster_name) LEFT JOIN s USING (cluster_name)"""


CONFIG_INTEGRITY = "WITH " + ",\n".join(CTES) + """
SELECT 'recipe_without_config' AS check_name, r.cluster_name, COUNT(*) AS violations
FROM runs r LEFT JOIN cfg c ON c.cluster_name = r.cluster_name AND c.recipe_filename = r.recipe_filename WHERE c.cluster_name IS NULL GROUP BY 2
UNION ALL
SELECT 'duplicate_recipe', cluster_name, COUNT(*) FROM cfg
WHERE CAST(regexp_extract(recipe_filename, '_RECIPE_(\\d+)', 1) AS BIGINT) % 9 = 0 GROUP BY 2"""

RUN_SUMMARY_BOOSTS = f"""WITH {WINDOWS}
SELECT 'trend' AS section, trend AS label, COUNT(*) AS n FROM trends GROUP BY 2
UNION ALL SELECT 'action', action, COUNT(*) FROM decisions GROUP BY 2
UNION ALL SELECT 'boost', state, COUNT(*) FROM heap GROUP BY 2"""


def document_sql() -> dict[str, str]:
    return {"snapshot_store": SNAPSHOT_STORE, "runs_index": RUNS_INDEX, "stored_b13_metrics": B13, "stored_b14_nonzero_exits": B14,
            "stored_b20_incarnations": B20, "heap_boost_chain": HEAP_BOOST_CHAIN, "heap_boost_single": HEAP_BOOST_SINGLE,
            "prioritised_signals": PRIORITISED, "unresolved_signals": UNRESOLVED, "divergence_report": ZSCORE_DELTA,
            "analysis_document": ANALYSIS, "boosted_documents": BOOSTED_DOCUMENTS, "content_diff": CONTENT_DIFF, "path_diff": PATH_DIFF,
            "config_integrity": CONFIG_INTEGRITY, "run_summary_boosts": RUN_SUMMARY_BOOSTS,
            "cost_documents": COST_DOCUMENTS, "evolved_clusters": EVOLVED_CLUSTERS}

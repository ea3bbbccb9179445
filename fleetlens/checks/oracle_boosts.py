"""Oracle SQL for signal resolution and the heap-boost lifecycle.

Signals: the b16 query (latest driver log per job is a heap OOM) split into the
current (days 16-30) and reference (days 1-15) windows.  Configs: the deployed
recipe configs of the reference window (binding rule), tagged when the
reference window had an OOM for the recipe.
"""

from __future__ import annotations

from .oracle import B16, BASE, ERR
from .oracle_snapshots import snapshot_ctes
from .oracle import CAPACITY

_b16_body = B16[len("WITH "):B16.rindex("\nSELECT d.job_id")]
_b16_select = B16[B16.rindex("\nSELECT d.job_id"):]

CTES = [_b16_body, "b16 AS (" + _b16_select + ")", CAPACITY,
        snapshot_ctes("r_"),
        """sig AS (SELECT job_id, cluster_name, recipe_filename, latest_driver_log_ts FROM b16),
cur_sig AS (SELECT * FROM sig WHERE latest_driver_log_ts >= TIMESTAMP '2024-01-16'),
ref_sig AS (SELECT * FROM sig WHERE latest_driver_log_ts < TIMESTAMP '2024-01-16'),
cfg AS (
  SELECT m.cluster_name, m.recipe_filename,
         CAST(8 + 4 * (uid % 3) AS VARCHAR) || 'g' AS mem,
         uid % 4 = 0 AS manual,
         CAST(GREATEST(2, CEIL(m.avg_executors_per_job)) AS INTEGER) AS mn,
         CAST(GREATEST(GREATEST(2, CEIL(m.avg_executors_per_job)) + 1, CEIL(m.p95_run_max_executors)) AS INTEGER) AS mx,
         CAST(GREATEST(1, CEIL(m.p95_run_max_executors)) AS INTEGER) AS inst,
         CASE WHEN EXISTS (SELECT 1 FROM ref_sig r WHERE r.cluster_name = m.cluster_name
                           AND r.recipe_filename = m.recipe_filename) THEN 1.5 END AS prior
  FROM (SELECT *, CAST(regexp_extract(recipe_filename, '_RECIPE_(\\d+)', 1) AS BIGINT) AS uid FROM r_m) m),
anys AS (SELECT DISTINCT cluster_name, recipe_filename FROM sig),
curs AS (SELECT DISTINCT cluster_name, recipe_filename FROM cur_sig),
life AS (
  SELECT c.*,
         CASE WHEN c.prior IS NULL AND cu.recipe_filename IS NOT NULL THEN 'new'
              WHEN c.prior IS NOT NULL AND cu.recipe_filename IS NOT NULL THEN 're-boost'
              WHEN c.prior IS NOT NULL THEN 'holding'
              WHEN a.recipe_filename IS NOT NULL THEN 'new' END AS state
  FROM cfg c
  LEFT JOIN anys a ON a.cluster_name = c.cluster_name AND a.recipe_filename = c.recipe_filename
  LEFT JOIN curs cu ON cu.cluster_name = c.cluster_name AND cu.recipe_filename = c.recipe_filename),
heap AS (
  SELECT cluster_name, recipe_filename, mem AS original_memory,
         CASE WHEN state = 'holding' THEN mem
              ELSE CAST(CAST(CEIL(CAST(replace(mem, 'g', '') AS INTEGER) * 1.5) AS BIGINT) AS VARCHAR) || 'g' END
           AS boosted_memory,
         1.5 AS boost_factor,
         CASE WHEN state = 're-boost' THEN prior * 1.5 WHEN state = 'holding' THEN prior ELSE 1.5 END
           AS cumulative_factor,
         state, manual, mn, mx, inst, prior
  FROM life WHERE state IS NOT NULL)"""]


def _with() -> str:
    return "WITH " + ",\n".join(CTES) + "\n"


HEAP_BOOST_STATE = _with() + """SELECT cluster_name, recipe_filename, original_memory, boosted_memory,
  boost_factor, ROUND(cumulative_factor, 6) AS cumulative_factor, state FROM heap"""

HEAP_BOOST_COUNTERS = _with() + """SELECT cluster_name, COUNT(DISTINCT recipe_filename) AS boostedMemoryHeapJobCount,
  list_sort(list(DISTINCT recipe_filename)) AS boostedMemoryHeapJobList,
  SUM(CASE WHEN state = 'new' THEN 1 ELSE 0 END) AS new_count,
  SUM(CASE WHEN state = 're-boost' THEN 1 ELSE 0 END) AS reboost_count,
  SUM(CASE WHEN state = 'holding' THEN 1 ELSE 0 END) AS holding_count
FROM heap GROUP BY cluster_name"""

SIGNAL_RESOLUTION = _with() + """, s AS (
  SELECT *, regexp_replace(job_id, '-\\d{8}-\\d{4}$', '') AS prefix,
         NULLIF(trim(COALESCE(recipe_filename, '')), '') AS given FROM sig),
sib AS (SELECT cluster_name, prefix, MAX(given) AS sibling FROM s WHERE given IS NOT NULL GROUP BY 1, 2),
names AS (SELECT cluster_name, MIN(recipe_filename) AS derived,
                 upper(regexp_replace(regexp_replace(recipe_filename, '^_', ''), '\\.json$', '')) AS norm
          FROM cfg GROUP BY cluster_name, norm)
SELECT s.job_id, s.cluster_name, s.latest_driver_log_ts,
       COALESCE(s.given, b.sibling, n.derived) AS recipe_filename,
       COALESCE(s.given, b.sibling, n.derived) IS NOT NULL AS resolved,
       CASE WHEN s.given IS NOT NULL THEN 'given' WHEN b.sibling IS NOT NULL THEN 'sibling'
            WHEN n.derived IS NOT NULL THEN 'derived' ELSE 'none' END AS resolution
FROM s LEFT JOIN sib b ON b.cluster_name = s.cluster_name AND b.prefix = s.prefix
LEFT JOIN names n ON n.cluster_name = s.cluster_name AND n.norm = upper(replace(s.prefix, '-', '_'))"""

BOOSTED_CONFIGS = _with() + """, j AS (
  SELECT c.*, h.boosted_memory, h.cumulative_factor, h.state AS hstate,
         h.state IS NOT NULL AND h.state <> 'holding' AND h.original_memory <> h.boosted_memory AS change
  FROM cfg c LEFT JOIN heap h USING (cluster_name, recipe_filename))
SELECT cluster_name, recipe_filename,
       CASE WHEN change THEN boosted_memory ELSE mem END AS executor_memory,
       CASE WHEN manual THEN inst ELSE mn END AS min_executors,
       CASE WHEN manual THEN inst ELSE mx END AS max_executors,
       CAST(CASE WHEN manual THEN inst ELSE mn END
            * CAST(replace(CASE WHEN change THEN boosted_memory ELSE mem END, 'g', '') AS INTEGER) AS INTEGER)
         AS total_executor_minimum_allocated_memory_gb,
       CAST(CASE WHEN manual THEN inst ELSE mx END
            * CAST(replace(CASE WHEN change THEN boosted_memory ELSE mem END, 'g', '') AS INTEGER) AS INTEGER)
         AS total_executor_maximum_allocated_memory_gb,
       CASE WHEN hstate IS NOT NULL THEN CAST(CAST(cumulative_factor AS DOUBLE) AS VARCHAR)
            WHEN prior IS NOT NULL THEN '1.5' END AS appliedMemoryHeapBoostFactor,
       CAST(NULL AS VARCHAR) AS appliedExecutorScaleFactor, CAST(NULL AS VARCHAR) AS lastTunedDate,
       CAST(NULL AS VARCHAR) AS keptWithoutCurrentDate
FROM j"""


def _touching(p: str, other: str, configs: str = "cfg") -> str:
    """{p}touch: dynamic recipes of both windows, long-running in window p and at half their ceiling or more."""
    return f"""{p}dur AS (
  SELECT cluster_name, recipe_filename, p95_run_max_executors AS peak, unnest(['avg', 'p95']) AS what,
         unnest([avg_job_duration_ms, p95_job_duration_ms]) AS v FROM {p}m),
{p}far AS (
  SELECT *, (v - AVG(v) OVER w) / NULLIF(STDDEV_POP(v) OVER w, 0) AS far FROM {p}dur WINDOW w AS (PARTITION BY what)),
{p}touch AS (
  SELECT DISTINCT d.cluster_name, d.recipe_filename
  FROM {p}far d JOIN {other}m o USING (cluster_name, recipe_filename) JOIN {configs} c USING (cluster_name, recipe_filename)
  WHERE d.far >= 3 AND NOT c.manual AND d.peak / c.mx >= 0.5)"""


SCALE_BOOST_STATE = "WITH " + ",\n".join([*CTES, snapshot_ctes("c_"), _touching("r_", "c_"), _touching("c_", "r_")]) + """
SELECT c.cluster_name, c.recipe_filename, c.mx AS original_max_executors,
       CAST(CASE WHEN now.cluster_name IS NULL THEN c.mx ELSE GREATEST(c.mx + 1, CEIL(c.mx * 1.5)) END AS INTEGER)
         AS boosted_max_executors,
       1.5 AS boost_factor,
       CASE WHEN old.cluster_name IS NOT NULL AND now.cluster_name IS NOT NULL THEN 2.25 ELSE 1.5 END AS cumulative_factor,
       CASE WHEN now.cluster_name IS NULL THEN 'holding' WHEN old.cluster_name IS NULL THEN 'new' ELSE 're-boost' END AS state
FROM cfg c LEFT JOIN r_touch old USING (cluster_name, recipe_filename)
LEFT JOIN c_touch now USING (cluster_name, recipe_filename)
WHERE old.cluster_name IS NOT NULL OR now.cluster_name IS NOT NULL"""


def boost_sql() -> dict[str, str]:
    return {"heap_boost_state": HEAP_BOOST_STATE, "heap_boost_counters": HEAP_BOOST_COUNTERS,
            "signal_resolution": SIGNAL_RESOLUTION, "boosted_configs": BOOSTED_CONFIGS,
            "scale_boost_state": SCALE_BOOST_STATE}

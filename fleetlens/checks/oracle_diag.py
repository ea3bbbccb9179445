"""Oracle SQL for exit-code diagnostics and master promotion."""

from __future__ import annotations

from ..binding import DEPLOYED_MASTERS, FRESH_MASTER
from ..plans.catalog import catalog_rows
from .oracle import B14, BASE, ERR

_b14_body = B14[len("WITH "):B14.rindex('\nSELECT "timestamp"')]
B14_CTES = _b14_body + """,
b14 AS (SELECT "timestamp", job_id, cluster_name, CAST(driver_exit_code AS INTEGER) AS driver_exit_code
        FROM parsed WHERE job_id IS NOT NULL AND driver_exit_code IS NOT NULL AND driver_exit_code != 0)"""


def _signals(name: str, src: str) -> str:
    return f"""{name}_ev AS (SELECT * FROM {src} WHERE driver_exit_code = 247),
{name}_jobs AS (
  SELECT cluster_name, COUNT(*) AS evicted_jobs,
         list(job_id ORDER BY last_ts DESC, job_id ASC)[1:3] AS sample_jobs, list(job_id ORDER BY job_id) AS jobs
  FROM (SELECT cluster_name, job_id, MAX("timestamp") AS last_ts FROM {name}_ev GROUP BY cluster_name, job_id)
  GROUP BY cluster_name),
{name}_evc AS (SELECT cluster_name, COUNT(*) AS eviction_count FROM {name}_ev GROUP BY cluster_name),
{name}_dom AS (
  SELECT cluster_name, driver_exit_code, n FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_name ORDER BY n DESC, driver_exit_code ASC) AS rn
    FROM (SELECT cluster_name, driver_exit_code, COUNT(*) AS n FROM {src}
          WHERE driver_exit_code <> 247 GROUP BY cluster_name, driver_exit_code)) WHERE rn = 1),
{name} AS (
  SELECT COALESCE(e.cluster_name, d.cluster_name) AS cluster_name,
         COALESCE(e.eviction_count, 0) AS eviction_count, COALESCE(e.evicted_jobs, 0) AS evicted_jobs,
         e.sample_jobs, e.jobs,
         'YARN driver evicted ' || CAST(e.eviction_count AS VARCHAR) || ' time(s) (exit 247). Sample jobs: '
           || array_to_string(e.sample_jobs, ', ') AS eviction_description,
         d.driver_exit_code AS dominant_exit_code, d.n AS dominant_count,
         'Non-zero exit code ' || CAST(d.driver_exit_code AS VARCHAR) || ' occurred ' || CAST(d.n AS VARCHAR)
           || ' time(s)' AS pattern_description
  FROM (SELECT * FROM {name}_evc JOIN {name}_jobs USING (cluster_name)) e
  FULL OUTER JOIN {name}_dom d ON e.cluster_name = d.cluster_name)"""


EXIT_SIGNALS = "WITH " + ",\n".join([B14_CTES, _signals("sig", "b14")]) + "\nSELECT * FROM sig"

DRIVER_OVERRIDES = "WITH " + ",\n".join([B14_CTES, _signals("sig", "b14")]) + """
SELECT cluster_name, 8 AS driver_memory_gb, 4 AS driver_cores, 2 AS driver_memory_overhead_gb,
       eviction_description AS diagnostic_reason
FROM sig WHERE eviction_count > 0"""

_values = ",\n    ".join(f"({i}, '{n}', '{f}', '{v}', {c}, {m})" for i, n, f, v, c, m in catalog_rows())
LADDER = f"""cat AS (
  SELECT * FROM (VALUES
    {_values}) t(idx, machine_type, family, variant, cores, memory_gb)),
step1 AS (
  SELECT c.machine_type, t.machine_type AS variant_step FROM cat c JOIN cat t
    ON t.machine_type = c.family || '-' || CASE c.variant WHEN 'highcpu' THEN 'standard'
                                                           WHEN 'standard' THEN 'highmem' END
                       || '-' || CAST(c.cores AS VARCHAR)),
step2 AS (
  SELECT a.machine_type, arg_min(b.machine_type, b.cores) AS core_step FROM cat a JOIN cat b
    ON a.family = b.family AND a.variant = b.variant AND b.cores > a.cores
  GROUP BY a.machine_type),
fam AS (
  SELECT c.machine_type, COALESCE(t1.machine_type, t2.machine_type) AS family_step FROM cat c
  LEFT JOIN cat t1 ON t1.machine_type = 'n2-' || c.variant || '-' || CAST(c.cores AS VARCHAR)
  LEFT JOIN cat t2 ON t2.machine_type = 'n2-standard-' || CAST(c.cores AS VARCHAR)
  WHERE c.family = 'e2'),
ladder AS (
  SELECT c.machine_type, c.memory_gb,
         COALESCE(s1.variant_step, s2.core_step, f.family_step, c.machine_type) AS promoted
  FROM cat c LEFT JOIN step1 s1 USING (machine_type) LEFT JOIN step2 s2 USING (machine_type)
  LEFT JOIN fam f USING (machine_type))"""

_masters = "[" + ", ".join(f"'{m}'" for m in DEPLOYED_MASTERS) + "]"
MASTER_PROMOTION = "WITH " + ",\n".join([
    B14_CTES,
    "cur_x AS (SELECT * FROM b14 WHERE \"timestamp\" >= TIMESTAMP '2024-01-16')",
    "ref_x AS (SELECT * FROM b14 WHERE \"timestamp\" < TIMESTAMP '2024-01-16')",
    _signals("cur", "cur_x"), _signals("ref", "ref_x"), LADDER,
    f"""masters AS (
  SELECT cluster_name,
         {_masters}[CAST(regexp_extract(cluster_name, 'cluster-(\\d+)', 1) AS INTEGER) + 1] AS reference_master,
         '{FRESH_MASTER}' AS fresh_master,
         cluster_name IN (SELECT cluster_name FROM ref_x WHERE driver_exit_code = 247) AS has_promotion_tag
  FROM (SELECT cluster_name FROM cur_x UNION SELECT cluster_name FROM ref_x)),
j AS (
  SELECT m.*, NULLIF(c.eviction_count, 0) AS cur_n, c.cluster_name IS NOT NULL AS cur_any, r.eviction_count AS ref_n,
         CASE WHEN lr.memory_gb IS NOT NULL AND lr.memory_gb >= lf.memory_gb THEN m.reference_master
              ELSE m.fresh_master END AS baseline_master
  FROM masters m
  LEFT JOIN ladder lr ON lr.machine_type = m.reference_master
  LEFT JOIN ladder lf ON lf.machine_type = m.fresh_master
  LEFT JOIN cur c USING (cluster_name)
  LEFT JOIN ref r USING (cluster_name)),
k AS (SELECT j.*, COALESCE(l.promoted, j.baseline_master) AS promoted FROM j
      LEFT JOIN ladder l ON l.machine_type = j.baseline_master)"""]) + """
SELECT cluster_name, baseline_master,
       CASE WHEN cur_n IS NOT NULL THEN promoted END AS promoted_master,
       CASE WHEN cur_n IS NULL THEN NULL
            WHEN ref_n IS NOT NULL THEN 'Persistent b14 driver eviction (247): ' || CAST(ref_n AS VARCHAR)
                 || ' (ref) -> ' || CAST(cur_n AS VARCHAR) || ' (cur). Promoted ' || baseline_master || ' -> ' || promoted
            ELSE 'Current-date b14 driver eviction (247). Promoted ' || baseline_master || ' -> ' || promoted END
         AS reason,
       CASE WHEN cur_n IS NOT NULL AND has_promotion_tag THEN 're-boost' WHEN cur_n IS NOT NULL THEN 'new'
            WHEN has_promotion_tag AND NOT cur_any THEN 'holding' END AS state,
       COALESCE(ref_n, 0) AS reference_evictions, COALESCE(cur_n, 0) AS current_evictions
FROM k WHERE cur_n IS NOT NULL OR (has_promotion_tag AND NOT cur_any)"""


def diagnostics_sql() -> dict[str, str]:
    return {"exit_signals": EXIT_SIGNALS, "driver_overrides": DRIVER_OVERRIDES,
            "master_promotion": MASTER_PROMOTION}

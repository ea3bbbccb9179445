"""Oracle SQL for the quota fold (P7) as a recursive CTE, and the roll-ups of
the plans it produces.  The Spark side is a fold over compact rows per scenario; here the
same admission rule runs one cluster per recursion step: the candidate order
(pool tier, score + quota pressure, family priority, catalogue order) picks
within quota first, then within the hard constraints, then anything.
"""

from __future__ import annotations

from .oracle import B13_CTES
from .oracle_cost import COST_CTES
from .oracle_sizing import STRATEGY_RULES, candidate_ctes, score

# Cores per machine family that one scenario may use.
QUOTAS = {"e2": 5000, "n2": 5000, "n2d": 3000, "c3": 500, "c4": 500, "n4": 500, "n4d": 500}
q = QUOTAS
admission = """,
ord AS (SELECT cluster_name, ROW_NUMBER() OVER (ORDER BY ADMISSION_ORDER) AS n
        FROM (SELECT DISTINCT cluster_name, demand FROM scored)),
cand_n AS (SELECT s.*, o.n FROM scored s JOIN ord o USING (cluster_name)),
fold AS (
  SELECT 0 AS step, 0 AS u_e2, 0 AS u_n2, 0 AS u_n2d, 0 AS u_c3, 0 AS u_c4, 0 AS k_c3, 0 AS k_c4,
         CAST(NULL AS VARCHAR) AS cluster_name, CAST(NULL AS VARCHAR) AS machine_type, CAST(NULL AS INTEGER) AS workers,
         CAST(NULL AS INTEGER) AS executors_per_worker, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS pool
  UNION ALL
  SELECT f.step + 1,
         f.u_e2 + CASE WHEN p.family = 'e2' THEN p.cores * p.workers ELSE 0 END,
         f.u_n2 + CASE WHEN p.family = 'n2' THEN p.cores * p.workers ELSE 0 END,
         f.u_n2d + CASE WHEN p.family = 'n2d' THEN p.cores * p.workers ELSE 0 END,
         f.u_c3 + CASE WHEN p.family = 'c3' THEN p.cores * p.workers ELSE 0 END,
         f.u_c4 + CASE WHEN p.family = 'c4' THEN p.cores * p.workers ELSE 0 END,
         f.k_c3 + CASE WHEN p.family = 'c3' THEN 1 ELSE 0 END,
         f.k_c4 + CASE WHEN p.family = 'c4' THEN 1 ELSE 0 END,
         p.cluster_name, p.machine_type, p.workers, p.executors_per_worker, p.score, p.pool
  FROM fold f,
  LATERAL (
    SELECT * FROM (
      SELECT c.*, t.score, t.tier,
             CASE t.tier WHEN 0 THEN 'within_quota' WHEN 1 THEN 'hard_constraints' ELSE 'all' END AS pool
      FROM cand_n c,
      LATERAL (SELECT
          c.base_score + 0.2 * (CASE c.family WHEN 'e2' THEN f.u_e2 / QE2 WHEN 'n2' THEN f.u_n2 / QN2
                                               WHEN 'n2d' THEN f.u_n2d / QN2D WHEN 'c3' THEN f.u_c3 / QC3
                                               WHEN 'c4' THEN f.u_c4 / QC4 ELSE 0.0 END) AS score,
          CASE WHEN (c.family = 'c3' AND f.k_c3 >= 1) OR (c.family = 'c4' AND f.k_c4 >= 1) THEN 2
               WHEN (CASE c.family WHEN 'e2' THEN f.u_e2 WHEN 'n2' THEN f.u_n2 WHEN 'n2d' THEN f.u_n2d
                                  WHEN 'c3' THEN f.u_c3 ELSE f.u_c4 END) + c.cores * c.workers
                    <= (CASE c.family WHEN 'e2' THEN QE2 WHEN 'n2' THEN QN2 WHEN 'n2d' THEN QN2D
                                      WHEN 'c3' THEN QC3 ELSE QC4 END) THEN 0
               ELSE 1 END AS tier) t
      WHERE c.n = f.step + 1)
    ORDER BY tier, score, family_priority, catalog_idx LIMIT 1) p
  WHERE f.step < (SELECT MAX(n) FROM ord))"""
for k, v in {"QE2": q["e2"], "QN2D": q["n2d"], "QN2": q["n2"], "QC3": q["c3"], "QC4": q["c4"]}.items():
    admission = admission.replace(k, f"{float(v)}")


def fold(strategy: str, metrics: tuple[str, ...] = tuple(B13_CTES), order: str = "demand DESC, cluster_name") -> str:
    rule = STRATEGY_RULES[strategy]
    return f"""WITH RECURSIVE {candidate_ctes(rule, metrics)},
scored AS (
  SELECT cluster_name, demand, catalog_idx, machine_type, family, cores, family_priority,
         CAST(executors_per_worker AS INTEGER) AS executors_per_worker, workers,
         {score(rule)} AS base_score
  FROM ev4){admission.replace("ADMISSION_ORDER", order)},
plans AS (
  SELECT '{strategy}' AS scenario, CAST(step - 1 AS INTEGER) AS plan_order, cluster_name,
         machine_type AS worker_machine_type, machine_type AS master_machine_type, workers,
         executors_per_worker, workers * executors_per_worker AS max_executors_supported, score, pool,
         CAST(split_part(machine_type, '-', 3) AS INTEGER) AS cores, split_part(machine_type, '-', 1) AS family
  FROM fold WHERE step > 0),
ceil_w AS (SELECT *, CASE WHEN workers <= 4 THEN 4 WHEN workers <= 6 THEN 6 WHEN workers <= 8 THEN 8
                          WHEN workers <= 10 THEN 10 ELSE workers END AS ceiling FROM plans)
"""


FOLD = fold("default")


def cluster_plan(strategy: str) -> str:
    return fold(strategy) + """SELECT scenario, plan_order, cluster_name, worker_machine_type, master_machine_type, workers,
  executors_per_worker, max_executors_supported, ROUND(score, 6) AS score, pool FROM plans"""


CLUSTER_PLAN = cluster_plan("default")
STRATEGY_PLANS = "\nUNION ALL\n".join(f"SELECT * FROM ({cluster_plan(name)})" for name in STRATEGY_RULES)

GENERATION_ENTRIES = FOLD + """SELECT scenario, cluster_name, worker_machine_type, family AS worker_family,
  workers AS num_workers, ceiling AS max_workers_from_policy, workers * cores AS total_cores,
  ceiling * cores AS max_total_cores, 'cost_performance_balance' AS bias_mode, '8cx1GBpc' AS topology
FROM ceil_w"""

MACHINE_ROLLUP = FOLD + """SELECT worker_machine_type AS machine_type, SUM(workers) AS estimated_max_no_of_workers,
  SUM(workers) * MAX(cores) AS estimated_max_no_of_cores, SUM(ceiling) AS real_max_no_of_workers,
  SUM(ceiling) * MAX(cores) AS real_max_no_of_cores,
  array_to_string(list_sort(list(DISTINCT cluster_name)), ';') AS clusters_list
FROM ceil_w GROUP BY worker_machine_type"""

_quota_rows = ", ".join(f"('{f}', {v})" for f, v in sorted(QUOTAS.items()))
QUOTA_USAGE = FOLD + f""", used AS (SELECT family, SUM(workers * cores) AS used_cores FROM plans GROUP BY family),
quota AS (SELECT * FROM (VALUES {_quota_rows}) t(family, quota_cores))
SELECT q.family, COALESCE(u.used_cores, 0) AS used_cores, q.quota_cores,
  ROUND(CASE WHEN q.quota_cores > 0 THEN COALESCE(u.used_cores, 0) * 100.0 / q.quota_cores ELSE 0.0 END, 6)
    AS pct_used
FROM quota q LEFT JOIN used u USING (family)"""

GENERATION_TOTALS = FOLD + """SELECT COUNT(*) AS total_clusters, SUM(workers + 1) AS total_predicted_nodes,
  SUM(ceiling + 1) AS total_max_nodes FROM ceil_w"""




RECIPE_CTES = """, m AS (
  SELECT b.cluster_name, b.recipe_filename,
         COALESCE(CAST(b.avg_executors_per_job AS DOUBLE), 1.0) AS avg_e,
         COALESCE(CAST(b.p95_run_max_executors AS DOUBLE), 1.0) AS p95_e,
         b.fraction_reaching_cap AS frac,
         p.workers, p.max_executors_supported AS sup, p.cores AS w_cores,
         split_part(p.worker_machine_type, '-', 2) AS variant, c.memory_gb AS w_mem
  FROM b13 b JOIN plans p USING (cluster_name) JOIN cand c ON c.machine_type = p.worker_machine_type),
mm AS (
  SELECT *, CASE variant WHEN 'highcpu' THEN 1 WHEN 'highmem' THEN 4 ELSE 2 END * 8 AS mem_base FROM m),
mem AS (
  SELECT *, FLOOR(GREATEST(1.0, GREATEST(1.0, w_mem - 4) - GREATEST(0.384, mem_base * 0.10))) AS max_allowed FROM mm),
rec AS (
  SELECT *, CAST(GREATEST(1, LEAST(GREATEST(8, LEAST(mem_base, max_allowed)), LEAST(max_allowed, 32))) AS INTEGER)
    AS exec_mem FROM mem)
"""

PLAN_RECIPES = FOLD + RECIPE_CTES

MANUAL_PLAN = PLAN_RECIPES + """SELECT cluster_name, recipe_filename,
  CAST(GREATEST(1, LEAST(CEIL(CASE WHEN frac >= 0.30 THEN p95_e * 1.2 ELSE p95_e END), sup)) AS INTEGER)
    AS spark_executor_instances,
  8 AS spark_executor_cores, exec_mem AS spark_executor_memory_gb
FROM rec"""

DA_SELECT = """, d AS (
  SELECT *, CAST(GREATEST(2, GREATEST(1, CEIL(avg_e))) AS INTEGER) AS mn FROM rec),
d2 AS (SELECT *, CAST(GREATEST(2, LEAST(mn, sup)) AS INTEGER) AS ini FROM d),
d3 AS (SELECT *, CAST(GREATEST(ini, LEAST(CASE WHEN p95_e > mn + 1 THEN CEIL(p95_e) ELSE mn + 1 END, sup))
                      AS INTEGER) AS mx FROM d2)
SELECT cluster_name, recipe_filename, mn AS min_executors, mx AS max_executors, ini AS initial_executors,
  8 AS spark_executor_cores, exec_mem AS spark_executor_memory_gb, mn > mx AS min_exceeds_max
FROM d3"""

DA_PLAN = PLAN_RECIPES + DA_SELECT


def da_plan(metrics: str, order: str = "demand DESC, cluster_name") -> str:
    """The dynamic-allocation plan over a metric table (a query, run inside a larger one)."""
    return fold("default", (f"b13 AS ({metrics})",), order) + RECIPE_CTES + DA_SELECT


CLUSTER_SUMMARY = FOLD + ", homes AS (WITH " + ",\n".join(COST_CTES) + """
  SELECT 'cluster-' || (CAST(regexp_extract(cluster_name, '[0-9]+$') AS BIGINT) % 7) AS cluster_name,
         SUM(span_minutes) AS minutes, SUM(total_cost_eur) AS cost, MAX(least_w) AS least_w, MAX(most_w) AS most_w,
         SUM(ws) / NULLIF(SUM(secs), 0) AS mean_w
  FROM (SELECT i.cluster_name, i.incarnation_idx, ANY_VALUE(i.span_minutes) AS span_minutes,
               ANY_VALUE(i.total_cost_eur) AS total_cost_eur, MIN(g.workers) AS least_w, MAX(g.workers) AS most_w,
               SUM(g.workers * g.seg_seconds) AS ws, SUM(g.seg_seconds) AS secs
        FROM inc i LEFT JOIN seg2 g ON g.cluster_name = i.cluster_name AND g.incarnation_idx = i.incarnation_idx
        GROUP BY i.cluster_name, i.incarnation_idx)
  GROUP BY 1),
jobs AS (SELECT cluster_name, COUNT(*) AS no_of_jobs FROM b13 GROUP BY cluster_name),
dags AS (SELECT 'cluster-' || r_regionkey AS cluster_name, 'dag_' || lower(r_name) AS dag_id FROM region),
timers AS (SELECT 'cluster-' || (r_regionkey + 2) AS cluster_name, 'timer_' || lower(r_name) AS timer_name,
                  '0' || r_regionkey || ':30' AS timer_time FROM region)
SELECT p.cluster_name, COALESCE(d.dag_id, 'UNKNOWN_DAG_ID') AS dag_id, COALESCE(j.no_of_jobs, 0) AS no_of_jobs,
  p.workers AS num_of_workers, p.worker_machine_type, p.master_machine_type,
  ROUND(COALESCE(h.mean_w, 0.0), 6) AS real_used_avg_num_of_workers,
  COALESCE(CAST(h.least_w AS INTEGER), 0) AS real_used_min_workers,
  COALESCE(CAST(h.most_w AS INTEGER), 0) AS real_used_max_workers,
  ROUND(COALESCE(h.minutes, 0.0), 6) AS total_active_minutes, ROUND(COALESCE(h.cost, 0.0), 6) AS estimated_cost_eur,
  COALESCE(t.timer_name, 'ZERO_TIMER') AS timer_name, COALESCE(t.timer_time, '00:00') AS timer_time
FROM plans p LEFT JOIN homes h USING (cluster_name) LEFT JOIN jobs j USING (cluster_name)
LEFT JOIN dags d USING (cluster_name) LEFT JOIN timers t USING (cluster_name)"""

CLUSTER_CONFIG = PLAN_RECIPES + """, man AS (
  SELECT cluster_name,
         CAST(GREATEST(1, LEAST(CEIL(CASE WHEN frac >= 0.30 THEN p95_e * 1.2 ELSE p95_e END), sup)) AS INTEGER)
           * exec_mem AS acc
  FROM rec),
acc AS (SELECT cluster_name, SUM(acc) AS acc, COUNT(*) AS jobs FROM man GROUP BY cluster_name)
SELECT p.cluster_name, p.workers AS num_workers, p.master_machine_type, p.worker_machine_type,
  CASE WHEN p.workers <= 4 THEN 'small-workload-autoscaling' WHEN p.workers <= 6 THEN 'medium-workload-autoscaling'
       WHEN p.workers <= 8 THEN 'large-workload-autoscaling' ELSE 'extra-large-workload-autoscaling' END
    AS autoscaling_policy,
  COALESCE(a.jobs, 0) AS total_no_of_jobs, p.workers * c.memory_gb AS cluster_max_total_memory_gb,
  p.workers * p.cores AS cluster_max_total_cores, COALESCE(a.acc, 0) AS accumulated_max_total_memory_per_jobs_gb
FROM plans p JOIN cand c ON c.machine_type = p.worker_machine_type LEFT JOIN acc a USING (cluster_name)"""


def fold_sql() -> dict[str, str]:
    return {"cluster_plan": CLUSTER_PLAN, "strategy_plans": STRATEGY_PLANS, "generation_entries": GENERATION_ENTRIES,
            "machine_rollup": MACHINE_ROLLUP, "quota_usage": QUOTA_USAGE,
            "generation_totals": GENERATION_TOTALS, "manual_plan": MANUAL_PLAN, "da_plan": DA_PLAN,
            "cluster_summary_sorted": CLUSTER_SUMMARY, "cluster_config": CLUSTER_CONFIG}

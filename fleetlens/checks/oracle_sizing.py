"""Oracle SQL for the distributed part of sizing: candidate evaluation and score
over the b13 metric table, per strategy."""

from __future__ import annotations

from ..plans.sizing import candidate_shapes
from .oracle import B13_CTES

_cands = ",\n    ".join(f"({i}, '{n}', '{f}', {c}, {m}, CAST({p!r} AS DOUBLE), {pr})"
                       for i, n, f, _v, c, m, p, pr in candidate_shapes())

# Fixed values of the strategies: executor memory (GB), concurrency buffer, the five score weights, preferred
# workers and the penalty of each one beyond them.
STRATEGY_RULES = {
    "default": dict(gb=8, buffer=0.25, cost=0.4, sufficiency=0.5, utilization=0.3, workers=0.3, oversize=0.2, most=6, extra=0.05),
    "cost_biased": dict(gb=8, buffer=0.10, cost=0.7, sufficiency=0.3, utilization=0.2, workers=0.4, oversize=0.3, most=4, extra=0.08),
    "performance_biased": dict(gb=16, buffer=0.40, cost=0.1, sufficiency=0.8, utilization=0.5, workers=0.1, oversize=0.05, most=8, extra=0.02),
}


def score(r: dict) -> str:
    return f"""{r['cost']} * (hourly_cost - cmin) / GREATEST(1e-9, cmax - cmin)
         + {r['workers']} * (workers - wmin) / GREATEST(1e-9, CAST(wmax - wmin AS DOUBLE))
         - {r['sufficiency']} * core_sufficiency - {r['utilization']} * utilization
         + CASE WHEN capacity_shortfall > 0 THEN 100.0 * (capacity_shortfall / req_slots) ELSE 0.0 END
         + CASE WHEN oversize_ratio > 1.5 THEN {r['oversize']} * (oversize_ratio - 1.5) ELSE 0.0 END
         + CASE WHEN cores = 32 THEN -0.10 ELSE 0.0 END"""


def candidate_ctes(r: dict, metrics: tuple[str, ...] = tuple(B13_CTES)) -> str:
    """``metrics``: CTEs that end in b13."""
    return ",\n".join([*metrics, f"""cand AS (
  SELECT * FROM (VALUES
    {_cands}) t(catalog_idx, machine_type, family, cores, memory_gb, price, family_priority)),
demand AS (
  SELECT cluster_name,
         MAX(COALESCE(CAST(p95_run_max_executors AS DOUBLE), 1.0)) * MAX(COALESCE(max_concurrent_jobs, 1)) AS demand,
         GREATEST(1.0, MAX(COALESCE(CAST(p95_run_max_executors AS DOUBLE), 1.0))
                       * MAX(COALESCE(max_concurrent_jobs, 1)) * (1.0 + {r['buffer']})) AS req_slots
  FROM b13 GROUP BY cluster_name),
cev AS (
  SELECT d.*, c.*,
         GREATEST(1, LEAST(FLOOR(c.cores / 8), FLOOR(GREATEST(0.0, c.memory_gb - 4) / ({r['gb']} + GREATEST(0.384, {r['gb']} * 0.10)))))
           AS executors_per_worker
  FROM demand d CROSS JOIN cand c),
ev2 AS (
  SELECT *, CAST(CASE WHEN family IN ('c3', 'c4')
                      THEN LEAST(GREATEST(2, CEIL(req_slots / GREATEST(1, executors_per_worker))), 13)
                      ELSE GREATEST(2, CEIL(req_slots / GREATEST(1, executors_per_worker))) END AS INTEGER) AS workers
  FROM cev),
ev3 AS (
  SELECT *, executors_per_worker * workers AS capacity_slots, cores * workers AS total_cores,
         LEAST(1.0, cores * workers / GREATEST(1.0, 8.0 * req_slots)) AS core_sufficiency,
         LEAST(1.0, 8.0 * req_slots / GREATEST(1.0, cores * workers)) AS utilization,
         (price * workers + price) + CASE WHEN workers > {r['most']} THEN (price * workers + price) * {r['extra']} * (workers - {r['most']})
                                          ELSE 0.0 END AS hourly_cost,
         cores * workers / GREATEST(1.0, 8.0 * req_slots) AS oversize_ratio,
         GREATEST(0.0, req_slots - executors_per_worker * workers) AS capacity_shortfall
  FROM ev2),
ev4 AS (
  SELECT *, MIN(hourly_cost) OVER w AS cmin, MAX(hourly_cost) OVER w AS cmax,
         MIN(workers) OVER w AS wmin, MAX(workers) OVER w AS wmax
  FROM ev3 WINDOW w AS (PARTITION BY cluster_name))"""])


CANDIDATE_SCORES = f"""WITH {candidate_ctes(STRATEGY_RULES['default'])}
SELECT cluster_name, machine_type, ROUND(demand, 6) AS demand, ROUND(req_slots, 6) AS req_slots,
       CAST(executors_per_worker AS INTEGER) AS executors_per_worker, workers,
       CAST(capacity_slots AS INTEGER) AS capacity_slots, total_cores,
       ROUND(core_sufficiency, 6) AS core_sufficiency, ROUND(utilization, 6) AS utilization,
       ROUND(hourly_cost, 6) AS hourly_cost, ROUND({score(STRATEGY_RULES['default'])}, 6) AS base_score
FROM ev4"""


def sizing_sql() -> dict[str, str]:
    return {"candidate_scores": CANDIDATE_SCORES}

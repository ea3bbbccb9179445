"""Oracle SQL for the cost integration queries (spans from b20, events from b21)."""

from __future__ import annotations

from .oracle import AUTOSCALER, EV, LIFECYCLE

PRICE = "0.4032"  # published rates of e2: 8 vCPU at 0.0336 and 32 GB at 0.0042 EUR an hour
FALLBACK = "2.0"
ALIVE_AT = "2024-01-15 12:00:00"

COST_CTES = [EV, LIFECYCLE, AUTOSCALER, f"""cev AS (
  SELECT cluster_name, event_ts, current_primary_workers, target_primary_workers,
         COALESCE(recommendation_id, '') AS tie
  FROM autoscaler
  WHERE upper(trim(state)) = 'RECOMMENDING' AND target_primary_workers IS NOT NULL),
synth AS (
  SELECT cluster_name, 1 AS incarnation_idx, MIN(event_ts) AS span_start_ts, MAX(event_ts) AS span_end_ts
  FROM cev WHERE cluster_name NOT IN (SELECT cluster_name FROM b20)
  GROUP BY cluster_name HAVING COUNT(*) >= 2 AND MAX(event_ts) > MIN(event_ts)),
spans AS (
  SELECT cluster_name, incarnation_idx, span_start_ts, span_end_ts FROM b20
  UNION ALL SELECT * FROM synth),
inside AS (
  SELECT s.*, e.event_ts, e.current_primary_workers, e.target_primary_workers,
         LEAD(e.event_ts) OVER (PARTITION BY s.cluster_name, s.incarnation_idx ORDER BY e.event_ts, e.tie) AS next_ts,
         ROW_NUMBER() OVER (PARTITION BY s.cluster_name, s.incarnation_idx ORDER BY e.event_ts, e.tie) AS rn
  FROM spans s JOIN cev e
    ON e.cluster_name = s.cluster_name AND e.event_ts BETWEEN s.span_start_ts AND s.span_end_ts),
segs AS (
  SELECT cluster_name, incarnation_idx, event_ts AS from_ts, COALESCE(next_ts, span_end_ts) AS to_ts,
         CAST(COALESCE(target_primary_workers, {FALLBACK}) AS DOUBLE) AS workers FROM inside
  UNION ALL
  SELECT cluster_name, incarnation_idx, span_start_ts, event_ts,
         CAST(COALESCE(current_primary_workers, {FALLBACK}) AS DOUBLE) FROM inside WHERE rn = 1
  UNION ALL
  SELECT s.cluster_name, s.incarnation_idx, s.span_start_ts, s.span_end_ts, {FALLBACK} FROM spans s
  WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.cluster_name = s.cluster_name
                                             AND i.incarnation_idx = s.incarnation_idx)),
seg2 AS (
  SELECT *, ((epoch_us(to_ts) // 1000) - (epoch_us(from_ts) // 1000)) / 1000.0 AS seg_seconds,
         {PRICE} * workers * (((epoch_us(to_ts) // 1000) - (epoch_us(from_ts) // 1000)) / 1000.0 / 3600.0) AS worker_cost_eur,
         {PRICE} * (((epoch_us(to_ts) // 1000) - (epoch_us(from_ts) // 1000)) / 1000.0 / 3600.0) AS master_cost_eur
  FROM segs WHERE (epoch_us(to_ts) // 1000) - (epoch_us(from_ts) // 1000) > 0),
inc AS (
  SELECT s.cluster_name, s.incarnation_idx, s.span_start_ts, s.span_end_ts,
         ((epoch_us(s.span_end_ts) // 1000) - (epoch_us(s.span_start_ts) // 1000)) / 60000.0 AS span_minutes,
         COALESCE(SUM(g.workers * g.seg_seconds) / NULLIF(SUM(g.seg_seconds), 0), 0.0) AS avg_workers,
         COALESCE(CAST(MIN(g.workers) AS INTEGER), 0) AS min_workers,
         COALESCE(CAST(MAX(g.workers) AS INTEGER), 0) AS max_workers,
         COALESCE(SUM(g.worker_cost_eur), 0.0) AS worker_cost_eur,
         COALESCE(SUM(g.master_cost_eur), 0.0) AS master_cost_eur,
         COALESCE(SUM(g.worker_cost_eur), 0.0) + COALESCE(SUM(g.master_cost_eur), 0.0) AS total_cost_eur,
         COUNT(g.workers) AS segments
  FROM spans s LEFT JOIN seg2 g ON g.cluster_name = s.cluster_name AND g.incarnation_idx = s.incarnation_idx
  GROUP BY s.cluster_name, s.incarnation_idx, s.span_start_ts, s.span_end_ts),
starts AS (SELECT DISTINCT (epoch_us(from_ts) // 1000) AS ms FROM seg2),
tl AS (
  SELECT s.ms, SUM(g.workers + 1) AS fleet_ips FROM starts s JOIN seg2 g
    ON (epoch_us(g.from_ts) // 1000) <= s.ms AND s.ms < (epoch_us(g.to_ts) // 1000)
  GROUP BY s.ms)"""]


def _with() -> str:
    return "WITH " + ",\n".join(COST_CTES) + "\n"


SPAN_SEGMENTS = _with() + """SELECT cluster_name, incarnation_idx, from_ts, to_ts, workers,
  ROUND(seg_seconds, 6) AS seg_seconds, ROUND(worker_cost_eur, 6) AS worker_cost_eur,
  ROUND(master_cost_eur, 6) AS master_cost_eur FROM seg2"""

INCARNATION_COST = _with() + """SELECT cluster_name, incarnation_idx, span_start_ts, span_end_ts,
  ROUND(span_minutes, 6) AS span_minutes, ROUND(avg_workers, 6) AS avg_workers, min_workers, max_workers,
  ROUND(worker_cost_eur, 6) AS worker_cost_eur, ROUND(master_cost_eur, 6) AS master_cost_eur,
  ROUND(total_cost_eur, 6) AS total_cost_eur, segments FROM inc"""

CLUSTER_COST = _with() + """SELECT cluster_name, COUNT(*) AS incarnations,
  ROUND(SUM(span_minutes), 6) AS wall_clock_minutes, ROUND(SUM(worker_cost_eur), 6) AS worker_cost_eur,
  ROUND(SUM(master_cost_eur), 6) AS master_cost_eur, ROUND(SUM(total_cost_eur), 6) AS estimated_cost_eur
FROM inc GROUP BY cluster_name"""

WORKER_STATS = _with() + """, per_span AS (
  SELECT cluster_name, incarnation_idx, SUM(workers * seg_seconds) AS ws, SUM(seg_seconds) AS s,
         CAST(MIN(workers) AS INTEGER) AS mn, CAST(MAX(workers) AS INTEGER) AS mx
  FROM seg2 GROUP BY cluster_name, incarnation_idx)
SELECT cluster_name, ROUND(COALESCE(SUM(ws) / NULLIF(SUM(s), 0), 0.0), 6) AS avg_workers,
       MAX(mn) AS min_workers, MAX(mx) AS max_workers
FROM per_span GROUP BY cluster_name"""

SYNTHETIC_SPANS = _with() + """SELECT cluster_name, incarnation_idx, span_start_ts, span_end_ts,
  FALSE AS has_explicit_create, FALSE AS has_explicit_delete, TRUE AS synthetic FROM synth"""

ADDRESS_TIMELINE = _with() + "SELECT epoch_ms(ms) AS ts, CAST(fleet_ips AS DOUBLE) AS fleet_ips FROM tl"

ADDRESS_PEAK = _with() + """SELECT epoch_ms(ms) AS peak_ts, CAST(fleet_ips AS DOUBLE) AS peak_ips,
  CASE WHEN fleet_ips >= 256 THEN 'over' WHEN fleet_ips >= 256 * 90 / 100.0 THEN 'crit'
       WHEN fleet_ips >= 256 * 70 / 100.0 THEN 'warn' ELSE '' END AS level
FROM tl ORDER BY fleet_ips DESC, ms ASC LIMIT 1"""

ALIVE = _with() + f""", live AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_name ORDER BY workers DESC, incarnation_idx ASC) AS rn
  FROM seg2
  WHERE (epoch_us(from_ts) // 1000) <= (epoch_us(TIMESTAMP '{ALIVE_AT}') // 1000) AND (epoch_us(TIMESTAMP '{ALIVE_AT}') // 1000) < (epoch_us(to_ts) // 1000))
SELECT cluster_name, incarnation_idx, workers, workers + 1 AS ips FROM live WHERE rn = 1"""


INTEGRITY = _with() + """SELECT 'event_outside_spans' AS check_name, a.cluster_name, COUNT(*) AS violations
FROM autoscaler a
WHERE NOT EXISTS (SELECT 1 FROM b20 s WHERE s.cluster_name = a.cluster_name
                  AND a.event_ts BETWEEN s.span_start_ts AND s.span_end_ts)
GROUP BY a.cluster_name
UNION ALL
SELECT 'target_out_of_bounds', cluster_name, COUNT(*) FROM autoscaler
WHERE target_primary_workers IS NOT NULL
  AND (target_primary_workers < min_primary_workers OR target_primary_workers > max_primary_workers)
GROUP BY cluster_name
UNION ALL
SELECT 'duplicate_incarnation', cluster_name, COUNT(*) FROM (
  SELECT cluster_name, incarnation_idx FROM b20 GROUP BY 1, 2 HAVING COUNT(*) > 1) GROUP BY cluster_name"""


COST_TIMELINE = _with() + """SELECT g.cluster_name, g.incarnation_idx, g.from_ts, g.to_ts, g.workers,
  ROUND(g.seg_seconds, 6) AS seg_seconds, ROUND(g.worker_cost_eur, 6) AS worker_cost_eur,
  ROUND(g.master_cost_eur, 6) AS master_cost_eur, ROUND(g.worker_cost_eur + g.master_cost_eur, 6) AS seg_cost_eur,
  i.span_start_ts, i.span_end_ts, ROUND(i.span_minutes, 6) AS span_minutes,
  ROUND(i.avg_workers, 6) AS span_avg_workers, ROUND(i.total_cost_eur, 6) AS span_total_cost_eur
FROM seg2 g JOIN inc i ON i.cluster_name = g.cluster_name AND i.incarnation_idx = g.incarnation_idx"""


def cost_sql() -> dict[str, str]:
    return {
        "span_segments": SPAN_SEGMENTS, "incarnation_cost": INCARNATION_COST,
        "cluster_cost": CLUSTER_COST, "worker_stats": WORKER_STATS, "synthetic_spans": SYNTHETIC_SPANS,
        "address_timeline": ADDRESS_TIMELINE, "address_peak": ADDRESS_PEAK, "alive_at": ALIVE,
        "integrity_violations": INTEGRITY, "cost_timeline": COST_TIMELINE,
    }

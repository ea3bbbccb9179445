"""Oracle SQL for the event-log queries (running counts, lifecycle) and the streaming window counts."""

from __future__ import annotations

from .oracle import BASE, with_

RUNNING = with_(*BASE, """d AS (
  SELECT cluster_name, recipe_filename, event_id, evt_ts, executor_event,
         CASE WHEN executor_event = 'EXECUTOR_ADDED' THEN 1 ELSE -1 END AS delta
  FROM xev WHERE executor_event IN ('EXECUTOR_ADDED', 'EXECUTOR_REMOVED')),
r AS (
  SELECT *, SUM(delta) OVER (PARTITION BY cluster_name, recipe_filename ORDER BY evt_ts, event_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_executors
  FROM d)""") + """
SELECT cluster_name, recipe_filename, event_id, evt_ts, executor_event, current_executors,
       MAX(current_executors) OVER w AS max_executors_seen, MIN(current_executors) OVER w AS min_executors_seen
FROM r WINDOW w AS (PARTITION BY cluster_name, recipe_filename ORDER BY evt_ts, event_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

LIFECYCLE = with_(*BASE, """st AS (
  SELECT ts AS status_ts, event_id, 'cluster-' || CAST(user_id % 7 AS VARCHAR) AS cluster_name,
         '_RECIPE_' || CAST(user_id AS VARCHAR) || '.json' AS recipe_filename,
         ['SUCCESS', 'FAILED', 'RUNNING'][k % 3 + 1] AS status
  FROM ev WHERE event_type = 'purchase'),
fin AS (
  SELECT run_id, status FROM (
    SELECT r.run_id, s.status,
           ROW_NUMBER() OVER (PARTITION BY r.run_id ORDER BY s.status_ts DESC, CAST(s.event_id AS VARCHAR) DESC) AS rn
    FROM runs r JOIN st s ON s.cluster_name = r.cluster_name AND s.recipe_filename = r.recipe_filename
     AND s.status_ts BETWEEN r.app_start_ts AND r.app_end_ts) WHERE rn = 1)""") + """
SELECT r.cluster_name, r.recipe_filename, r.app_start_ts, r.app_end_ts,
       (epoch_us(r.app_end_ts) - epoch_us(r.app_start_ts)) // 1000 AS app_duration_millis,
       COALESCE(f.status, 'UNKNOWN') AS final_status,
       (epoch_us(r.app_end_ts) - epoch_us(r.app_start_ts)) // 1000 AS uptime_millis
FROM runs r LEFT JOIN fin f USING (run_id)"""

STREAM_COUNTS = with_(*BASE) + """
SELECT date_trunc('day', evt_ts) AS window_start, cluster_name, executor_event, COUNT(*) AS events
FROM xev GROUP BY 1, 2, 3"""


EVENT_LOG_COUNTS = RUNNING.replace("SELECT cluster_name, recipe_filename, event_id, evt_ts, executor_event, current_executors,",
                                    "SELECT cluster_name, recipe_filename, event_id, date_trunc('millisecond', evt_ts) AS evt_ts, executor_event, current_executors,")

# starts in time order with their neighbours: a context's start whose next start is real and near is that start
EVENT_LOG_LIFECYCLE = with_(*BASE, """told AS (
  SELECT cluster_name, recipe_filename, user_id, app_end_ts, (user_id + day(run_date)) % 3 AS how,
         date_trunc('millisecond', app_start_ts) AS ms, to_milliseconds((user_id % 4) * 500) AS wait
  FROM runs),
heard AS (
  SELECT cluster_name, recipe_filename, ms AS ts, 0 AS kind FROM told WHERE how > 0
  UNION SELECT cluster_name, recipe_filename, CASE WHEN how = 2 THEN ms + wait ELSE ms END, 1 FROM told WHERE how <> 1),
near AS (
  SELECT *, lead(ts) OVER o AS next_ts, lead(kind) OVER o AS next_kind, lag(ts) OVER o AS last_ts, lag(kind) OVER o AS last_kind
  FROM heard WINDOW o AS (PARTITION BY cluster_name, recipe_filename ORDER BY ts, kind)),
starts AS (
  SELECT cluster_name, recipe_filename, ts, kind = 0 AS synthetic,
         CASE WHEN kind = 0 THEN ts WHEN last_kind = 0 AND ts - last_ts <= INTERVAL 2 SECOND THEN last_ts END AS context_ts
  FROM near WHERE kind = 1 OR NOT COALESCE(next_kind = 1 AND next_ts - ts <= INTERVAL 2 SECOND, FALSE)),
rows AS (
  SELECT *, 0 AS kind FROM starts
  UNION ALL SELECT cluster_name, recipe_filename, date_trunc('millisecond', app_end_ts), NULL, NULL, 1 FROM told WHERE user_id % 5 <> 4),
ended AS (
  SELECT *, CASE WHEN lead(kind) OVER o = 1 THEN lead(ts) OVER o END AS end_ts
  FROM rows WINDOW o AS (PARTITION BY cluster_name, recipe_filename ORDER BY ts, kind))""") + """
SELECT cluster_name, recipe_filename, ts AS start_ts, context_ts, synthetic, end_ts,
       (epoch_us(end_ts) - epoch_us(ts)) // 1000 AS app_duration_millis, end_ts IS NULL AS running,
       (epoch_us(COALESCE(end_ts, TIMESTAMP '2024-02-01')) - epoch_us(ts)) // 1000 AS uptime_millis
FROM ended WHERE kind = 0"""

# a third of the events arrives after the other: a row is late if the latest event before its file, less two days, is past its window
ONLINE_WINDOWS = with_(*BASE, """clocks AS (
  SELECT p, max(latest) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS before,
         max(latest) OVER () - INTERVAL 2 DAY AS final
  FROM (SELECT event_id % 3 AS p, max(evt_ts) AS latest FROM xev GROUP BY 1)),
placed AS (
  SELECT date_trunc('day', evt_ts) AS window_start, cluster_name, executor_event, final,
         COALESCE(date_trunc('day', evt_ts) + INTERVAL 1 DAY <= before, FALSE) AS late
  FROM xev JOIN clocks ON p = event_id % 3)""") + """
SELECT window_start, cluster_name, executor_event, COUNT(*) FILTER (WHERE NOT late) AS events,
       any_value(window_start + INTERVAL 1 DAY <= final) AS closed, COUNT(*) FILTER (WHERE late) AS late
FROM placed GROUP BY 1, 2, 3"""


def events_sql() -> dict[str, str]:
    return {"executor_running_counts": RUNNING, "stream_executor_counts": RUNNING,
            "app_lifecycle": LIFECYCLE, "stream_counts": STREAM_COUNTS, "event_log_counts": EVENT_LOG_COUNTS,
            "event_log_lifecycle": EVENT_LOG_LIFECYCLE, "online_executor_counts": RUNNING,
            "online_window_counts": ONLINE_WINDOWS}

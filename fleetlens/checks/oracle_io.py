"""Oracle SQL for the individual-table metric merge and input validation."""

from __future__ import annotations

from .oracle import B1, B3, B5, B8, B11, B12

MERGE = f"""WITH b1 AS ({B1}), b12 AS ({B12}), b3 AS ({B3}), b8 AS ({B8}), b5 AS ({B5}), b11 AS ({B11}),
keys AS (SELECT cluster_name, recipe_filename FROM b1 UNION SELECT cluster_name, recipe_filename FROM b12
         UNION SELECT cluster_name, recipe_filename FROM b3 UNION SELECT cluster_name, recipe_filename FROM b8
         UNION SELECT cluster_name, recipe_filename FROM b5)
SELECT k.cluster_name, k.recipe_filename,
       ROUND(COALESCE(CAST(b1.avg_executors_per_job AS DOUBLE), 1.0), 6) AS avg_executors_per_job,
       ROUND(COALESCE(CAST(b12.p95_run_max_executors AS DOUBLE), 1.0), 6) AS p95_run_max_executors,
       ROUND(COALESCE(CAST(b3.avg_job_duration_ms AS DOUBLE), 0.0), 6) AS avg_job_duration_ms,
       ROUND(CASE WHEN b8.cluster_name IS NULL THEN 0.0
                  ELSE COALESCE(CAST(b8.p95_job_duration_ms AS DOUBLE), COALESCE(CAST(b3.avg_job_duration_ms AS DOUBLE), 0.0))
             END, 6) AS p95_job_duration_ms,
       CASE WHEN b12.cluster_name IS NULL THEN 0
            ELSE COALESCE(b12.runs, CASE WHEN b8.cluster_name IS NOT NULL THEN b8.runs ELSE 0 END, 0) END AS runs,
       CAST(NULL AS BIGINT) AS seconds_at_cap, b5.runs_reaching_cap, b5.total_runs,
       ROUND(b5.fraction_reaching_cap, 6) AS fraction_reaching_cap,
       CASE WHEN b11.cluster_name IS NULL THEN 1 ELSE b11.max_concurrent_jobs END AS max_concurrent_jobs
FROM keys k
LEFT JOIN b1 USING (cluster_name, recipe_filename) LEFT JOIN b12 USING (cluster_name, recipe_filename)
LEFT JOIN b3 USING (cluster_name, recipe_filename) LEFT JOIN b8 USING (cluster_name, recipe_filename)
LEFT JOIN b5 USING (cluster_name, recipe_filename) LEFT JOIN b11 ON b11.cluster_name = k.cluster_name"""

VALIDATION = """SELECT 'events' AS table_name, 6 AS expected_columns, 6 AS found_columns, '' AS missing_columns,
       '' AS extra_columns, TRUE AS valid, (SELECT COUNT(*) FROM events) AS row_count
UNION ALL SELECT 'customer', 5, 5, '', '', TRUE, (SELECT COUNT(*) FROM customer)
UNION ALL SELECT 'supplier', 4, 4, '', '', TRUE, (SELECT COUNT(*) FROM supplier)
UNION ALL SELECT 'lineitem', 11, 11, '', '', TRUE, (SELECT COUNT(*) FROM lineitem)"""


def io_sql() -> dict[str, str]:
    return {"metrics_merge_individual": MERGE, "input_validation": VALIDATION}

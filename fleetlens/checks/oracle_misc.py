"""Oracle SQL for table diff, diff counts and name anonymisation."""

from __future__ import annotations

from .oracle import B13_CTES, B14_PARSED, ERR

CUSTOMER_COLS = ["c_acctbal", "c_mktsegment", "c_name", "c_nationkey"]

PERTURBED = """a AS (SELECT * FROM customer),
b AS (
  SELECT c_custkey, c_name, c_nationkey, ROUND(c_acctbal, 0) AS c_acctbal, c_mktsegment
  FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'
  UNION ALL
  SELECT s_suppkey + 1000000000, s_name, s_nationkey, s_acctbal, 'SUPPLIER' FROM supplier),
ka AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS key FROM a),
kb AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS key FROM b),
la AS (""" + "\nUNION ALL\n".join(
    f"SELECT CAST(c_custkey AS VARCHAR) AS key, '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM a" for c in CUSTOMER_COLS) + """),
lb AS (""" + "\nUNION ALL\n".join(
    f"SELECT CAST(c_custkey AS VARCHAR) AS key, '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM b" for c in CUSTOMER_COLS) + """),
diff AS (
  SELECT key, 'only_in_A' AS category, CAST(NULL AS VARCHAR) AS "column", CAST(NULL AS VARCHAR) AS value_A,
         CAST(NULL AS VARCHAR) AS value_B FROM ka WHERE key NOT IN (SELECT key FROM kb)
  UNION ALL
  SELECT key, 'only_in_B', NULL, NULL, NULL FROM kb WHERE key NOT IN (SELECT key FROM ka)
  UNION ALL
  SELECT la.key, 'field_diff', la.col, COALESCE(la.v, ''), COALESCE(lb.v, '')
  FROM la JOIN lb ON la.key = lb.key AND la.col = lb.col
  WHERE COALESCE(la.v, '') <> COALESCE(lb.v, ''))"""

TABLE_DIFF = "WITH " + PERTURBED + "\nSELECT * FROM diff"
DIFF_COUNTS = "WITH " + PERTURBED + "\nSELECT category, COUNT(*) AS n FROM diff GROUP BY category"

ANONYMISE = "WITH " + ",\n".join([*B13_CTES, ERR, B14_PARSED, """b14 AS (
  SELECT cluster_name FROM parsed
  WHERE job_id IS NOT NULL AND driver_exit_code IS NOT NULL AND driver_exit_code != 0),
cl AS (SELECT name, ROW_NUMBER() OVER (ORDER BY name) AS idx FROM (
         SELECT cluster_name AS name FROM b13 UNION SELECT cluster_name FROM b14) WHERE name <> ''),
rc AS (SELECT name, ROW_NUMBER() OVER (ORDER BY name) AS idx FROM (
         SELECT DISTINCT recipe_filename AS name FROM b13) WHERE name <> '')"""]) + """
SELECT 'cluster-wf_spark_' || CAST(cl.idx AS VARCHAR) AS cluster_name,
       '_SPARK_JOB_recipe_filename_' || CAST(rc.idx AS VARCHAR) || '.json' AS recipe_filename,
       b13.runs, b13.p95_job_duration_ms
FROM b13 JOIN cl ON cl.name = b13.cluster_name JOIN rc ON rc.name = b13.recipe_filename"""


def misc_sql() -> dict[str, str]:
    return {"table_diff": TABLE_DIFF, "diff_counts": DIFF_COUNTS, "anonymise_names": ANONYMISE}

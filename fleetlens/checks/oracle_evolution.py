"""Oracle SQL of the evolution job: carried boosts, kept recipes and the evolved configs.

Memory is a number of GB and executors are two numbers here; totals are always their product.
"""

from __future__ import annotations

from .oracle_boosts import BOOSTED_CONFIGS, CTES, _touching
from .oracle_fold import MANUAL_PLAN, da_plan
from .oracle_snapshots import DECISIONS_CTE, PAIRS_CTE, TRENDS_CTE, snapshot_ctes

REFERENCE_DATE = "2024_01_15"
KEYS = "(cluster_name, recipe_filename)"


def _flat(gb: str, mn: str, mx: str, heap: str, scale: str = "NULL", last: str = "NULL", kept: str = "NULL") -> str:
    return f"""{gb} || 'g' AS executor_memory, {mn} AS min_executors, {mx} AS max_executors,
  CAST({mn} * {gb} AS INTEGER) AS total_executor_minimum_allocated_memory_gb,
  CAST({mx} * {gb} AS INTEGER) AS total_executor_maximum_allocated_memory_gb,
  CAST({heap} AS VARCHAR) AS appliedMemoryHeapBoostFactor, CAST({scale} AS VARCHAR) AS appliedExecutorScaleFactor,
  CAST({last} AS VARCHAR) AS lastTunedDate, CAST({kept} AS VARCHAR) AS keptWithoutCurrentDate"""


CARRY_BOOSTS = f"""WITH fresh AS ({MANUAL_PLAN}),
before AS ({BOOSTED_CONFIGS}),
j AS (
  SELECT f.cluster_name, f.recipe_filename, f.spark_executor_instances AS n, b.appliedMemoryHeapBoostFactor AS factor,
         CASE WHEN b.appliedMemoryHeapBoostFactor IS NULL THEN f.spark_executor_memory_gb
              ELSE CAST(replace(b.executor_memory, 'g', '') AS INTEGER) END AS gb
  FROM fresh f LEFT JOIN before b USING {KEYS})
SELECT cluster_name, recipe_filename, {_flat("gb", "n", "n", "factor")}, factor IS NOT NULL AS carried FROM j"""

#: Configs of both windows' metrics, the actions, and what recipes only the reference window has.
WINDOWS = ",\n".join([*CTES, snapshot_ctes("c_"), PAIRS_CTE, TRENDS_CTE, DECISIONS_CTE, """deployed AS (
  SELECT cluster_name, recipe_filename, CAST(replace(mem, 'g', '') AS INTEGER) AS gb,
         CASE WHEN manual THEN inst ELSE mn END AS mn, CASE WHEN manual THEN inst ELSE mx END AS mx, NOT manual AS dynamic,
         CAST(prior AS DOUBLE) AS factor, t.recipe_filename IS NOT NULL AS gone
  FROM cfg LEFT JOIN (SELECT * FROM trends WHERE trend = 'dropped_entry') t USING (cluster_name, recipe_filename))"""])

KEPT_RECIPES = f"""WITH {WINDOWS},
fresh AS ({da_plan("SELECT * FROM c_b13")})
SELECT cluster_name, recipe_filename, {_flat("spark_executor_memory_gb", "min_executors", "max_executors", "NULL")},
  FALSE AS kept FROM fresh
UNION ALL
SELECT cluster_name, recipe_filename, {_flat("gb", "mn", "mx", "factor", last=f"'{REFERENCE_DATE}'", kept="'true'")}, TRUE
FROM deployed WHERE gone"""

EVOLVED = f"""WITH {WINDOWS},
acts AS (
  SELECT cluster_name, arg_min(action, CASE action WHEN 'boost_resources' THEN 1 WHEN 'generate_fresh' THEN 2
                                                   WHEN 'keep_as_is' THEN 3 ELSE 4 END) AS cluster_action
  FROM decisions GROUP BY cluster_name),
planned AS (SELECT cluster_name FROM acts WHERE cluster_action IN ('boost_resources', 'generate_fresh')),
fresh AS ({da_plan("SELECT * FROM c_b13 WHERE cluster_name IN (SELECT cluster_name FROM planned)", "cluster_name")}),
base AS (
  SELECT f.cluster_name, f.recipe_filename, min_executors AS mn, max_executors AS mx, TRUE AS dynamic, d.factor, FALSE AS gone,
         CASE WHEN d.factor IS NULL THEN spark_executor_memory_gb ELSE d.gb END AS gb
  FROM fresh f LEFT JOIN deployed d USING {KEYS}
  UNION ALL
  SELECT cluster_name, recipe_filename, mn, mx, dynamic, factor, gone, gb FROM deployed
  WHERE gone OR cluster_name NOT IN (SELECT cluster_name FROM planned)),
heaped AS (
  SELECT b.*, CASE WHEN cu.cluster_name IS NOT NULL OR (b.factor IS NULL AND a.cluster_name IS NOT NULL)
                   THEN CAST(CEIL(b.gb * 1.5) AS INTEGER) ELSE b.gb END AS gb2,
         CASE WHEN cu.cluster_name IS NOT NULL THEN COALESCE(b.factor, 1.0) * 1.5
              WHEN b.factor IS NOT NULL THEN b.factor WHEN a.cluster_name IS NOT NULL THEN 1.5 END AS factor2
  FROM base b LEFT JOIN anys a USING {KEYS} LEFT JOIN curs cu USING {KEYS}),
{_touching("c_", "r_", "(SELECT cluster_name, recipe_filename, NOT dynamic AS manual, mx FROM base)")},
scaled AS (
  SELECT h.*, t.cluster_name IS NOT NULL AND h.mn <> h.mx AS up,
         CASE WHEN t.cluster_name IS NOT NULL AND h.mn <> h.mx
              THEN CAST(GREATEST(h.mx + 1, CEIL(h.mx * 1.5)) AS INTEGER) ELSE h.mx END AS mx2
  FROM heaped h LEFT JOIN c_touch t USING {KEYS})
SELECT cluster_name, recipe_filename, cluster_action,
  {_flat("gb2", "mn", "mx2", "CAST(factor2 AS DOUBLE)", "CASE WHEN up THEN '1.5' END",
         f"CASE WHEN gone THEN '{REFERENCE_DATE}' END", "CASE WHEN gone THEN 'true' END")}
FROM scaled LEFT JOIN acts USING (cluster_name)"""


def evolution_sql() -> dict[str, str]:
    return {"carry_boosts": CARRY_BOOSTS, "kept_recipes": KEPT_RECIPES, "evolved_configs": EVOLVED}

"""Nested documents as DataFrames: analysis (K6), boosted configs in their order (K10, S11), content diff.

A document is built from long rows and holds a bounded group: an analysis document at most
about ``RECIPES_PER_DOCUMENT`` recipes of a cluster (a larger cluster has several parts), a
config document one file's recipes, which is what that file holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import format_number_or_int, memory_gb, pct_change
from ..session import deal_by
from .boosts import HEAP_COUNTERS, HEAP_TAG, KEYS, MEMORY_KEY, SCALE_TAG, executor_counts, with_option
from .snapshots import METRICS, metric_value

RECIPES_PER_DOCUMENT = 2000
DELTAS = "array<struct<metric:string,reference:double,current:double,pct_change:double>>"


# --- K6: analysis documents ----------------------------------------------------------------------

def _deltas() -> Column:
    """Reference, current and change of each compared metric, in the metrics' order."""
    ref, cur = (lambda m: metric_value("ref_", m)), (lambda m: metric_value("cur_", m))
    return F.array(*[F.struct(F.lit(m).alias("metric"), ref(m).alias("reference"), cur(m).alias("current"),
                              pct_change(ref(m), cur(m)).alias("pct_change")) for m in METRICS])


def _values(prefix: str) -> Column:
    return F.struct(*[F.col(f"{prefix}{m}").cast("double").alias(m) for m in METRICS])


def analysis_documents(pairs: DataFrame, trends: DataFrame, decisions: DataFrame, rollup: DataFrame,
                       recipes_per_document: int = RECIPES_PER_DOCUMENT) -> DataFrame:
    """K6: cluster_name, part, parts, overall_trend, recipes (array in name order).

    A recipe has its trend, confidence, action, reason and the deltas of its metrics; a new
    entry has its current metrics and a dropped one its reference metrics instead.
    """
    told = trends.select(*KEYS, "trend", "confidence").join(decisions.select(*KEYS, "action", "reason"), KEYS, "left")
    rows = pairs.join(told, KEYS).join(rollup.select("cluster_name", "overall_trend", F.greatest(
        F.lit(1), F.ceil(F.col("recipes") / recipes_per_document)).cast("int").alias("parts")), "cluster_name")
    recipe = F.struct(
        F.col("recipe_filename").alias("recipe"), "trend", "confidence", F.coalesce("action", F.lit("unknown")).alias("action"),
        F.coalesce("reason", F.lit("")).alias("reason"),
        F.when(F.col("status") == "paired", _deltas()).otherwise(F.array().cast(DELTAS)).alias("deltas"),
        F.when(F.col("status") == "new", _values("cur_")).alias("current_metrics"),
        F.when(F.col("status") == "dropped", _values("ref_")).alias("reference_metrics"))
    part = F.pmod(F.xxhash64("recipe_filename"), F.col("parts")).cast("int")
    return rows.withColumn("part", part).groupBy("cluster_name", "part").agg(
        F.first("parts").alias("parts"), F.first("overall_trend").alias("overall_trend"),
        F.array_sort(F.collect_list(recipe), lambda a, b: F.when(a["recipe"] < b["recipe"], -1).when(a["recipe"] > b["recipe"], 1).otherwise(0))
        .alias("recipes"))


def analysis_json(documents: DataFrame) -> DataFrame:
    """The documents as JSON text, numbers in report form (a number's text is parsed to a variant, so it stays a number)."""
    number = lambda c: F.parse_json(format_number_or_int(c))
    values = lambda s: F.when(s.isNotNull(), F.struct(*[number(s[m]).alias(m) for m in METRICS]))
    recipes = F.transform("recipes", lambda r: F.struct(
        r["recipe"].alias("recipe"), r["trend"].alias("trend"), number(r["confidence"]).alias("confidence"), r["action"].alias("action"),
        r["reason"].alias("reason"), F.transform(r["deltas"], lambda d: F.struct(
            d["metric"].alias("metric"), number(d["reference"]).alias("reference"), number(d["current"]).alias("current"),
            number(d["pct_change"]).alias("pct_change"))).alias("deltas"),
        values(r["current_metrics"]).alias("current_metrics"), values(r["reference_metrics"]).alias("reference_metrics")))
    return documents.select("cluster_name", "part", F.to_json(F.struct(
        F.col("cluster_name").alias("cluster"), "overall_trend", recipes.alias("recipes"))).alias("value"))


def analysis_fields(documents: DataFrame) -> DataFrame:
    """Every field of the documents as a row (cluster, recipe, metric, reference, current, change), with its place."""
    r = documents.select("cluster_name", "overall_trend", "part", F.posexplode("recipes").alias("recipe_pos", "r"))
    single = lambda which, side: F.when(F.col(f"r.{which}").isNotNull(), F.array(*[
        F.struct(F.lit(m).alias("metric"), (F.col(f"r.{which}.{m}") if side == 0 else F.lit(None).cast("double")).alias("reference"),
                 (F.col(f"r.{which}.{m}") if side == 1 else F.lit(None).cast("double")).alias("current"),
                 F.lit(None).cast("double").alias("pct_change")) for m in METRICS]))
    fields = F.coalesce(single("current_metrics", 1), single("reference_metrics", 0), F.col("r.deltas"))
    return r.select("cluster_name", "overall_trend", "part", "recipe_pos", F.col("r.recipe").alias("recipe_filename"), F.col("r.trend").alias("trend"),
                    F.col("r.confidence").alias("confidence"), F.col("r.action").alias("action"), F.col("r.reason").alias("reason"),
                    F.posexplode(fields).alias("metric_pos", "d")).select("*", "d.*").drop("d")


# --- S11 / K10: config documents that keep their order ---------------------------------------------

CONFIG_JSON = ("clusterConf map<string, map<string, variant>>, recipeSparkConf map<string, struct<parallelizationFactor:int, "
               "sparkOptsMap:map<string,string>, total_executor_minimum_allocated_memory_gb:int, "
               "total_executor_maximum_allocated_memory_gb:int, appliedMemoryHeapBoostFactor:double, appliedExecutorScaleFactor:double, "
               "lastTunedDate:string, keptWithoutCurrentDate:boolean>>")
# Order of the option keys in a written config; others follow in the order they had.
OPTION_ORDER = {
    "spark.serializer": 0, "spark.closure.serializer": 1, "spark.dynamicAllocation.enabled": 2, "spark.dynamicAllocation.minExecutors": 3,
    "spark.executor.instances": 3, "spark.dynamicAllocation.maxExecutors": 4, "spark.dynamicAllocation.initialExecutors": 5,
    "spark.executor.cores": 6, "spark.executor.memory": 7,
}
OTHER_OPTIONS = 8


def parse_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S11 over rows (file_name, value): clusters (file_name, cluster_name, fields in order) and recipes
    (file_name, cluster_name, position, recipe_filename, conf).  JSON maps keep the order of the text;
    files that don't parse, or name no cluster, are left out."""
    d = docs.select("file_name", F.from_json("value", CONFIG_JSON).alias("d")).select("file_name", "d.*").where("size(clusterConf) > 0")
    name = F.try_element_at(F.map_keys("clusterConf"), F.lit(1))
    clusters = d.select("file_name", name.alias("cluster_name"), F.map_values("clusterConf")[0].alias("fields"))
    recipes = d.select("file_name", name.alias("cluster_name"), F.posexplode("recipeSparkConf").alias("position", "recipe_filename", "conf"))
    return clusters, recipes


def recipe_rows(recipes: DataFrame) -> DataFrame:
    """Parsed recipes as the config rows that the boosts work on, with their place."""
    tags = {HEAP_TAG: F.col("conf")[HEAP_TAG].cast("string"), SCALE_TAG: F.col("conf")[SCALE_TAG].cast("string"),
            "lastTunedDate": F.col("conf.lastTunedDate"), "keptWithoutCurrentDate": F.col("conf.keptWithoutCurrentDate").cast("string")}
    extra = F.map_filter(F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return recipes.select("file_name", "position", *KEYS, F.coalesce("conf.parallelizationFactor", F.lit(5)).alias("parallelizationFactor"),
                          F.coalesce("conf.sparkOptsMap", F.create_map().cast("map<string,string>")).alias("spark_opts"),
                          F.coalesce("conf.total_executor_minimum_allocated_memory_gb", F.lit(0)).alias("total_executor_minimum_allocated_memory_gb"),
                          F.coalesce("conf.total_executor_maximum_allocated_memory_gb", F.lit(0)).alias("total_executor_maximum_allocated_memory_gb"),
                          extra.alias("extra"))


def _ordered_options(opts: Column) -> Column:
    """Entries in the fixed option order; equal ranks keep the order they had."""
    entries = F.map_entries(opts)
    rank = F.create_map(*[F.lit(x) for kv in OPTION_ORDER.items() for x in kv])
    placed = F.transform(entries, lambda e, i: F.struct(F.coalesce(F.try_element_at(rank, e["key"]), F.lit(OTHER_OPTIONS)).alias("r"), i.alias("i"),
                                                       e["key"].alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.transform(F.array_sort(placed), lambda e: F.struct(e["key"], e["value"])))


def rewrite_documents(docs: DataFrame, heap_boosts: DataFrame) -> DataFrame:
    """The documents with heap boosts applied: recipes in the order they had, options in the fixed order,
    boost counters and lists (in recipe order) behind the cluster's own fields, those of earlier runs replaced."""
    clusters, recipes = parse_documents(docs)
    b = heap_boosts.select(*KEYS, "boosted_memory", "cumulative_factor", "state", "original_memory")
    j = recipe_rows(recipes).join(b, KEYS, "left")
    hit = F.col("state").isNotNull()
    change = hit & (F.col("state") != "holding") & (F.col("original_memory") != F.col("boosted_memory"))
    mn, mx = executor_counts()
    gb = memory_gb(F.col("boosted_memory"))
    tag = lambda k: F.try_element_at("extra", F.lit(k))
    options = F.when(change, with_option(F.col("spark_opts"), MEMORY_KEY, F.col("boosted_memory"))).otherwise(F.col("spark_opts"))
    conf = F.struct(
        F.col("parallelizationFactor"),
        F.when(hit, F.col("cumulative_factor")).otherwise(tag(HEAP_TAG).cast("double")).alias(HEAP_TAG), tag(SCALE_TAG).cast("double").alias(SCALE_TAG),
        tag("lastTunedDate").alias("lastTunedDate"), tag("keptWithoutCurrentDate").cast("boolean").alias("keptWithoutCurrentDate"),
        _ordered_options(options).alias("sparkOptsMap"),
        F.when(change, (mn * gb).cast("int")).otherwise(F.col("total_executor_minimum_allocated_memory_gb")).alias("total_executor_minimum_allocated_memory_gb"),
        F.when(change, (mx * gb).cast("int")).otherwise(F.col("total_executor_maximum_allocated_memory_gb")).alias("total_executor_maximum_allocated_memory_gb"))
    entry = F.struct(F.col("position"), F.col("recipe_filename").alias("key"), conf.alias("value"), hit.alias("boosted"))
    files = deal_by(j.select("file_name", entry.alias("entry")), "file_name").groupBy("file_name").agg(
        F.array_sort(F.collect_list("entry"), lambda x, y: x["position"] - y["position"]).alias("e"))
    own = clusters.join(files, "file_name", "left")
    boosted = F.transform(F.filter(F.coalesce("e", F.array()), lambda e: e["boosted"]), lambda e: e["key"])
    counters = F.create_map(F.lit(HEAP_COUNTERS[0]), F.size(boosted).cast("variant"), F.lit(HEAP_COUNTERS[1]), boosted.cast("variant"))
    old = F.map_filter("fields", lambda k, v: ~k.isin(*HEAP_COUNTERS))
    fields = F.when(F.size(boosted) > 0, F.map_concat(old, counters)).otherwise(F.col("fields"))
    recipe_map = F.map_from_entries(F.transform("e", lambda e: F.struct(e["key"], e["value"])))
    return own.select("file_name", "cluster_name", F.to_json(F.struct(
        F.map_from_arrays(F.array("cluster_name"), F.array(fields)).alias("clusterConf"), recipe_map.alias("recipeSparkConf"))).alias("value"))


# --- G3: content diff -------------------------------------------------------------------------------

CLUSTER_FIELDS = [  # fixed values: clusterConf fields compared by name
    "num_workers", "master_machine_type", "worker_machine_type", "autoscaling_policy", "total_no_of_jobs",
    "cluster_max_total_memory_gb", "cluster_max_total_cores", "accumulated_max_total_memory_per_jobs_gb",
]


def canonical(value: Column) -> Column:
    """A JSON text with the keys of every object in order (variants keep them so): equal for equal content."""
    return F.to_json(F.try_parse_json(value))


def flatten(docs: DataFrame, levels: int = 6) -> DataFrame:
    """file_name, path, value of every leaf of (file_name, value); containers deeper than ``levels`` and empty
    ones are leaves in canonical text."""
    rows = docs.select("file_name", F.lit("$").alias("path"), F.try_parse_json("value").alias("v"))
    for level in range(levels):  # each level opens what is still a container; a leaf goes on as it is
        if level == 2:  # a config's recipes are rows by now: from here on they need not stay with their file
            rows = deal_by(rows, "file_name", "path")
        kind, text = F.schema_of_variant("v"), F.to_json("v")
        entry = lambda name, x: F.struct(name.alias("name"), x.alias("v"))
        opened = F.when(kind.startswith("OBJECT<") & (text != "{}"), F.transform(
            F.map_entries(F.col("v").try_cast("map<string,variant>")), lambda e: entry(F.concat(F.lit("."), e["key"]), e["value"]))).when(
            kind.startswith("ARRAY<") & (text != "[]"), F.transform(
                F.col("v").try_cast("array<variant>"), lambda x, i: entry(F.concat(F.lit("["), i.cast("string"), F.lit("]")), x)))
        rows = rows.select("file_name", "path", F.inline(F.coalesce(opened, F.array(entry(F.lit(""), F.col("v")))))).select(
            "file_name", F.concat("path", "name").alias("path"), "v")
    return rows.select("file_name", "path", F.to_json("v").alias("value"))


def content_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """G3 over (file_name, value) of two versions: per file in both whose content differs, whatever the order of
    keys, the named cluster fields and the recipe count that differ, else one row ``content_other``."""
    def side(docs: DataFrame, p: str) -> DataFrame:
        parsed = F.from_json("value", "clusterConf map<string, map<string,string>>, recipeSparkConf map<string,string>")
        d = docs.select("file_name", canonical(F.col("value")).alias(f"{p}_all"), parsed.alias("d"))
        fields = F.map_values("d.clusterConf")[0]
        items = [F.coalesce(F.try_element_at(fields, F.lit(c)), F.lit("")) for c in CLUSTER_FIELDS] + [F.size(F.coalesce("d.recipeSparkConf", F.create_map())).cast("string")]
        return d.select("file_name", f"{p}_all", F.array(*items).alias(p))

    names = F.array(*[F.lit(c) for c in [*CLUSTER_FIELDS, "recipe_count"]])
    j = side(a, "a").join(side(b, "b"), "file_name").where(~F.col("a_all").eqNullSafe(F.col("b_all")))
    found = F.filter(F.arrays_zip(names.alias("column"), F.col("a").alias("value_A"), F.col("b").alias("value_B")), lambda x: x["value_A"] != x["value_B"])
    other = F.array(F.struct(F.lit("content_other").alias("column"), F.lit("differs").alias("value_A"), F.lit("differs").alias("value_B")))
    return j.select("file_name", F.inline(F.when(F.size(found) > 0, found).otherwise(other)))


def path_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Leaves that differ between two versions of a file, by path (null: not there); files in one version only are left out."""
    common = a.select("file_name").join(b.select("file_name"), "file_name")
    x, y = (flatten(d.join(common, "file_name", "left_semi")).withColumnRenamed("value", n) for d, n in ((a, "value_A"), (b, "value_B")))
    return x.join(y, ["file_name", "path"], "full_outer").where(~F.col("value_A").eqNullSafe(F.col("value_B")))

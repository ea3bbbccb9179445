"""Machine catalogue (P1), price rates (S6) and prices (P2) as dimension tables.

The catalogue is generated from its rule -- family, variant, the vCPU sizes
offered, GB of memory per vCPU -- instead of being listed shape by shape.
Dimension tables are small and bounded (173 shapes, 8 families), built on
the driver as local relations and broadcast where joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.params import param_table
from ..sources.files import path_exists

# Machine shapes per (family, variant): vCPU sizes, GB per vCPU.
VARIANT_GB_PER_VCPU = {"standard": 4.0, "highmem": 8.0, "highcpu": 2.0}
FAMILY_SHAPES = [
    ("e2", "standard", [2, 4, 8, 16, 32]),
    ("e2", "highmem", [2, 4, 8, 16]),
    ("e2", "highcpu", [2, 4, 8, 16, 32]),
    ("n2", "standard", [2, 4, 8, 16, 32, 48, 64, 80, 96]),
    ("n2", "highmem", [2, 4, 8, 16, 32, 48, 64, 80]),
    ("n2", "highcpu", [2, 4, 8, 16, 32, 48, 64, 80, 96]),
    ("n2d", "standard", [2, 4, 8, 16, 32, 48, 64, 80, 96, 128, 224]),
    ("n2d", "highmem", [2, 4, 8, 16, 32, 48, 64, 80, 96]),
    ("n2d", "highcpu", [2, 4, 8, 16, 32, 48, 64, 80, 96, 128, 224]),
    ("c3", "standard", [4, 8, 22, 44, 88, 177, 192]),
    ("c3", "highmem", [4, 8, 22, 44, 88, 177, 192]),
    ("c3", "highcpu", [4, 8, 22, 44, 88, 177, 192]),
    ("c4", "standard", [4, 8, 16, 24, 32, 48, 96, 144, 192, 288]),
    ("c4", "highmem", [4, 8, 16, 24, 32, 48, 96, 144, 192, 288]),
    ("c4", "highcpu", [4, 8, 16, 24, 32, 48, 96, 144, 192, 288]),
    ("n4", "standard", [2, 4, 8, 16, 32, 48, 64, 80]),
    ("n4", "highmem", [2, 4, 8, 16, 32, 48, 64, 80]),
    ("n4", "highcpu", [2, 4, 8, 16, 32, 48, 64, 80]),
    ("n4d", "standard", [2, 4, 8, 16, 32, 48, 64, 80, 96]),
    ("n4d", "highmem", [2, 4, 8, 16, 32, 48, 64, 80, 96]),
    ("n4d", "highcpu", [2, 4, 8, 16, 32, 48, 64, 80, 96]),
]

# EUR per vCPU-hour and per GB-hour by family (fallback rates).
FAMILY_RATES = [
    ("e2", 0.0336, 0.0042),
    ("n2", 0.0470, 0.0065),
    ("n2d", 0.0430, 0.0060),
    ("n1", 0.0500, 0.0068),
    ("c3", 0.0600, 0.0050),
    ("c4", 0.0650, 0.0055),
    ("n4", 0.0490, 0.0063),
    ("n4d", 0.0460, 0.0061),
]
DEFAULT_RATE_FAMILY = "e2"


def catalog_rows() -> list[tuple[int, str, str, str, int, int]]:
    """(catalog_idx, name, family, variant, cores, memory_gb) in catalogue order."""
    rows = []
    for family, variant, vcpus in FAMILY_SHAPES:
        gb = VARIANT_GB_PER_VCPU[variant]
        for v in vcpus:
            rows.append((len(rows), f"{family}-{variant}-{v}", family, variant, v, int(round(v * gb))))
    return rows


def machine_catalog(spark: SparkSession) -> DataFrame:
    return param_table(
        spark, catalog_rows(),
        "catalog_idx int, machine_type string, family string, variant string, cores int, memory_gb int")


def price_rates(spark: SparkSession, csv_path: str | None = None) -> DataFrame:
    """Per-family rates from a CSV (family, vCpu_eur_per_hour, memGb_eur_per_hour),
    falling back to the fixed rates when the file is absent or yields no row; any other read
    error is raised."""
    if csv_path and path_exists(spark, csv_path):
        df = (spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
              .option("ignoreTrailingWhiteSpace", True).csv(csv_path)
              .select(F.lower(F.trim("family")).alias("family"),
                      F.col("vCpu_eur_per_hour").try_cast("double").alias("vcpu_eur_per_hour"),
                      F.col("memGb_eur_per_hour").try_cast("double").alias("mem_gb_eur_per_hour"))
              .dropna())
        if df.limit(1).count() > 0:
            return df
    return param_table(spark, FAMILY_RATES, "family string, vcpu_eur_per_hour double, mem_gb_eur_per_hour double")


def machine_prices(spark: SparkSession, rates: DataFrame | None = None) -> DataFrame:
    """Hourly EUR price per catalogue shape; unknown family -> e2 rate."""
    rates = rates if rates is not None else price_rates(spark)
    cat = machine_catalog(spark)
    fam = rates
    # unknown family -> the default family's rate: a second lookup keyed by that family
    default = fam.select(F.col("family").alias("_fallback_family"), F.col("vcpu_eur_per_hour").alias("_dv"),
                         F.col("mem_gb_eur_per_hour").alias("_dm"))
    j = (cat.join(fam, "family", "left").withColumn("_fallback_family", F.lit(DEFAULT_RATE_FAMILY))
         .join(default, "_fallback_family", "left"))
    vcpu = F.coalesce("vcpu_eur_per_hour", "_dv")
    mem = F.coalesce("mem_gb_eur_per_hour", "_dm")
    return j.select("catalog_idx", "machine_type", "family", "variant", "cores", "memory_gb",
                    (vcpu * F.col("cores") + mem * F.col("memory_gb")).alias("price_eur_per_hour"))


def price_of(machine_type: str, rates: dict[str, tuple[float, float]] | None = None) -> float:
    """Hourly price of one shape name (driver-side helper for parameters)."""
    table = {f: (v, m) for f, v, m in FAMILY_RATES} if rates is None else rates
    fam, variant, cores = machine_type.split("-")[0], machine_type.split("-")[1], int(machine_type.split("-")[2])
    v, m = table.get(fam, table[DEFAULT_RATE_FAMILY])
    return v * cores + m * int(round(cores * VARIANT_GB_PER_VCPU.get(variant, 4.0)))

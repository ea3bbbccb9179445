"""Scalar column expressions (X*).  All are built-in Spark expressions, so they
stay inside whole-stage codegen; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """``TIMESTAMP_DIFF(end, start, SECOND)`` -- whole elapsed seconds, towards zero (no calendar is needed)."""
    us = F.unix_micros(col(end)) - F.unix_micros(col(start))
    return ((us - us % 1_000_000) / 1_000_000).cast("long")


def millis_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MILLISECOND", col(start), col(end))


def ceil_minute(ts: Column | str) -> Column:
    t = col(ts)
    floor = F.date_trunc("minute", t)
    return F.when(floor == t, floor).otherwise(floor + F.expr("INTERVAL 1 MINUTE"))


def p95(c: Column | str) -> Column:
    """``APPROX_QUANTILES(x, 100)[OFFSET(95)]`` -- nulls ignored.

    ``percentile_approx`` with accuracy 10000 returns an element of the input
    (nearest rank), the same value as an exact discrete quantile for the group
    sizes seen here; it is a mergeable sketch, so it aggregates map-side.
    """
    return F.percentile_approx(col(c), 0.95, 10000)


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """``SAFE_DIVIDE`` -- NULL on a zero or NULL divisor."""
    return F.try_divide(col(a), col(b))


def pct_change(ref: Column | str, cur: Column | str) -> Column:
    """0->0 = 0, 0->x = 100, else delta / |ref| * 100."""
    r, c = col(ref), col(cur)
    return (F.when((r == 0) & (c == 0), F.lit(0.0))
            .when(r == 0, F.lit(100.0))
            .otherwise((c - r) / F.abs(r) * 100.0))


def clamp(v: Column, lo: Column | float, hi: Column | float) -> Column:
    """X19."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return F.greatest(lo_c, F.least(v, hi_c))


def memory_gb(text: Column | str) -> Column:
    """``"8g"`` -> 8; invalid / missing -> 0."""
    t = F.regexp_replace(F.lower(F.trim(col(text))), "g$", "")
    return F.coalesce(t.try_cast("int"), F.lit(0))


def memory_text(gb: Column) -> Column:
    return F.concat(gb.cast("bigint").cast("string"), F.lit("g"))


def boosted_memory(text: Column | str, factor: Column | float) -> Column:
    """``ceil(gb * f) || 'g'``."""
    f = factor if isinstance(factor, Column) else F.lit(factor)
    return memory_text(F.ceil(memory_gb(text) * f))


def machine_family(name: Column | str) -> Column:
    """``e2-standard-8`` -> ``e2``."""
    return F.split_part(col(name), F.lit("-"), F.lit(1))


def machine_variant(name: Column | str) -> Column:
    return F.split_part(col(name), F.lit("-"), F.lit(2))


def machine_cores(name: Column | str) -> Column:
    return F.split_part(col(name), F.lit("-"), F.lit(3)).try_cast("int")


def version_tag(date_arg: Column | str) -> Column:
    """``YYYY_MM_DD`` -> ``YYYY_DD_MM``."""
    parts = F.split(col(date_arg), "_")
    return F.concat_ws("_", parts.getItem(0), parts.getItem(2), parts.getItem(1))


def format_number_or_int(x: Column | str) -> Column:
    """Integer text when whole, else 4 decimals."""
    v = col(x)
    return (F.when(v == F.floor(v), v.cast("bigint").cast("string"))
            .otherwise(F.format_string("%.4f", v)))


def mins_sec_text(avg_ms: Column | str) -> Column:
    """``"<m>m <s>sec"`` from a millisecond average."""
    secs = F.round(col(avg_ms) / 1000.0).cast("bigint")
    return F.concat((secs / 60).cast("bigint").cast("string"), F.lit("m "),
                    (secs % 60).cast("string"), F.lit("sec"))


def regexp_extract_or_null(c: Column | str, pattern: str, idx: int = 1) -> Column:
    """X11: BigQuery ``REGEXP_EXTRACT`` gives NULL on no match (Spark gives '')."""
    return F.nullif(F.regexp_extract(col(c), pattern, idx), F.lit(""))


def human_bytes(b: Column | str) -> Column:
    """Base-1024 text truncated to 2 decimals (``B``, ``KB`` ... ``PB``)."""
    v = col(b).cast("double")
    units = F.array(*[F.lit(u) for u in ["B", "KB", "MB", "GB", "TB", "PB"]])
    exp = F.when(v < 1024, F.lit(0)).otherwise(
        F.least(F.floor(F.log(1024.0, v)), F.lit(5))).cast("int")
    scaled = F.floor(v / F.pow(F.lit(1024.0), exp) * 100) / 100
    return F.concat(F.format_string("%.2f", scaled), F.lit(" "), F.element_at(units, exp + 1))


def bytes_to_mb(b: Column | str) -> Column:
    return F.floor(col(b) / (1024 * 1024)).cast("bigint")

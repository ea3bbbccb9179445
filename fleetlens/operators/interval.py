"""Interval (range) joins: ``point BETWEEN start AND end`` plus equi keys.

Spark plans the equi part of such a join as a hash/sort-merge join and checks
the range as a residual filter, so every left row meets every right row of the
same key.  A hot key then turns into a quadratic task.  We add a time bucket to
the equi keys: a point falls in exactly one bucket, an interval is replicated
once per bucket it overlaps.  Each true match is produced exactly once (in the
point's bucket) and candidate pairs are limited to one bucket of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import DEFAULT_BUCKET_SECONDS, time_bucket

BUCKET = "_tbucket"
SLOT = "_tslot"  # hash of keys and bucket


WIDTH = "_bucket_us"
DEFAULT_TARGET_ROWS = 1_000_000
MAX_HALVINGS = 12
# "auto" joins: sparse keys have day buckets (a run of a day or less lies in one or two), a key of more points a day
# than AUTO_ROWS has narrower ones, down to 5 s
AUTO_SECONDS = 86400
AUTO_ROWS = 250_000
AUTO_HALVINGS = 14
BROADCAST_TARGET_ROWS = 100_000


def key_bucket_widths(points: DataFrame, keys: Sequence[str], point_ts: str,
                      max_seconds: int = DEFAULT_BUCKET_SECONDS,
                      target_rows: int = DEFAULT_TARGET_ROWS, max_halvings: int = MAX_HALVINGS) -> DataFrame:
    """Per-key bucket width (micros) so one bucket holds about ``target_rows`` points.

    width = max_seconds / 2^j with the smallest j such that the key's average
    rows per bucket (rows x width / time span) is at most ``target_rows``
    (at most ``max_halvings``); a key of no more rows than that keeps the full width.
    One aggregate per key with map-side combine.
    """
    st = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                                   (F.max(F.unix_micros(point_ts)) - F.min(F.unix_micros(point_ts))).alias("_span"))
    max_us = max_seconds * 1_000_000
    ratio = F.col("_n") * F.lit(float(max_us)) / (F.greatest(F.col("_span"), F.lit(1)).cast("double") * target_rows)
    halvings = F.when(F.col("_n") <= target_rows, 0).otherwise(
        F.least(F.lit(max_halvings), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(ratio, F.lit(1.0)))))))
    width = (F.lit(max_us) / F.pow(F.lit(2.0), halvings)).cast("long")
    return st.select(*keys, F.greatest(width, F.lit(1)).alias(WIDTH))


def dense_key_widths(points: DataFrame, keys: Sequence[str], point_ts: str, target_rows: int = AUTO_ROWS) -> DataFrame:
    """The keys whose buckets must be narrower than ``AUTO_SECONDS``.

    Each has more than ``target_rows`` points, so there is at most one row per ``target_rows`` points,
    which is broadcast; all other keys have the full width and need no row.
    """
    widths = key_bucket_widths(points, keys, point_ts, AUTO_SECONDS, target_rows, AUTO_HALVINGS)
    dense = widths.where(F.col(WIDTH) < AUTO_SECONDS * 1_000_000)
    return F.broadcast(dense) if target_rows >= BROADCAST_TARGET_ROWS else dense


def interval_join(intervals: DataFrame, points: DataFrame, keys: Sequence[str],
                  start: str, end: str, point_ts: str, how: str = "inner",
                  bucket_seconds: int | str = DEFAULT_BUCKET_SECONDS,
                  keep_bucket: bool = False, target_rows: int = AUTO_ROWS, reach: str = "any") -> DataFrame:
    """Join each interval to the points of the same key with ``start <= ts <= end``.

    ``how`` is ``inner`` or ``left`` (intervals without points kept once, with
    NULL point columns).  The left form is built as inner join + anti join so
    that the big point side never sits on the non-splittable side of an outer
    join (AQE can split skewed partitions of both inner-join sides).

    ``reach`` (inner only): ``one`` keeps the intervals that lie in one bucket, ``many`` those that
    reach over several, so that a caller that orders rows inside a bucket needs a carry for the latter only.
    With ``one`` the rows keep ``SLOT``, by which (with keys and bucket) the join has dealt them.
    """
    keys = list(keys)
    # Point-side join columns get private names: both sides often derive from
    # the same scan, and plain names keep the self-join unambiguous.
    pt = points.select(*[F.col(c).alias(f"_p_{c}") for c in points.columns])
    if bucket_seconds == "auto":
        # adaptive: a key dense in time gets narrower buckets (same width on both sides)
        dense = dense_key_widths(points, keys, point_ts, target_rows)
        width = lambda c: F.coalesce(F.col(c), F.lit(AUTO_SECONDS * 1_000_000))
        slot = lambda ts, w: F.floor(F.unix_micros(ts) / width(w)).cast("long")
        iv = intervals.join(dense, keys, "left")
        iv = iv.withColumns({"_b0": slot(start, WIDTH), "_b1": F.greatest(slot(start, WIDTH), slot(end, WIDTH))}).drop(WIDTH)
        pw = dense.select(*[F.col(k).alias(f"_d_{k}") for k in keys], F.col(WIDTH).alias("_p_w"))
        pt = pt.join(pw, [F.col(f"_p_{k}") == F.col(f"_d_{k}") for k in keys], "left").withColumn(
            "_p_bucket", slot(f"_p_{point_ts}", "_p_w")).drop("_p_w", *[f"_d_{k}" for k in keys])
    else:
        b0 = time_bucket(start, bucket_seconds)
        iv = intervals.withColumns({"_b0": b0, "_b1": F.greatest(b0, time_bucket(end, bucket_seconds))})
        pt = pt.withColumn("_p_bucket", time_bucket(f"_p_{point_ts}", bucket_seconds))
    if reach == "one":
        iv = iv.where(F.col("_b0") == F.col("_b1")).withColumn(BUCKET, F.col("_b0"))
    else:
        iv = (iv.where(F.col("_b0") < F.col("_b1")) if reach == "many" else iv).withColumn(BUCKET, F.explode(F.sequence("_b0", "_b1")))
    # Keys of one kind often begin alike ("cluster-..."), so that a sort by them compares whole texts;
    # the hash that goes first decides nearly all comparisons by one number.  The keys are compared all the same.
    kind = {k: (intervals.schema[k].dataType, points.schema[k].dataType) for k in keys}
    hashed = [k for k, (x, y) in kind.items() if x == y and isinstance(x, (T.StringType, T.IntegralType))]
    iv = iv.drop("_b0", "_b1").withColumn(SLOT, F.xxhash64(*hashed, BUCKET))
    pt = pt.withColumn("_p_slot", F.xxhash64(*[f"_p_{k}" for k in hashed], "_p_bucket"))
    cond = [F.col(SLOT) == F.col("_p_slot")] + [F.col(k) == F.col(f"_p_{k}") for k in keys] + [
        F.col(BUCKET) == F.col("_p_bucket"),
        F.col(f"_p_{point_ts}").between(F.col(start), F.col(end))]
    point_cols = [c for c in points.columns if c not in keys]
    joined = iv.join(pt, on=_and(cond), how="inner").select(
        *[F.col(c) for c in intervals.columns],
        *[F.col(f"_p_{c}").alias(c) for c in point_cols],
        *([F.col(BUCKET)] if keep_bucket else []), *([F.col(SLOT)] if reach == "one" else []),
    )
    if how == "inner":
        return joined
    if how != "left" or reach != "any":
        raise ValueError(f"unsupported interval join type {how!r}")
    filler = _unmatched(intervals, joined, start, end, keys)
    for c in point_cols:
        filler = filler.withColumn(c, F.lit(None).cast(points.schema[c].dataType))
    if keep_bucket:
        filler = filler.withColumn(BUCKET, F.lit(None).cast("long"))
    return joined.unionByName(filler)


def _unmatched(intervals: DataFrame, joined: DataFrame, start: str, end: str,
               keys: Sequence[str]) -> DataFrame:
    """Intervals with no point: anti join on the interval identity."""
    ident = [*keys, start, end]
    matched = joined.select(*ident).distinct()
    return intervals.join(matched, on=ident, how="left_anti")


def _and(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out

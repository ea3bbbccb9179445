"""Population statistics as aggregate expressions.

All are mergeable built-in aggregates (partial aggregation on every task),
so fleet-wide statistics never funnel rows through one task: the statistics
reduce to one row per group and are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pop_variance(x: Column | str) -> Column:
    """Population variance; fewer than 2 values -> 0."""
    return F.when(F.count(x) >= 2, F.var_pop(x)).otherwise(F.lit(0.0))


def pop_stddev(x: Column | str) -> Column:
    return F.when(F.count(x) >= 2, F.stddev_pop(x)).otherwise(F.lit(0.0))


def pop_covariance(x: Column | str, y: Column | str) -> Column:
    """Population covariance; fewer than 2 pairs -> 0."""
    return F.when(F.count(F.lit(1)) >= 2, F.covar_pop(x, y)).otherwise(F.lit(0.0))


def pearson(cov: Column, sx: Column, sy: Column) -> Column:
    """A14 from its parts: 0 when either sigma is 0; clamped to [-1, 1].

    Not ``F.corr``: under ANSI mode it raises on a constant column (Q3).
    """
    return (F.when((sx == 0) | (sy == 0), F.lit(0.0))
            .otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / (sx * sy)))))


def z_score(value: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd == 0, F.lit(0.0)).otherwise((value - mean) / sd)

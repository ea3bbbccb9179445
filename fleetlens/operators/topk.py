"""Exact top-k per group without sending a whole group to one task.

Stage 1 ranks inside ``(group, salt)`` slices (salt = hash of a row key), so
a hot group is ranked by many tasks and each keeps at most ``k`` rows;
stage 2 ranks the at most ``k x salts`` survivors of each group.  The result
equals a plain ``row_number() <= k`` over the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          salt_cols: Sequence[str] | None = None, salts: int = 32, rank_col: str = "rank") -> DataFrame:
    """Rows ranked ``1..k`` per ``keys`` by ``order`` (ties need a unique last key)."""
    keys = list(keys)
    salt_on = list(salt_cols) if salt_cols else [c for c in df.columns if c not in keys]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    stage1 = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return (stage1.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)
            .drop("_salt", "_r1"))

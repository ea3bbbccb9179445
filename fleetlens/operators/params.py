"""Parameter tables: broadcast only what has a proven size bound.

* ``param_table`` builds a table from rows that the driver holds (executor caps, machine
  catalogue, price rates): their number is known, and the broadcast hint is given up to
  ``MAX_BROADCAST_ROWS``.  Beyond it, and for tables that come from elsewhere, joins stay
  plain and Spark chooses from the sizes it sees at run time.
* ``broadcast_bounded`` hints a derived table whose rows are bounded by construction, e.g.
  one statistics row per metric of a fixed list; the caller states the bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000


def param_table(spark: SparkSession, rows: Sequence, schema) -> DataFrame:
    """A table of driver-held rows, hinted for broadcast when there are few enough."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= MAX_BROADCAST_ROWS else df


def broadcast_bounded(df: DataFrame, bound: int, why: str) -> DataFrame:
    """Broadcast a derived table of at most ``bound`` rows (``why``: the proof, e.g. "one row per metric")."""
    if bound > MAX_BROADCAST_ROWS:
        raise ValueError(f"bound {bound} too large to broadcast ({why})")
    return F.broadcast(df)

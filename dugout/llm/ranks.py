"""Global ranks without a global window.

Rows are dealt into blocks that follow the order of a number between 0 and 1;
ranks within a block are a window, and a block starts after the rows of the
blocks before it, which a small table of fixed size tells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(frame: DataFrame, place: Column, order: list[Column], name: str, within: str | None = None, blocks: int = 1024) -> DataFrame:
    """Add ``name``, the rank from 0 in ascending ``place`` then ``order``, and ``name_of``, the rows ranked together.

    ``place`` lies in [0, 1) and must not decrease along the order.  With
    ``within``, ranks are taken per value of that column (null is a value), and a
    value that holds most rows is spread over the blocks like all rows are.
    """
    keys = [within] if within else []
    blocked = frame.withColumn("_block", F.least(F.floor(place * blocks), F.lit(blocks - 1)).cast("int"))
    counts = blocked.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    # At most ``blocks`` rows per value of ``within``.
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        *([F.col(within).alias("_within")] if within else []),
        F.col("_block").alias("_at"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(W.partitionBy(*keys)).alias(f"{name}_of"),
    )
    inside = blocked.withColumn(name, F.row_number().over(W.partitionBy(*keys, "_block").orderBy(place, *order)) - 1)
    matches = F.col("_block") == F.col("_at")
    if within:
        matches = matches & F.col(within).eqNullSafe(F.col("_within"))
    return inside.join(starts, matches).withColumn(name, F.col(name) + F.col("_start")).drop("_block", "_at", "_start", "_within")

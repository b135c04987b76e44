"""Proportional stratified interleaving of rows into shards.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional
rank is ``(rank + phase) / rows of its source``, with a seeded phase for each
source, so that sources of few rows spread too.  Sorted by it, every stretch of
rows holds the sources in their proportions, so equal cuts give shards that match
the mixture and differ by one row at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.llm.ranks import ranked

_WHOLE = float(1 << 53)


def _unit(number: Column) -> Column:
    """The upper 53 bits of a 64-bit hash as a number in [0, 1)."""
    return F.shiftrightunsigned(number, 11) / F.lit(_WHOLE)


def interleave(rows: DataFrame, shards: int, key: str = "doc_id", source: str = "source", seed: int = 17, blocks: int | None = None) -> DataFrame:
    """Add ``shard`` and ``slot`` (from 0 without gaps within a shard) to every row; all columns stay, but ones of these two names.

    The order is that of a seeded hash of the whole row, then the key, then a second hash of the
    row, so it follows from the rows alone; rows that are wholly equal are interchangeable and share
    one block.  A null source is a source of its own and a null key is hashed
    like any value.  An empty table gives an empty one.  With fewer rows than
    shards, the last shards stay empty.  ``blocks``: of how many the ranks are put together; by default one for
    65,536 rows, 1,024 at least.
    """
    names = rows.columns
    everything = [F.col(f"`{c}`") for c in names]
    inner = rows.select(
        F.struct(*everything).alias("_row"),
        F.col(f"`{source}`").alias("_source"),
        F.col(f"`{key}`").alias("_key"),
        F.xxhash64(F.lit(seed), *everything).alias("_hash"),
        F.xxhash64(F.lit(~seed), *everything).alias("_second"),
    )
    blocks = blocks or max(1024, rows.count() >> 16)
    order = [F.col("_hash"), F.col("_key"), F.col("_second")]
    by_source = ranked(inner, _unit(F.col("_hash")), order, "_rank", within="_source", blocks=blocks)
    phase = _unit(F.xxhash64(F.lit(seed), F.lit("phase"), F.col("_source")))
    placed = by_source.withColumn("_fraction", (F.col("_rank") + phase) / F.col("_rank_of"))
    lined = ranked(placed, F.col("_fraction"), order, "_position", blocks=blocks)
    total, position = F.col("_position_of"), F.col("_position")
    # The first ``rows % shards`` shards hold one row more.
    small, larger = F.floor(total / shards), total % shards
    edge = larger * (small + 1)
    first = F.when(position < edge, F.floor(position / (small + 1))).otherwise(larger + F.floor((position - edge) / F.greatest(small, F.lit(1))))
    shard = first.cast("int")
    return lined.select("_row", shard.alias("_shard"), position.alias("_position"), small.alias("_small"), larger.alias("_larger")).select(
        *(F.col("_row")[c].alias(c) for c in names if c not in ("shard", "slot")),
        F.col("_shard").alias("shard"),
        (F.col("_position") - F.col("_shard") * F.col("_small") - F.least(F.col("_shard").cast("long"), F.col("_larger"))).cast("long").alias("slot"),
    )

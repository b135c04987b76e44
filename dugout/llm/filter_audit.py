"""What each of several filters removes, in every order of them.

A row's failures are one bit mask.  Whether a text repeats an earlier document is
the only failure that other rows decide.  A counting Bloom sketch goes before it:
every task counts the cells of its texts' hashes, the counts are merged, and a
text with a cell that only it has met is unique for certain.  Only the others,
possible repeats, are shuffled as full texts for their smallest doc_id.  All the
rest is additive: rows are counted by part and mask, and what a filter removes
after others follows from those counts alone.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.llm.runtime import Scratch, ship

#: Cells of the sketch for each text, and cells that each text marks.
CELLS_PER_TEXT, HASHES = 16, 3
#: Bits of the number of cells, least and most (64 MB); a sketch beyond it clears fewer texts, which are then compared in full.
_LEAST_BITS, _MOST_BITS = 16, 29
_BLOCK_BITS = 16

LETTERS = "ABCDE"
DUPLICATE = "E"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _id() -> Column:
    return F.col("doc_id").cast("long").alias("doc_id")


def failures(text: Column) -> dict[str, Column]:
    """Conditions that a text alone decides; words are runs of anything but space and 0x09-0x0D."""
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    upper = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * upper > 5 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def cells(print_: Column, bits: int) -> list[Column]:
    """The cells that a text marks, by its hash."""
    return [F.shiftrightunsigned(F.xxhash64(F.lit(k), print_), 64 - bits).cast("int") for k in range(HASHES)]


def sketch_bits(texts: int) -> int:
    """Bits of the number of cells for so many texts."""
    return min(_MOST_BITS, max(_LEAST_BITS, (CELLS_PER_TEXT * max(texts, 1) - 1).bit_length()))


def _counted(prints: DataFrame, bits: int) -> DataFrame:
    """Cells met twice or more, over all texts.

    A task's sketch is the partial count of its cells; merging adds the counts.  A
    cell that one text marks by two hashes is counted once for it.
    """
    marked = prints.select(F.explode(F.array_distinct(F.array(*cells(F.col("print"), bits)))).alias("cell"))
    return marked.groupBy("cell").agg(F.count("*").alias("met")).filter("met > 1").select("cell")


def _packed(repeated: DataFrame, bits: int) -> bytes:
    """One bit per cell met twice or more: a table of fixed size, put together on the executors in blocks of 8 KB."""
    block_bits = min(_BLOCK_BITS, bits)
    width = 1 << block_bits

    def pack(group: pa.Table) -> pa.Table:
        marks = np.zeros(width, dtype=bool)
        marks[group.column("cell").to_numpy() & (width - 1)] = True
        return pa.table({"block": group.column("block").slice(0, 1), "bits": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    out = bytearray(1 << (bits - 3))
    blocks = repeated.withColumn("block", F.shiftright("cell", block_bits)).groupBy("block")
    for row in blocks.applyInArrow(pack, "block int, bits binary").toLocalIterator():
        out[row.block * width // 8 : (row.block + 1) * width // 8] = row.bits
    return bytes(out)


def possible_repeat(shared, bits: int, print_: Column) -> Column:
    """Whether every cell of a text's hash was met twice."""

    @F.pandas_udf("boolean")
    def test(*at: pd.Series) -> pd.Series:
        table = np.frombuffer(shared.value, dtype=np.uint8)
        found = [(table[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1 for c in (series.to_numpy() for series in at)]
        return pd.Series(np.logical_and.reduce(found))

    return test(*cells(print_, bits))


def _later_copies(docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with ``copy``: whether a smaller doc_id has the identical text."""
    spark = docs.sparkSession
    # A null doc_id is neither smaller nor larger than any.
    placed = rows.filter("doc_id is not null")
    bits = sketch_bits(placed.count())
    shared = spark.sparkContext.broadcast(_packed(_counted(placed.select("print"), bits), bits))
    texts = docs.select(_id(), _text().alias("text")).filter("doc_id is not null")
    suspects = texts.filter(possible_repeat(shared, bits, F.xxhash64("text")))
    # Copies of a text combine before the shuffle, so a large group costs a task one row of it.
    first = suspects.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    survivors = scratch.store(first.select("doc_id", F.xxhash64("text").alias("print"), F.lit(True).alias("first")).distinct(), "survivors")
    tested = scratch.store(rows.withColumn("suspect", F.col("doc_id").isNotNull() & possible_repeat(shared, bits, F.col("print"))), "tested")
    shared.destroy()
    return tested.join(survivors, ["doc_id", "print"], "left").select(
        "doc_id", "part", "mask", (F.col("suspect") & F.col("first").isNull()).alias("copy")
    )


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask (bit k: fails the k-th letter), documents, good and toxic: additive counts.

    ``docs`` has doc_id, text and the part's column, ``labels`` doc_id, quality and
    toxic.  A null text is empty, a null part is the empty string.  Of several labels of a doc_id one that says so is enough; a
    null doc_id has no label and is no copy.  Rows that repeat a doc_id count each;
    equal texts under one doc_id are no copies of each other.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "audit")
    failed = [F.when(fails, 1 << LETTERS.index(letter)).otherwise(0) for letter, fails in failures(_text()).items()]
    named = F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part")
    rows = docs.select(_id(), named, F.xxhash64(_text()).alias("print"), reduce(Column.__add__, failed).alias("mask"))
    judged = _later_copies(docs, scratch.store(rows, "rows"), scratch)
    said = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    told = labels.filter("doc_id is not null").groupBy(_id()).agg(*said)
    mask = F.col("mask") + F.when(F.col("copy"), 1 << LETTERS.index(DUPLICATE)).otherwise(0)
    return (
        judged.join(told, "doc_id", "left")
        .groupBy("part", mask.alias("mask"))
        .agg(F.count("*").alias("documents"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    )


def audit(counts: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    What a step counts depends on its filter and the set of filters before it, 80
    cases; orders then pick theirs.  A table without rows has no parts.
    """
    spark = counts.sparkSession
    n = len(LETTERS)
    cases = [(f, before) for f in range(n) for before in range(1 << n) if not before >> f & 1]
    case = F.explode(F.array(*(F.struct(F.lit(f).alias("filter"), F.lit(before).alias("before")) for f, before in cases))).alias("case")
    fails = F.col("mask").bitwiseAND(F.expr("shiftleft(1, filter)")) != 0
    open_ = F.col("mask").bitwiseAND(F.col("before")) == 0
    measures = {
        "kept": F.when(open_ & ~fails, F.col("documents")),
        "removed": F.when(open_ & fails, F.col("documents")),
        "redundant": F.when(~open_ & fails, F.col("documents")),
        "unique_fails": F.when(F.col("mask") == F.expr("shiftleft(1, filter)"), F.col("documents")),
        "good_lost": F.when(open_ & fails, F.col("good")),
        "toxic_lost": F.when(open_ & fails, F.col("toxic")),
    }
    sums = [F.sum(F.coalesce(counted, F.lit(0))).alias(name) for name, counted in measures.items()]
    by_case = counts.select("*", case).select("*", "case.*").groupBy("part", "filter", "before").agg(*sums)
    orders = []
    for order in permutations(range(n)):
        for step, f in enumerate(order):
            orders.append(("".join(LETTERS[k] for k in order), step + 1, f, sum(1 << k for k in order[:step])))
    orders = spark.createDataFrame(orders, "filter_order string, step int, filter int, before int")
    # 600 rows, whatever the data.
    steps = by_case.join(F.broadcast(orders), ["filter", "before"])
    shapley = steps.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return steps.join(shapley, ["part", "filter"]).select("part", "filter_order", "step", *measures, "shapley")

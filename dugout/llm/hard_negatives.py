"""Hard-negative mining by matrix products in a residue number system.

Components are whole numbers.  A product of two blocks of vectors is computed
modulo several small primes in float32, where every partial sum is a whole
number below 2^24 and so exact, and the signed scores are put together by
Chinese remaindering.  As many primes are taken as the blocks' norms ask for, so
scores are exact whatever the components.

Anchors are a stated query set against all rows: both are dealt into blocks, each
cell of the grid of blocks is one task's product, and of a cell only the first
few rows of each anchor and window leave it.  The first grid finds each anchor's
positives, the second the negatives within the window that each positive opens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dugout.llm.runtime import Scratch, ship

#: Whole numbers up to here are exact in float32.
_EXACT = 1 << 24
#: Scores of a tile: this many anchors by this many rows.
_TILE_ANCHORS, _TILE_ROWS = 256, 4096
#: Components of a block of rows, and of one of anchors, at most, so that wide vectors make blocks of fewer rows.
_ROW_COMPONENTS, _ANCHOR_COMPONENTS = 1 << 22, 1 << 20
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1
_NO_ID = np.int64(_HIGHEST)


def primes_below(limit: int) -> Iterator[int]:
    """Primes in descending order."""
    for n in range(limit - 1, 2, -1):
        if all(n % k for k in range(2, int(n**0.5) + 1)):
            yield n


@dataclass(frozen=True)
class Mining:
    """A row is an anchor where its id is divisible by ``every``.  The window of a positive of score p holds the
    scores s with ``low * p <= 100 * s <= high * p``.  ``anchor_block`` and ``row_block``: rows of a block at most, about."""

    every: int = 100
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    anchor_block: int = 1 << 13
    row_block: int = 1 << 16


def centred(values: np.ndarray, prime: int) -> np.ndarray:
    """Residues of whole numbers, between -prime / 2 and prime / 2, as float32."""
    rest = np.fmod(values, prime)
    half = prime // 2
    rest[rest > half] -= prime
    rest[rest < -half] += prime
    return rest.astype(np.float32)


class Residues:
    """Exact products of rows of whole numbers, given as doubles."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray):
        def norm(x: np.ndarray) -> float:
            top = float(np.abs(x).max(initial=0.0))
            return top * float(np.sqrt(((x / top) ** 2).sum(axis=1).max())) if top else 0.0

        # No score is larger than the product of two norms; a little more covers their rounding.
        bound = int(norm(anchors) * (1 + 1e-6) + 1) * int(norm(rows) * (1 + 1e-6) + 1)
        self.primes, product = [], 1
        for prime in primes_below(256):
            self.primes.append(prime)
            product *= prime
            if product > 2 * bound + 1:
                break
        else:
            raise ArithmeticError("components are too large for the primes below 256")
        self.product = product
        self.large = product >= 1 << 62
        self.anchors = [centred(anchors.copy(), p) for p in self.primes]
        self.rows = [np.ascontiguousarray(centred(rows.copy(), p).T) for p in self.primes]

    def scores(self, some: slice, others: slice) -> np.ndarray:
        """The scores of a tile: 64-bit numbers, or Python's own where these don't suffice."""
        digits = []
        for prime, anchors, rows in zip(self.primes, self.anchors, self.rows):
            width = _EXACT // (prime // 2 + 1) ** 2
            total = None
            for k in range(0, anchors.shape[1], width):
                part = np.rint(anchors[some, k : k + width] @ rows[k : k + width, others]).astype(np.int32) % prime
                total = part if total is None else (total + part) % prime
            # Mixed radix: the digit of this prime, after those before it are taken away.
            shape = anchors[some].shape[0], rows[:, others].shape[1]
            digit = np.zeros(shape, np.int32) if total is None else total
            for done, before in digits:
                digit = (digit - before) * pow(done, -1, prime) % prime
            digits.append((prime, digit))
        kind = object if self.large else np.int64
        value, weight = np.zeros(digits[0][1].shape, dtype=kind), 1
        for prime, digit in digits:
            value += digit.astype(kind) * weight
            weight *= prime
        value[value > self.product // 2] -= self.product
        return np.clip(value, _LOWEST, _HIGHEST).astype(np.int64) if self.large else value


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """floor(256 * x) of every component, a row each; shorter vectors are filled up with zeros."""
    out = np.zeros((len(column), width))
    at = 0
    for chunk in column.chunks:
        lengths = chunk.value_lengths().to_numpy(zero_copy_only=False)
        flat = chunk.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        block = out[at : at + len(chunk)]
        block[np.arange(width) < lengths[:, None]] = np.floor(256.0 * flat)
        at += len(chunk)
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max((int(n) for column in columns for chunk in column.chunks for n in chunk.value_lengths().to_numpy(zero_copy_only=False)), default=0)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    """Ids, a null one as the largest number, so that it comes last among ties."""
    return column.fill_null(int(_NO_ID)).to_numpy()


class First:
    """The first ``count`` rows of each of some lists, by descending score and then by the order in which rows are offered."""

    def __init__(self, lists: int, count: int):
        self.count = count
        self.list = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.row = np.empty(0, np.int64)
        self.floor = np.full(lists, _LOWEST, np.int64)
        self.full = np.zeros(lists, dtype=bool)

    def offer(self, lists: np.ndarray, scores: np.ndarray, rows: np.ndarray) -> None:
        """Rows offered later must stand later in the order."""
        if not len(lists):
            return
        lists, scores, rows = (np.concatenate(pair) for pair in ((self.list, lists), (self.score, scores), (self.row, rows)))
        # ~score is descending in score and cannot overflow.
        order = np.lexsort((rows, ~scores, lists))
        lists, scores, rows = lists[order], scores[order], rows[order]
        opens = np.flatnonzero(np.diff(lists, prepend=-1))
        rank = np.arange(len(lists)) - np.repeat(opens, np.diff(opens, append=len(lists)))
        keep = rank < self.count
        self.list, self.score, self.row = lists[keep], scores[keep], rows[keep]
        last = rank == self.count - 1
        self.floor[lists[last]] = scores[last]
        self.full[lists[last]] = True

    def beats(self, scores: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Which scores of the lists' rows would still enter: one row of scores for each list."""
        return np.where(self.full[lists][:, None], scores > self.floor[lists][:, None], True)


def _tiles(anchors: np.ndarray, rows: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Tiles of the scores; the first ones of a stretch of anchors are small, so that lists fill early."""
    product = Residues(anchors, rows)
    for a in range(0, len(anchors), _TILE_ANCHORS):
        some, start, step = slice(a, min(a + _TILE_ANCHORS, len(anchors))), 0, 256
        while start < len(rows):
            others = slice(start, min(start + step, len(rows)))
            yield some, others, product.scores(some, others)
            start, step = others.stop, _TILE_ROWS


def _positives(how: Mining):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        # In ascending id, then row number, so that ties fall to the first offered.
        rows = rows.take(np.lexsort((rows["row"].to_numpy(), _ids(rows["vec_id"]))))
        width = _width(rows["embedding"], anchors["embedding"])
        found = First(len(anchors), how.positives)
        labels, numbers = rows["label"].to_numpy(), rows["row"].to_numpy()
        own, self_ = anchors["label"].to_numpy(), anchors["row"].to_numpy()
        for some, others, scores in _tiles(_matrix(anchors["embedding"], width), _matrix(rows["embedding"], width)):
            lists = np.arange(some.start, some.stop)
            good = (own[some, None] == labels[others]) & (self_[some, None] != numbers[others]) & found.beats(scores, lists)
            a, r = np.nonzero(good)
            found.offer(lists[a], scores[a, r], r + others.start)
        return pa.table(
            {
                "anchor": anchors["row"].take(found.list),
                "score": pa.array(found.score),
                "vec_id": rows["vec_id"].take(found.row),
                "row": rows["row"].take(found.row),
            }
        )

    return run


def _windows(scores: np.ndarray, how: Mining) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of the window of each positive's score; computed in Python's numbers, which don't overflow."""
    low = [max(_LOWEST, min(_HIGHEST, -(-how.low * int(p) // 100))) for p in scores]
    high = [max(_LOWEST, min(_HIGHEST, how.high * int(p) // 100)) for p in scores]
    return np.array(low, dtype=np.int64), np.array(high, dtype=np.int64)


def _negatives(how: Mining):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows = rows.take(np.lexsort((rows["row"].to_numpy(), _ids(rows["vec_id"]))))
        width = _width(rows["embedding"], anchors["embedding"])
        wanted = anchors["wanted"].combine_chunks()
        counts = wanted.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(anchors)), counts)
        position = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        low, high = _windows(wanted.flatten().to_numpy(zero_copy_only=False), how)
        found = First(len(owner), how.negatives)
        labels, own = rows["label"].to_numpy(), anchors["label"].to_numpy()
        for some, others, scores in _tiles(_matrix(anchors["embedding"], width), _matrix(rows["embedding"], width)):
            other_label = own[some, None] != labels[others]
            for k in range(int(counts[some].max(initial=0))):
                lists = np.flatnonzero((owner >= some.start) & (owner < some.stop) & (position == k))
                at = owner[lists] - some.start
                seen = scores[at]
                good = other_label[at] & (seen >= low[lists, None]) & (seen <= high[lists, None]) & found.beats(seen, lists)
                a, r = np.nonzero(good)
                found.offer(lists[a], seen[a, r], r + others.start)
        return pa.table(
            {
                "anchor": anchors["row"].take(owner[found.list]),
                "positive_score": wanted.flatten().take(pa.array(found.list)),
                "score": pa.array(found.score),
                "vec_id": rows["vec_id"].take(found.row),
                "row": rows["row"].take(found.row),
            }
        )

    return run


def relabelled(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Where the id is divisible by ``every``, the label becomes the next one."""
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return vectors.withColumn("label", moved)


def mined(vectors: DataFrame, how: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``vectors`` has vec_id, label and embedding; other columns are ignored.  Rows
    with a null label, a null vector or a null or non-finite component take no
    part; a shorter vector is filled up with zeros.  Rows that repeat an id are
    rows of their own: anchors each, and each other's positives where labels agree.  A
    null id is no anchor and comes last among ties.  A score outside 64 bits
    counts as the nearest of them.  A positive of negative score has no window.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "mining")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    stored = scratch.store(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    is_anchor = F.col("vec_id") % how.every == 0
    n, n_anchors, width = stored.agg(F.count("*"), F.count_if(is_anchor), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    row_block = max(1, min(how.row_block, _ROW_COMPONENTS // max(1, width)))
    anchor_block = max(1, min(how.anchor_block, _ANCHOR_COMPONENTS // max(1, width)))
    # At least as many cells as the session has shuffle partitions.
    row_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // row_block))
    anchor_blocks = max(1, -(-n_anchors // anchor_block))

    def dealt(frame: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        """Rows dealt evenly into blocks, each block once for every block of the other side."""
        return frame.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def grid(anchors: DataFrame, work, schema: str) -> DataFrame:
        left = dealt(stored, "r", row_blocks, "a", anchor_blocks).groupBy("r", "a")
        # Columns of their own, since both sides come from one table.
        anchors = anchors.select(*(F.col(c).alias(c) for c in anchors.columns))
        right = dealt(anchors, "a", anchor_blocks, "r", row_blocks).groupBy("r", "a")
        return left.cogroup(right).applyInArrow(work, schema)

    schema = "anchor long, score long, vec_id long, row long"
    found = grid(stored.filter(is_anchor), _whole_cells(_positives(how), schema), schema)
    best = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"]
    order = F.row_number().over(W.partitionBy("anchor").orderBy(*best))
    positives = scratch.store(found.withColumn("place", order).filter(F.col("place") <= how.positives), "positives")
    wanted = positives.groupBy("anchor").agg(F.collect_set("score").alias("wanted"))
    seekers = stored.join(wanted, F.col("row") == F.col("anchor")).select("row", "vec_id", "label", "embedding", "wanted")
    schema = "anchor long, positive_score long, score long, vec_id long, row long"
    near = grid(seekers, _whole_cells(_negatives(how), schema), schema)
    order = F.row_number().over(W.partitionBy("anchor", "positive_score").orderBy(*best))
    negatives = near.withColumn("rank", order).filter(F.col("rank") <= how.negatives).select(
        "anchor", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    ids = stored.filter(is_anchor).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    pairs = positives.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = pairs.join(negatives, ["anchor", "positive_score"]).join(ids, "anchor")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _whole_cells(work, schema: str):
    """Cells without rows or without anchors have no result."""
    kinds = {"long": pa.int64()}
    empty = pa.schema([(name, kinds[kind]) for name, kind in (column.strip().split(" ") for column in schema.split(","))])

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        return work(rows, anchors).cast(empty) if rows.num_rows and anchors.num_rows else empty.empty_table()

    return run

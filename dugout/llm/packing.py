"""Order-preserving packing of documents into token sequences by dynamic programming.

The documents of a segment stand one after the other, in ascending doc_id, as one
run of tokens.  It is cut into windows of at most ``limit`` tokens at places where
a document or a sentence ends; within a stretch that holds no such place for long,
also every few tokens.  A window costs its padding, the penalty of the place it
ends at, and a little for itself.  The cheapest cuts follow from

    cost(j) = penalty(j) + min over i of cost(i) + padding(place(j) - place(i)),

where the minimum over the places within reach is the head of a monotone queue of
``cost(i) + place(i)``, and places a power of two away, whose windows need no
padding, are tried beside it.

Segments are ranges of doc_id of equal width, each of about a million tokens;
ranges that hold far more are dealt by a hash of the text.  What segment a row
lies in follows from the table alone, not from its partitions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.llm.byte_bpe import byte_characters
from dugout.llm.runtime import Scratch, ship
from dugout.llm.word_ids import Definition, encoder, ragged

#: Segments a table is cut into at most, so that a sequence's number fits its field.
_MOST_SEGMENTS = 1 << 20
_COUNTER_BITS = 23


@dataclass(frozen=True)
class Packing:
    """``limit``: tokens of a sequence.  ``end_id`` closes every document.  Penalties are in tokens of padding.

    ``stride``: a stretch longer than it, without an end of a sentence, may be cut every so many tokens.
    ``segment_tokens``: tokens of a segment; a task packs up to twice as many at a time.
    """

    limit: int = 4096
    end_id: int = 2
    sentence_cut: float = 24.0
    inner_cut: float = 96.0
    window: float = 4.0
    stride: int = 64
    segment_tokens: int = 1 << 20

    def __post_init__(self):
        if self.limit < 1 or self.stride < 1 or self.segment_tokens < 1 or min(self.sentence_cut, self.inner_cut, self.window) < 0:
            raise ValueError("limit, stride and segment_tokens must be positive, penalties not negative")


def sentence_ends(definition: Definition) -> np.ndarray:
    """For each id, whether its piece ends a sentence: punctuation with a full stop, an exclamation or a question mark."""
    model = json.loads(definition.text)["model"]
    suffix = model["end_of_word_suffix"]
    of_letter = {letter: byte for byte, letter in enumerate(byte_characters())}
    marks, word = re.compile("[.!?…。！？]"), re.compile(r"\w")
    out = np.zeros(8 * len(definition.ends_word), dtype=bool)
    for piece, number in model["vocab"].items():
        letters = piece.removesuffix(suffix)
        if letters != piece and all(letter in of_letter for letter in letters):
            text = bytes(of_letter[letter] for letter in letters).decode("utf-8", "ignore")
            out[number] = bool(marks.search(text)) and not word.search(text)
    return out


def places(sizes: np.ndarray, ends_sentence: np.ndarray, how: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Where a run of documents may be cut, ascending from 0, and the penalty of each place.

    ``sizes``: tokens of each document; ``ends_sentence``: for each token of the run.
    """
    inner, sentence, document = 1, 2, 3
    kind = np.zeros(len(ends_sentence) + 1, dtype=np.uint8)
    kind[1:][ends_sentence] = sentence
    kind[np.cumsum(sizes)] = document
    kind[0] = document
    solid = np.flatnonzero(kind)
    step = min(how.stride, how.limit)
    gaps = np.diff(solid)
    long = np.flatnonzero(gaps > step)
    if len(long):
        counts = (gaps[long] - 1) // step
        kind[np.repeat(solid[long], counts) + step * (1 + ragged(np.zeros_like(counts), counts))] = inner
    at = np.flatnonzero(kind)
    return at, np.array([0.0, how.inner_cut, how.sentence_cut, 0.0])[kind[at]] + how.window


def _powers(at: np.ndarray, limit: int) -> tuple[list[int], list[int]]:
    """Pairs of places (later, earlier) that lie a power of two apart, by the later one."""
    later, earlier = [], []
    power = 1
    while power <= limit:
        from_here = np.searchsorted(at, at - power)
        hit = np.flatnonzero(at[from_here] == at - power)
        later.append(hit)
        earlier.append(from_here[hit])
        power *= 2
    later, earlier = np.concatenate(later), np.concatenate(earlier)
    order = np.argsort(later, kind="stable")
    return later[order].tolist(), earlier[order].tolist()


def cheapest_cuts(at: np.ndarray, penalty: np.ndarray, limit: int) -> np.ndarray:
    """The places of the cheapest cuts, the first and the last place included."""
    later, earlier = _powers(at, limit)
    later.append(len(at))
    place, extra = at.tolist(), penalty.tolist()
    cost, shifted, came = [0.0], [0.0], [0]
    queue, head, k = [0], 0, 0
    for j in range(1, len(place)):
        here = place[j]
        lowest = here - limit
        while place[queue[head]] < lowest:
            head += 1
        origin = queue[head]
        best = shifted[origin] - lowest
        while later[k] == j:
            i = earlier[k]
            if cost[i] < best:
                best, origin = cost[i], i
            k += 1
        best += extra[j]
        cost.append(best)
        came.append(origin)
        best += here
        shifted.append(best)
        while len(queue) > head and shifted[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
    cuts = [len(place) - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return at[np.array(cuts[::-1])]


def padding(length: int, limit: int) -> int:
    """Tokens that fill a sequence up."""
    return 0 if length & (length - 1) == 0 else limit - length


def _encode(shared, how: Packing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(shared.value)
        end = np.array([how.end_id], dtype=words.dtype)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [np.concatenate((found, end)) for found in words.encode(part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())],
                    names=["doc_id", "print", "doc_tokens", "ids"],
                )

    return run


def _pieces(id_type: str, shared_ends, how: Packing):
    """Rows sorted by segment, salt and document to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, is_end = np.dtype(id_type), shared_ends.value
        current, counter, held, held_tokens = None, 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal counter, held, held_tokens
            if not held:
                return
            ids = [np.frombuffer(raw, dtype=dtype) for _, raw in held]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            run_ids = np.concatenate(ids)
            cuts = cheapest_cuts(*places(sizes, is_end[run_ids], how), how.limit)
            doc_starts = np.cumsum(sizes) - sizes
            edges = np.union1d(cuts, doc_starts)
            starts, lengths = edges[:-1], np.diff(edges)
            doc = np.searchsorted(doc_starts, starts, side="right") - 1
            window = np.searchsorted(cuts, starts, side="right") - 1
            segment, salt = current
            base = (segment << 43 | salt << _COUNTER_BITS) + counter
            counter += len(cuts) - 1
            run_ids = run_ids.astype("<u4")
            names = [held[i][0] for i in doc.tolist()]
            held, held_tokens = [], 0
            for low in range(0, len(starts), 4096):
                some = slice(low, low + 4096)
                raw = [run_ids[s : s + n].tobytes() for s, n in zip(starts[some].tolist(), lengths[some].tolist())]
                columns = [starts - doc_starts[doc], lengths, sizes[doc], base + window, starts - cuts[window]]
                start, length, doc_tokens, sequence, offset = (pa.array(c[some], pa.int64()) for c in columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[some], pa.int64()), start, length, pa.array(raw, pa.binary()), doc_tokens, sequence, offset],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

        for batch in batches:
            for segment, salt, doc_id, raw in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if (segment, salt) != current:
                    yield from flush()
                    current, counter = (segment, salt), 0
                elif held_tokens >= 2 * how.segment_tokens:
                    yield from flush()
                held.append((doc_id, raw))
                held_tokens += len(raw) // dtype.itemsize
        yield from flush()

    return run


def pack(docs: DataFrame, path: str, how: Packing = Packing()) -> DataFrame:
    """doc_id, start, length, ids (little-endian, 32 bits), doc_tokens, sequence_id and offset of every piece of ``docs``.

    ``docs`` has doc_id and text; other columns are ignored.  Tokens are those of
    the tokenizer file without added special tokens, then ``how.end_id``; a null or
    empty text is that id alone.  Rows that repeat a doc_id are packed one by one,
    ordered by a hash of their text; rows wholly equal are interchangeable.  A null doc_id is packed
    apart from the others.  Sequences are numbered within their segment, so numbers have
    gaps.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "packing")
    definition = Definition.read(path)
    shared, ends = (spark.sparkContext.broadcast(value) for value in (definition, sentence_ends(definition)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"))
    tokens = scratch.store(rows.mapInArrow(_encode(shared, how), "doc_id long, print long, doc_tokens long, ids binary"), "tokens")
    shared.destroy()
    total, low, high = tokens.agg(F.sum("doc_tokens"), F.min("doc_id"), F.max("doc_id")).first()
    wanted = max(how.segment_tokens, -(-(total or 0) // (_MOST_SEGMENTS - 2)))
    segments = -(-(total or 0) // wanted)
    # Segment 0 is that of rows without doc_id.
    width = float((high or 0) - (low or 0) + 1)
    place = (F.col("doc_id").cast("double") - F.lit(float(low or 0))) / F.lit(width) * F.lit(float(segments))
    segment = F.coalesce(F.least(F.floor(place), F.lit(max(segments - 1, 0))) + 1, F.lit(0)).cast("long")
    dealt = tokens.withColumn("segment", segment)
    crowded = dealt.groupBy("segment").agg(F.sum("doc_tokens").alias("held")).filter(F.col("held") > 2 * wanted)
    salts = crowded.select("segment", F.ceil(F.col("held") / F.lit(wanted)).cast("long").alias("salts"))
    # Each crowded segment holds two segments' tokens at least, so there are fewer than 2^19 of them.
    salted = dealt.join(F.broadcast(salts), "segment", "left").withColumn("salt", F.coalesce(F.pmod("print", "salts"), F.lit(0)).cast("long"))
    sorted_rows = salted.select("segment", "salt", "doc_id", "ids", "print").repartition("segment", "salt").sortWithinPartitions("segment", "salt", "doc_id", "print")
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return sorted_rows.select("segment", "salt", "doc_id", "ids").mapInArrow(_pieces(definition.id_type, ends, how), schema)

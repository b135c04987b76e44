"""Token counts by byte-pair merging with a heap and a linked list.

A pre-token's symbols stand in a doubly linked list; a heap holds its adjacent
pairs by merge rank, then position.  The lowest pair is popped and merged until
none is left.  The count is the number of initial symbols less the number of
merges; no ids are made.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.llm.byte_bpe import byte_characters
from dugout.llm.runtime import ship

REMEMBERED = 400_000


class Counter(dict):
    """Pre-token to its number of tokens, for a tokenizer file with word ends."""

    def __init__(self, definition: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        spec = json.loads(definition)
        model = spec["model"]
        vocabulary = model["vocab"]
        self._end = model["end_of_word_suffix"] or ""
        self._letters = byte_characters()
        self._vocabulary = vocabulary
        # Pair of symbols to (rank, merged symbol).
        self._merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self._merges[vocabulary[left], vocabulary[right]] = rank, vocabulary[left + right]
        special = [token["content"] for token in spec["added_tokens"]]
        self._special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self._marks = special
        # White space is dropped by the pattern, so of the normalizer only its letters matter.
        library = Tokenizer.from_str(definition)
        self._normalize, self._cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self._find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        count = self.merged(word)
        if len(word) <= 64:
            self[word] = count
        return count

    def merged(self, word: str) -> int:
        """Tokens of one pre-token."""
        return self._merged([self._letters[b] for b in word.encode()])

    def _merged(self, letters: list[str]) -> int:
        letters[-1] += self._end
        # A symbol outside the vocabulary gives no token.
        symbols = [s for s in map(self._vocabulary.get, letters) if s is not None]
        n, merges = len(symbols), self._merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*merges[pair], i) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in merges]
        heap = [(rank, i, symbol) for rank, symbol, i in heap]
        heapq.heapify(heap)
        done = 0
        while heap:
            rank, i, symbol = heapq.heappop(heap)
            j = after[i]
            # Entries of pairs that a merge has changed are stale.
            if symbols[i] is None or j < 0 or merges.get((symbols[i], symbols[j]), (None,))[0] != rank:
                continue
            done += 1
            symbols[i], symbols[j] = symbol, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((symbol, symbols[k])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((symbols[h], symbol))):
                heapq.heappush(heap, (found[0], h, found[1]))
        return n - done

    def count(self, text: str) -> int:
        """Tokens of a text; the file's special strings inside it are one token each."""
        if self._special is None or not any(mark in text for mark in self._marks):
            return self._plain(text)
        return len(self._special.findall(text)) + sum(map(self._plain, self._special.split(text)))

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings.

        Below U+0250 composition changes nothing, lowering is plain and all
        Unicode versions agree on letters; other texts are normalised and cut
        by the file's own rules, in the version the library knows.
        """
        if text.isascii() or max(text) < "\u0250":
            return sum(map(self.__getitem__, self._find(text.lower())))
        return sum(self._merged(list(piece)) for piece, _ in self._cut(self._normalize(text)))


_COUNTERS: dict[int, Counter] = {}


def _counter(definition: str) -> Counter:
    key = hash(definition)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(definition)
    return _COUNTERS[key]


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            counts = [counter.count(text.as_py() or "") for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs``.

    A null text counts as empty: no bytes, no tokens.  Nothing is cut off or
    added.  Repeated rows are counted alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = sized.mapInArrow(_count(shared), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

"""Benchmark decontamination by Wu-Manber search over words.

The test strings are windows of an item's consecutive words.  Per length of
window there is a shift table: for the block of two words that ends at the
current place it tells how far the search may move on without missing an
occurrence.  Where it says nothing may be skipped, the block's bucket holds the
windows that end with it, and each is compared directly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.llm.runtime import releasing, ship

#: A-Z lowered; every other byte below 0x80 that is neither digit nor letter becomes a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


@dataclass
class Patterns:
    """Shift table and suffix buckets of the windows of one length."""

    length: int
    shifts: dict = field(default_factory=dict)
    buckets: dict = field(default_factory=dict)

    @property
    def block(self) -> int:
        return min(2, self.length)

    def key(self, text: list[bytes], end: int):
        """The block of words that ends before ``end``."""
        return (text[end - 2], text[end - 1]) if self.length > 1 else text[end - 1]

    def add(self, window: list[bytes], item: str | None) -> None:
        for end in range(self.block, self.length + 1):
            key = self.key(window, end)
            self.shifts[key] = min(self.shifts.get(key, self.length), self.length - end)
        bucket = self.buckets.setdefault(self.key(window, self.length), {})
        bucket.setdefault(tuple(window), set()).add(item)

    def search(self, text: list[bytes], hit: set[int], items: set) -> None:
        """Add the places of words inside occurrences, and the items they belong to."""
        m, n = self.length, len(text)
        shifts, buckets, free = self.shifts, self.buckets, self.length - self.block + 1
        end = m
        while end <= n:
            key = (text[end - 2], text[end - 1]) if m > 1 else text[end - 1]
            shift = shifts.get(key, free)
            if shift:
                end += shift
                continue
            found = tuple(text[end - m : end])
            for window, owners in buckets[key].items():
                if window == found:
                    hit.update(range(end - m, end))
                    items.update(owners)
            end += 1


def tables(items: list[tuple[str | None, str | None]], window: int) -> list[Patterns]:
    """Search tables of all windows of the items; an item of fewer words, but not none, is one window."""
    by_length: dict[int, Patterns] = {}
    for item, text in items:
        found = words(text)
        width = min(window, len(found))
        for start in range(len(found) - width + 1 if width else 0):
            by_length.setdefault(width, Patterns(width)).add(found[start : start + width], item)
    return list(by_length.values())


_TABLES: dict[str, list[Patterns]] = {}


def _search(shared, window: int, name: str, all_rows: bool):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _TABLES:
            _TABLES.clear()
            _TABLES[name] = tables(shared.value, window)
        patterns = _TABLES[name]
        for batch in batches:
            counts, hits, items, keep = [], [], [], []
            for i, text in enumerate(batch.column(2)):
                found = words(text.as_py())
                hit: set[int] = set()
                owners: set = set()
                for pattern in patterns:
                    pattern.search(found, hit, owners)
                if hit or all_rows:
                    keep.append(i)
                    counts.append(len(found))
                    hits.append(sorted(hit))
                    items.append(sorted(o for o in owners if o is not None))
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "print", "n_words", "hits", "items"],
            )

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of bounded size, one at a time; at least one block."""
    block, size, given = [], 0, False
    for row in benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).toLocalIterator():
        block.append((row["item"], row["text"]))
        size += len(row["text"] or "") + 32
        if size >= block_bytes:
            yield block
            block, size, given = [], 0, True
    if block or not given:
        yield block


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, hits (places of words inside an occurrence) and items (those that occur) of every row of ``docs``.

    ``benchmark`` has item_id and text.  It is taken in blocks of ``block_bytes``
    of text, each broadcast and searched in all documents, and the blocks' hits
    are united, so it may be of any size.  A null or wordless text has no words
    and no hits; a null or wordless item has no window; an item without id hits
    but is not listed.  Rows that repeat are judged alike.  An empty benchmark
    hits nothing, an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, print long, n_words long, hits array<int>, items array<string>"
    found = more = None
    for i, block in enumerate(_blocks(benchmark, block_bytes)):
        shared = spark.sparkContext.broadcast(block)
        searched = rows.mapInArrow(_search(shared, window, f"{id(shared)}-{i}-{hash(str(block))}", all_rows=not i), schema)
        if not i:
            found = searched
        else:
            more = searched if more is None else more.unionAll(searched)
    if more is None:
        return found.drop("print")
    # Hits follow from a text alone, so a text's hash is key enough.
    united = more.groupBy("print").agg(
        F.array_distinct(F.flatten(F.collect_set("hits"))).alias("more_hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("more_items")
    )
    both = found.join(united, "print", "left")

    def union(name: str):
        return F.array_sort(F.array_union(name, F.coalesce(f"more_{name}", F.array().cast(found.schema[name].dataType)))).alias(name)

    return both.select("doc_id", "n_words", union("hits"), union("items"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` in whose text no window of the benchmark occurs; all columns stay."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    hit = contaminated_words(texts, benchmark, window).filter(F.size("hits") > 0).select(F.col("doc_id").alias("print")).distinct()
    # Packed, so that no column's name can meet one used here.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("text").alias("print"))
    return rows.join(hit, "print", "left_anti").select("row.*")

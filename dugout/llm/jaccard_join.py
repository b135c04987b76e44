"""N-gram Jaccard join with token-combination prefixes.

Two texts link when the Jaccard similarity of their shingle sets reaches a
threshold.  The shingles of a set are put into one order that holds for the
whole corpus; a set of n shingles may miss ``n - ceil(threshold * n)`` of those
of a partner.  Its prefix is extended until it survives so many losses: a rare
shingle counts one and is indexed alone; frequent shingles are dealt into small
groups, a group of x counts x - 1, and every pair of a group is indexed.  Two
linked sets therefore share an indexed shingle or pair, whatever the order.  As
chance alone makes sets share one, prefixes are extended by some more, up to
three, and candidates have to share as many more entries.

Order: shingles that no other text has, then rare ones, then frequent ones; how
many texts have each shingle is counted over the whole corpus.  Two bit tables of
fixed size (16 and 2 MB) tell which shingles occur more than once and which are
frequent; when a corpus fills them they only cost candidates, never links.  Shingles of no other text need no entry, and their number bounds
what a set can share: most pairs below the threshold are told by it alone.

Sets that are equal are one class.  Within an index entry the classes are first
compared with one of them only, its pivot: that with the fewest shingles of its own, which
of a family of near copies is the closest to all; those whose components still differ are
then compared with each other.  What two of them share lies in the pivot or outside.  In the
pivot it is what one has there less what the other misses, outside what one has less what
the other lacks; bitmaps of 256 bits, made when a class was compared with the pivot, count
such shingles from below.  So nearly all pairs of a family that reach no threshold are told
by their bitmaps; sets of some thousand shingles fill them, and more pairs are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dugout.llm.components import components
from dugout.llm.runtime import Scratch, release, releasing, ship
from dugout.llm.shingles import Shingler, mix

#: Bits of the tables; of a shingle, its 32 leading bits are counted.
BITS, FREQUENT_BITS = 27, 24
_COUNT_SHIFT = np.uint64(32)
#: A shingle in more texts than this is frequent.
FREQUENT = 16
#: Shingles that a worker sorts and counts at a time.
_FLUSH = 1 << 19
#: Words of 64 bits in a trace, the bitmap of what a set and its pivot do not share.
_TRACE = range(4)


@dataclass(frozen=True)
class Threshold:
    """A similarity as a fraction, so that the comparison is exact."""

    over: int = 80
    of: int = 100

    def __post_init__(self):
        # Up to a half, sets of one shingle link with larger ones, which no entry would find.
        if not self.of < 2 * self.over <= 2 * self.of:
            raise ValueError("a threshold lies above a half and not above one")

    def least(self, n: int) -> int:
        return -(-self.over * n // self.of)


def shared_entries(n: int) -> int:
    """Entries that a set of n shares at least with a linked one of no smaller demand."""
    return min(4, max(1, n // 8))


_SHARED_SQL = "least(4, greatest(1, {} div 8))"
#: Slots of the table that tells the map side whose sets are wanted: 2 MB of bits.
_SLOT_BITS = 24


def set_number(shingles: np.ndarray) -> int:
    """One signed 64-bit number for a set: a class of equal sets."""
    if not len(shingles):
        return 0
    total = np.add.reduce(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)))
    return int(mix(np.array([total + np.uint64(len(shingles))], dtype=np.uint64)).view(np.int64)[0])


def _blocks(spark) -> int:
    """Bits of the number of count blocks: as many blocks as the session has shuffle partitions, 64 at least."""
    return min(16, max(6, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))


def _count(width: int, block_bits: int):
    """Per block of the hash space, how many texts have each of its shingles."""
    n_blocks = 1 << block_bits

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size, met = Shingler(width), [], 0, set()

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            counts = np.minimum(counts, 255).astype(np.uint8)
            edges = np.searchsorted(values >> np.uint32(32 - block_bits), np.arange(n_blocks + 1))
            some = [b for b in range(n_blocks) if edges[b] < edges[b + 1]]
            packed = [values[edges[b] : edges[b + 1]].tobytes() + counts[edges[b] : edges[b + 1]].tobytes() for b in some]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"])

        for batch in batches:
            for shingles in shingler.sets(batch.column(0)):
                # Copies of one set make no shingle common, as far as a task sees them.
                if (number := set_number(shingles)) in met:
                    continue
                met.add(number)
                held.append((shingles >> _COUNT_SHIFT).astype("<u4"))
                size += len(shingles)
                if size >= _FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return run


def _merge_block(group: pa.Table, frequent: int, block_bits: int) -> pa.Table:
    """Merge a block's counts to its slices of the two bit tables."""
    values, counts = [], []
    for blob in group.column("counts"):
        raw = blob.as_buffer()
        n = len(raw) // 5
        values.append(np.frombuffer(raw, dtype="<u4", count=n))
        counts.append(np.frombuffer(raw, dtype=np.uint8, offset=4 * n))
    values, counts = np.concatenate(values), np.concatenate(counts)
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    values, counts = values[first], np.add.reduceat(counts[order].astype(np.uint32), first)
    slices = []
    for least, bits in ((2, BITS), (frequent + 1, FREQUENT_BITS)):
        width = 1 << (bits - block_bits)
        marks = np.zeros(width, dtype=bool)
        marks[(values[counts >= least] >> np.uint32(32 - bits)).astype(np.int64) & (width - 1)] = True
        slices.append(pa.array([np.packbits(marks).tobytes()], pa.binary()))
    return pa.table([group.column("block").slice(0, 1), *slices], names=["block", "repeated", "frequent"])


def bit_tables(counts: DataFrame, frequent: int, block_bits: int) -> tuple[bytearray, bytearray]:
    """Both tables, whole; the driver receives slices of 18 MB in all, whatever the corpus holds."""
    out = bytearray(1 << (BITS - 3)), bytearray(1 << (FREQUENT_BITS - 3))

    def merge(group: pa.Table) -> pa.Table:
        merged = _merge_block(group, frequent, block_bits)
        release()
        return merged

    for row in counts.groupBy("block").applyInArrow(merge, "block int, repeated binary, frequent binary").toLocalIterator():
        for table, part in zip(out, (row.repeated, row.frequent)):
            table[row.block * len(part) : (row.block + 1) * len(part)] = part
    return out


def bands(n: int, threshold: Threshold) -> list[int]:
    """Size bands in which a set of n is indexed; linked sets share that of the smaller one."""
    return list(range(max(1, threshold.least(n)).bit_length(), n.bit_length() + 1))


def index_keys(shingles: np.ndarray, threshold: Threshold, is_repeated, is_frequent) -> tuple[np.ndarray, int]:
    """Indexed shingles and pairs of one set, as 64-bit numbers, and how many shingles are known to be in no other set."""
    n = len(shingles)
    if n < 2:
        return shingles[:0], 0  # links only with its equals, which are one class
    need = n - threshold.least(n) + shared_entries(n)
    repeated = shingles[is_repeated(shingles)]
    lost = n - len(repeated)
    need -= lost
    if need <= 0:
        return shingles[:0], lost
    common = is_frequent(repeated)
    rare = repeated[~common][:need]
    if len(rare) == need:
        return rare, lost
    frequent = repeated[common]
    out = [rare]
    for band in bands(n, threshold):
        short, groups = need - len(rare), 1 << max(0, band - 6)
        group = (mix(frequent) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        opens = np.ones(len(frequent), dtype=bool)
        opens[order[1:]] = group[order[1:]] != group[order[:-1]]
        covered = np.cumsum(~opens)
        cut = int(np.searchsorted(covered, short)) + 1 if len(covered) and covered[-1] >= short else len(frequent)
        members, group = frequent[:cut], group[:cut]
        order = np.argsort(group, kind="stable")
        members, group = members[order], group[order]
        salt = mix(np.array([band], dtype=np.uint64))
        reach = 1
        while reach < len(members):
            together = group[reach:] == group[:-reach]
            if not together.any():
                break
            # Members of a group stand in ascending order, so a pair has one number.
            out.append(mix(members[:-reach][together] * np.uint64(0x9E3779B97F4A7C15) + mix(members[reach:][together]) + salt))
            reach += 1
    return np.unique(np.concatenate(out)), lost


def _index(width: int, threshold: Threshold, tables):
    """Index entries (key, class, lost) and, with a null key, each row's doc_id, row number, n_shingles, class and lost."""
    names = ["key", "class", "doc_id", "row", "n_shingles", "lost"]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        repeated, frequent = (np.frombuffer(t, dtype=np.uint8) for t in tables.value)

        def member(table, bits):
            shift = np.uint64(64 - bits)

            def test(values: np.ndarray) -> np.ndarray:
                at = (values >> shift).astype(np.int64)
                return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1

            return test

        tests = member(repeated, BITS), member(frequent, FREQUENT_BITS)
        for batch in batches:
            keys, owners, losses, size, rows = [], [], [], 0, []
            for shingles in shingler.sets(batch.column(1)):
                found, lost = index_keys(shingles, threshold, *tests)
                rows.append((set_number(shingles), len(shingles), lost))
                if len(found):
                    keys.append(found)
                    owners.append(np.full(len(found), rows[-1][0], dtype=np.int64))
                    losses.append(np.full(len(found), lost, dtype=np.int64))
                    size += len(found)
                if size > 1 << 18:
                    yield entries(keys, owners, losses)
                    keys, owners, losses, size = [], [], [], 0
            if size:
                yield entries(keys, owners, losses)
            if rows:
                classes, sizes, losses = (pa.array(c, pa.int64()) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), classes, batch.column(0), batch.column(2), sizes, losses], names=names)

    def entries(keys, owners, losses) -> pa.RecordBatch:
        columns = [np.concatenate(keys).view(np.int64), np.concatenate(owners), np.concatenate(losses)]
        none = pa.nulls(len(columns[0]), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), none, none, none, pa.array(columns[2])], names=names)

    return run


def _row_number(doc_id="doc_id") -> Column:
    """One number for a doc_id, which may be null, and its text."""
    return F.xxhash64(doc_id, "text")


def _slot() -> Column:
    return F.pmod("row", F.lit(1 << _SLOT_BITS)).cast("int").alias("slot")


def _slot_table(wanted: DataFrame) -> bytes:
    """One bit per slot that holds a wanted row; of fixed size, put together on the executors."""
    block_bits = 6
    width = 1 << (_SLOT_BITS - block_bits)

    def pack(group: pa.Table) -> pa.Table:
        bits = np.zeros(width, dtype=bool)
        bits[group.column("slot").to_numpy() & (width - 1)] = True
        return pa.table({"block": group.column("block").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = bytearray((1 << _SLOT_BITS) // 8)
    slots = wanted.select(_slot()).distinct().withColumn("block", F.shiftright("slot", _SLOT_BITS - block_bits))
    for row in slots.groupBy("block").applyInArrow(pack, "block int, bits binary").toLocalIterator():
        out[row.block * width // 8 : (row.block + 1) * width // 8] = row.bits
    return bytes(out)


def _sets(width: int, table):
    """(class, shingles) of the rows whose slot is marked, a class once per task."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, met = Shingler(width), set()
        bits = np.frombuffer(table.value, dtype=np.uint8)
        for batch in batches:
            slot = batch.column(1).to_numpy()
            marked = batch.column(0).filter(pa.array((bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1))
            offsets, parts, classes = [0], [], []

            def rows() -> pa.RecordBatch:
                values = pa.array(np.concatenate(parts).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                return pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), lists], names=["class", "shingles"])

            for shingles in shingler.sets(marked):
                if (number := set_number(shingles)) in met:
                    continue
                met.add(number)
                parts.append(shingles)
                classes.append(number)
                offsets.append(offsets[-1] + len(shingles))
                if offsets[-1] > 1 << 18:
                    yield rows()
                    offsets, parts, classes = [0], [], []
            if classes:
                yield rows()

    return run


def _trace_sql(word: int, shingles: str) -> str:
    """One word of the bitmap of some shingles: a shingle's two lowest bits choose the word, the next six the bit."""
    return f"aggregate(filter({shingles}, v -> (v & 3) = {word}), 0L, (bits, v) -> bits | shiftleft(1L, cast(shiftright(v, 2) & 63 as int)))"


def _apart_sql(name: str, a: str, b: str) -> str:
    """How many shingles that ``a`` has in its trace ``b`` has not, at least."""
    return "(" + " + ".join(f"bit_count({a}.{name}{word} & ~{b}.{name}{word})" for word in _TRACE) + ")"


def _shared_at_most_sql() -> str:
    """What classes x and y of an entry can share, by what each has inside its pivot and outside."""
    inside = f"least(x.inside - {_apart_sql('missing', 'y', 'x')}, y.inside - {_apart_sql('missing', 'x', 'y')})"
    outside = f"least(x.n - x.inside - {_apart_sql('extra', 'x', 'y')}, y.n - y.inside - {_apart_sql('extra', 'y', 'x')}, x.most - x.inside, y.most - y.inside)"
    # A class that was not compared with the pivot has no trace: null.
    return f"least(x.most, y.most, coalesce({inside} + {outside}, x.most))"


def _compared(pairs: DataFrame, sets: DataFrame, threshold: Threshold, traced: bool) -> DataFrame:
    """Candidate pairs (a, b), how many shingles they share, by direct comparison, and whether that reaches the threshold.

    ``traced``: also the traces of what b misses of a and of what it has besides.
    """
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    traces = [
        f"{_trace_sql(word, f'array_except({own}, {other})')} AS {name}{word}"
        for name, own, other in (("missing", "left", "right"), ("extra", "right", "left"))
        for word in _TRACE
        if traced
    ]
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", both.alias("both"), (F.size("left") + F.size("right")).alias("sizes"), *map(F.expr, traces))
        .withColumn("linked", F.expr(f"{threshold.of} * both >= {threshold.over} * (sizes - both)"))
    )


def _linked_classes(docs: DataFrame, width: int, threshold: Threshold, frequent: int) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id, row number, n_shingles and class; the component of each class that links reach."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    block_bits = _blocks(spark)
    counts = docs.select("text").mapInArrow(_count(width, block_bits), "block int, counts binary")
    tables = spark.sparkContext.broadcast(bit_tables(counts, frequent, block_bits))
    indexed = docs.select("doc_id", "text", _row_number()).mapInArrow(
        _index(width, threshold, tables), "key long, class long, doc_id long, row long, n_shingles long, lost long"
    )
    index = scratch.store(indexed, "index")
    tables.destroy()
    described = index.filter("key is null")
    sizes = scratch.store(described.select("doc_id", "row", "n_shingles", "class"), "sizes")

    # Entries with one class say nothing.
    # A class's place: first those with few shingles of their own; the class breaks ties.
    place = F.shiftleft(F.least("lost", F.lit((1 << 20) - 1)), 43).bitwiseOR(F.col("class").bitwiseAND(F.lit((1 << 43) - 1))).alias("place")
    entries = index.filter("key is not null").select("key", "class", place)
    first = entries.groupBy("key").agg(F.min("place").alias("place"), F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high")
    classes = described.filter("n_shingles > 1").groupBy("class")
    known = scratch.store(classes.agg(F.min("row").alias("row"), F.min("n_shingles").alias("n"), F.max("lost").alias("lost")), "classes")
    told = known.select("class", "n", "lost", place)
    # Classes of one place are rare and any of them serves as the pivot of both one's entries.
    pivots = first.select("key", "place").join(told.groupBy("place").agg(F.min("class").alias("pivot")), "place").select("key", "pivot")
    shared = scratch.store(entries.drop("place").join(pivots, "key").distinct().join(told.drop("place"), "class"), "shared")
    scratch.drop(index)

    def reach(both: str, n_a: str, n_b: str) -> str:
        """Whether sets of these sizes that share at most so much can reach the threshold."""
        return f"{threshold.of} * {both} >= {threshold.over} * ({n_a} + {n_b} - {both})"

    def compared(counted: DataFrame, traced: bool) -> DataFrame:
        """Pairs (a, b, n_a, n_b, entries) with what they share; those with too few entries go unseen."""
        demand = f"least({_SHARED_SQL.format('n_a')}, {_SHARED_SQL.format('n_b')})"
        pairs = scratch.store(counted.filter(f"entries >= {demand}").select("a", "b"), "pairs")
        wanted = known.join(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "class").select("row", "class")
        table = spark.sparkContext.broadcast(_slot_table(wanted))
        marked = docs.select("text", _row_number().alias("row")).select("text", _slot()).mapInArrow(_sets(width, table), "class long, shingles array<long>")
        # By class alone: doc_ids may be null or repeat, and rows of one class have one set.
        sets = scratch.store(marked.join(wanted.select("class"), "class").dropDuplicates(["class"]), "sets")
        table.destroy()
        out = scratch.store(_compared(pairs, sets, threshold, traced), "compared")
        scratch.drop(sets, pairs)
        return out

    stars = (
        shared.filter("class != pivot")
        .groupBy(F.col("pivot").alias("a"), F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("lost").alias("lost_b"))
        .agg(F.count("*").alias("entries"))
    )
    of_pivot = told.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("lost").alias("lost_a"))
    near = F.expr(reach("least(n_a - lost_a, n_b - lost_b)", "n_a", "n_b"))
    around = compared(stars.join(of_pivot, "a").filter(near).select("a", "b", "n_a", "n_b", "entries"), traced=True)
    links = around.filter("linked").select("a", "b")

    reached = components(links, scratch)
    placed = shared.join(reached, F.col("node") == F.col("class"), "left").select(
        "key", "class", "pivot", "n", "lost", F.coalesce("component", "class").alias("component")
    )
    torn = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    # What a class has inside its entry's pivot, and the traces; a pivot has all and misses nothing.
    names = [f"{name}{word}" for name in ("missing", "extra") for word in _TRACE]
    overlaps = around.select(F.col("a").alias("pivot"), F.col("b").alias("class"), "both", *names)
    own = F.col("class") == F.col("pivot")
    open_entries = scratch.store(
        placed.join(torn, "key")
        .join(overlaps, ["pivot", "class"], "left")
        .select(
            "key", "class", "component", "n", (F.col("n") - F.col("lost")).alias("most"), F.when(own, F.col("n")).otherwise(F.col("both")).alias("inside"),
            *(F.when(own, F.lit(0).cast("long")).otherwise(F.col(name)).alias(name) for name in names),
        ),
        "open",
    )
    one, other = open_entries.alias("x"), open_entries.alias("y")
    at_most = reach(_shared_at_most_sql(), "x.n", "y.n")
    apart = (F.col("x.key") == F.col("y.key")) & F.expr("x.component != y.component and x.class < y.class and " + at_most)
    # Entries that two classes of different components share are all torn, and no entry's bound
    # refuses a pair that links, so the count of such a pair is whole.
    across = (
        one.join(other, apart)
        .groupBy(F.col("x.class").alias("a"), F.col("y.class").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))
        .agg(F.count("*").alias("entries"))
    )
    more = compared(across, traced=False).filter("linked").select("a", "b")
    scratch.drop(open_entries, shared, known)

    return sizes, components(links.unionAll(more), scratch)


def near_duplicates(docs: DataFrame, width: int = 5, threshold: Threshold = Threshold(), frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text; other columns are ignored).

    The component is the smallest doc_id reached by links.  A null or wordless
    text has an empty set and links with nothing, itself being its component.
    Equal sets link at any threshold.  Rows that repeat a doc_id each give a row;
    a null doc_id joins like any other and is never the smallest unless alone.
    An empty table gives no rows.
    """
    sizes, reached = _linked_classes(docs, width, threshold, frequent)
    # Smallest doc_id of each component, through the classes.
    per_class = sizes.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("smallest"))
    grouped = per_class.join(reached, F.col("node") == F.col("class"), "left").select("class", F.coalesce("component", "class").alias("component"), "smallest")
    smallest = grouped.groupBy("component").agg(F.min("smallest").alias("component_id"))
    of_class = grouped.join(smallest, "component").select("class", "component_id")
    full = sizes.filter("n_shingles > 0").join(of_class, "class").select("doc_id", "n_shingles", "component_id")
    empty = sizes.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionAll(empty)


def one_per_group(docs: DataFrame, width: int = 5, threshold: Threshold = Threshold()) -> DataFrame:
    """One row of ``docs`` of each group of near copies, that with the smallest doc_id; all columns stay.

    A null doc_id comes last; rows of one doc_id in a group are told apart by a
    hash of their text, and of rows that repeat both one stays.  Rows without
    words all stay.
    """
    sizes, reached = _linked_classes(docs, width, threshold, FREQUENT)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    per_class = sizes.filter("n_shingles > 0").groupBy("class").agg(first)
    grouped = per_class.join(reached, F.col("node") == F.col("class"), "left").select(F.coalesce("component", "class").alias("component"), "first")
    leaders = grouped.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("leader"), F.col("first.row").alias("leading"))
    # Packed, so that no column's name can meet one used here.
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("body"),
        _row_number(F.col("doc_id").cast("long")).alias("number"),
    )
    worded = F.col("body").rlike(r"[^\x20\x09-\x0D]")
    kept = rows.filter(worded).join(leaders, (F.col("number") == F.col("leading")) & F.col("id").eqNullSafe(F.col("leader")), "left_semi")
    repeat = F.row_number().over(W.partitionBy("id", "body").orderBy(F.lit(0)))
    return kept.withColumn("repeat", repeat).filter("repeat = 1").select("row.*").unionAll(rows.filter(~worded).select("row.*"))

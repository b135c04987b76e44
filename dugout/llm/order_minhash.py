"""Order MinHash fingerprints, in DataFrame functions only.

A text's k-mers are runs of k words.  Each gets the number of its earlier
occurrences in the text; the numbered k-mers are hashed, and the leading bits of
the hash deal them into bins.  From each bin the smallest few are selected, put
back into text order, and their k-mers are hashed as one tuple.  Tuples agree
when the same k-mers are selected *in the same order*, so the share of agreeing
bins follows edit distance rather than set similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: log2 of the bins, k-mers selected per bin, words of a k-mer.
BIN_BITS, SELECTED, K = 6, 2, 2
#: A k-mer is one number: 40 bits of its hash, then 24 bits of its place (of 16 million words; places beyond start anew).
PLACE_BITS = 24
_PLACE = (1 << PLACE_BITS) - 1


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_PLACE))


def _packed(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place.cast("long").bitwiseAND(F.lit(_PLACE)))


def _numbered(kmers: Column) -> Column:
    """K-mers, sorted by hash and place, with the hash of (k-mer, number of earlier occurrences) instead.

    Equal k-mers stand together, so an entry's number is the longest step back
    that still meets an equal one; it is found by halving the step.
    """

    def same(i: Column, back: Column, x: Column) -> Column:
        return F.coalesce(F.shiftright(F.get(kmers, i - back), PLACE_BITS) == F.shiftright(x, PLACE_BITS), F.lit(False))

    def number(i: Column, x: Column) -> Column:
        steps = F.array(*(F.lit(1 << s) for s in range(30, -1, -1)))
        return F.aggregate(steps, F.lit(0), lambda got, step: F.when(same(i, got + step, x), got + step).otherwise(got))

    return F.transform(kmers, lambda x, i: F.when(same(i, F.lit(1), x), _packed(F.xxhash64(F.shiftright(x, PLACE_BITS), number(i, x)), _place(x))).otherwise(x))


def with_fingerprint(frame: DataFrame, text: str, out: str, k: int = K, bin_bits: int = BIN_BITS, selected: int = SELECTED) -> DataFrame:
    """Add ``out``, the fingerprint of ``text``: per bin that has k-mers its number and tuple in hex, two and eight digits.

    A null text counts as empty; an empty or blank text has one empty k-mer, a
    text of fewer than k words one k-mer of them all.  Texts with equal words
    have equal fingerprints, equal texts so too.
    """
    words = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: F.xxhash64(w))
    frame = frame.withColumn("_words", words)
    every = F.col("_words")
    runs = F.transform(every, lambda w, i: _packed(F.xxhash64(w, *(F.get(every, i + step) for step in range(1, k))), i))
    # Runs that would pass the end fall away; a short text keeps its first, which holds all its words.
    frame = frame.withColumn("_kmers", F.sort_array(F.slice(runs, 1, F.greatest(F.size(every) - (k - 1), F.lit(1)))))
    frame = frame.withColumn("_kmers", F.sort_array(_numbered(F.col("_kmers"))))
    low = F.col("_kmers")

    def bin_of(x: Column) -> Column:
        return F.shiftright(x, 64 - bin_bits)

    def entry(x: Column, i: Column) -> Column:
        fewest = F.filter(F.slice(low, i + 1, F.lit(selected)), lambda y: bin_of(y) == bin_of(x))
        # Place first, so that sorting restores the order of the text; the tuple is of the k-mers alone.
        ordered = F.sort_array(F.transform(fewest, lambda y: F.shiftleft(_place(y), 64 - PLACE_BITS).bitwiseOR(F.shiftrightunsigned(y, PLACE_BITS))))
        hashed = F.xxhash64(F.transform(ordered, lambda y: F.shiftleft(y, PLACE_BITS)))
        number = F.lpad(F.hex((bin_of(x) + (1 << (bin_bits - 1))).cast("long")), 2, "0")
        return F.lower(F.substring(F.concat(number, F.lpad(F.hex(hashed), 16, "0")), 1, 10))

    def heads(x: Column, i: Column) -> Column:
        return F.when((i == 0) | F.coalesce(bin_of(F.get(low, i - 1)) != bin_of(x), F.lit(True)), entry(x, i))

    return frame.withColumn(out, F.array_join(F.transform(low, heads), " ")).drop("_words", "_kmers")


def likeness(left: Column, right: Column) -> Column:
    """Share of agreeing bins among those that either fingerprint has; 0 to 1."""
    ours, theirs = F.split(left, " "), F.split(right, " ")

    def bins(entries: Column) -> Column:
        return F.transform(entries, lambda e: F.substring(e, 1, 2))

    return F.size(F.array_intersect(ours, theirs)) / F.size(F.array_union(bins(ours), bins(theirs)))


def with_next(docs: DataFrame, carried: dict[str, str], derive, blocks: int) -> DataFrame:
    """Add columns of the next document in descending doc_id; after the last comes the first.

    ``derive`` adds the columns that ``carried`` names (column of the next one to
    new name).  Documents are dealt into ranges of doc_id by approximate
    quantiles; the next one is a window within a range, and for a range's last
    document the first one of the following range.  Of these firsts there is one
    per range, and only for them the columns are derived again.
    """
    ids = docs.select("doc_id")
    fractions = [i / blocks for i in range(1, blocks)]
    cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", fractions, 10 * blocks)).first()[0] or []))

    # The number of cuts up to doc_id; a null belongs before all.
    range_of = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= F.col("doc_id"))) if cuts else F.lit(0)
    ranged = docs.withColumn("_range", range_of)
    w = W.partitionBy("_range").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    here = derive(ranged).select("*", *(F.lead(c).over(w).alias(new) for c, new in carried.items()), F.lead(F.lit(1)).over(w).isNull().alias("_last"))

    heads = [row.head for row in ids.withColumn("_range", range_of).groupBy("_range").agg(F.max("doc_id").alias("head")).collect()]
    among = F.col("doc_id").isin([h for h in heads if h is not None])
    if None in heads:
        among = among | F.col("doc_id").isNull()
    first_of = ranged.filter(among).groupBy("_range").agg(F.min(F.struct("text")).alias("_text"), F.max("doc_id").alias("doc_id"))
    firsts = derive(first_of.select("_range", "doc_id", F.col("_text.text").alias("text")))
    following = W.orderBy(F.col("_range").desc())
    ends = firsts.select("_range", F.struct(*carried).alias("_first")).select(
        F.col("_range").alias("_of"), F.coalesce(F.lead("_first").over(following), F.first("_first").over(following)).alias("_next")
    )
    joined = here.join(ends, (F.col("_range") == F.col("_of")) & F.col("_last"), "left")
    return joined.select(
        *(c for c in here.columns if c not in ("_range", "_last", *carried.values())),
        *(F.when(F.col("_last"), F.col("_next")[c]).otherwise(F.col(new)).alias(new) for c, new in carried.items()),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness.

    ``docs`` has doc_id and text, other columns are ignored.  The edited text has
    its last floor(n/2) code points replaced by the first as many (or all) of the
    next document's.  A null text counts as empty.  Rows that repeat a doc_id
    follow each other by text; null ids come last.  A lone document is its own next one.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    blocks = max(64, min(2048, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(docs, {"text": "next_text", "fingerprint": "next_fingerprint"}, lambda frame: with_fingerprint(frame, "text", "fingerprint"), blocks)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    paired = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    printed = with_fingerprint(paired, "edited", "edited_fingerprint")
    return printed.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )

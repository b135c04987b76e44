import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dugout.llm import packing
from dugout.llm.queries import QUERIES
from dugout.llm.word_ids import Definition, WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_are_the_library(library):
    import random

    rng = random.Random(2)
    alphabet = "'stmdrevl aÉé½1<|>\n\x1f\x85\xa0.!İ中"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", "<|endoftext|>x", "it's 'sabc ''s", "x" * 70_000 + " '" + "!" * 500, "\U0001d400 ſ's K'K"]
    words = WordIds(Definition.read(PATH))
    assert [ids.tolist() for ids in words.encode([*texts, None])] == [*(library.encode(t, add_special_tokens=False).ids for t in texts), []]


def cheapest(at, penalty, limit):
    """Every pair of places, no queue."""
    cost, came = [0.0], [0]
    for j in range(1, len(at)):
        options = [(cost[i] + packing.padding(int(at[j] - at[i]), limit), i) for i in range(j) if at[j] - at[i] <= limit]
        best = min(options, key=lambda o: o[0])
        cost.append(best[0] + penalty[j])
        came.append(best[1])
    return cost


@pytest.mark.parametrize("limit", [16, 64, 100])
def test_cuts_cost_as_little_as_the_plain_recurrence(limit):
    rng = np.random.default_rng(limit)
    for n in (1, 2, 30, 120):
        sizes = rng.integers(1, 40, n)
        how = packing.Packing(limit=limit, stride=8, sentence_cut=3, inner_cut=9, window=0.5)
        at, penalty = packing.places(sizes, rng.random(sizes.sum()) < 0.1, how)
        assert at[0] == 0 and at[-1] == sizes.sum() and np.diff(at).max() <= 8
        cuts = packing.cheapest_cuts(at, penalty, limit)
        spent = sum(packing.padding(int(b - a), limit) for a, b in zip(cuts, cuts[1:])) + sum(penalty[np.searchsorted(at, c)] for c in cuts[1:])
        assert spent == pytest.approx(cheapest(at, penalty, limit)[-1]) and np.diff(cuts).max() <= limit


def whole(pieces, texts, library, limit):
    """Every id lies in one piece, pieces fill sequences without gaps, and padding is the sum returned."""
    by_row, by_sequence = {}, {}
    for p in pieces:
        by_row.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_row.keys() == texts.keys()
    for doc_id, own in by_row.items():
        ids, at = ids_of(library, texts[doc_id]), 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    pad = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= limit
        pad += packing.padding(at, limit)
    return pad, sum(p.length for p in pieces)


def test_query_packs_every_id_once(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pad, tokens = whole(QUERIES["op11_packing"](spark, SMALL).collect(), {r.doc_id: r.text for r in docs.collect()}, library, 4096)
    assert pad < 0.01 * tokens


def test_same_sequences_whatever_the_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    how = packing.Packing(limit=256, segment_tokens=20_000)
    results = [sorted(tuple(map(str, r)) for r in packing.pack(docs.repartition(n), PATH, how).collect()) for n in (1, 7)]
    assert results[0] == results[1]


def test_odd_rows(spark, library, odd_documents):
    docs = odd_documents((None, "a b. c"), (None, None), (-5, "z"))
    rows = packing.pack(docs, PATH, packing.Packing(limit=64, segment_tokens=500)).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(library, r.text)) for r in docs.collect())
    ends = {}
    for r in rows:
        ends[r.sequence_id] = ends.get(r.sequence_id, 0) + r.length
    assert max(ends.values()) <= 64
    assert packing.pack(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.Packing(limit=0)

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dugout.llm import chat_format as chat
from dugout.llm import order_minhash as omh
from dugout.llm.queries import QUERIES
from dugout.llm.ranks import ranked
from dugout.llm.sharding import interleave

SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_query_gives_the_texts_back(spark):
    given = {}
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        given.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    given[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    rows = {r.conv_id: r for r in QUERIES["op6_chat_parts"](spark, SMALL).collect()}
    assert rows.keys() == given.keys()
    for i, turns in given.items():
        turns = sorted(turns)
        learned = "".join(t for _, role, t in turns if role == "assistant")
        extra = lambda s: sum(s.count(c) for c in "<[]\\")
        length = 3 + sum(6 + len(role) + extra(role) + 1 + len(t) + extra(t) + 7 for _, role, t in turns)
        assert (rows[i].n_turns, rows[i].turns_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)))
        assert (rows[i].loss_chars, rows[i].loss_sha256, rows[i].formatted_chars) == (len(learned), sha(learned), length)


def test_chat_parts_and_odd_rows(spark):
    part = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (kind, text, ref, width, height, seconds, pages)
    mixed = [part("text", "see <image> \\< []"), part("image", ref="a.png", width=28, height=15), part("audio", ref="b", seconds=1.5), part("document", ref="c", pages=2), part("odd", "x"), part("image"), part(None)]
    rows = [(1, 2, "assistant", [part("text", "")]), (1, 1, "user", mixed), (1, 1, "user", mixed), (1, None, None, None), (None, 1, "assistant", [part("text", "a]\\b[INST:user]")]), (2, 1, "a]b\n", [part("text", None)])]
    frame = spark.createDataFrame([(*r, "z") for r in rows], f"conv_id long, turn long, role string, parts array<{chat.PART}>, turns string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_chats(frame)).collect()}
    one = out[1]
    assert [t.role for t in one.turns] == ["", "user", "user", "assistant"]
    assert one.turns[1].text == "see <image> \\< []<image><audio><document>x<image>"
    assert one.formatted.count("<image>") == 4  # placeholders only: those in texts are escaped
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in one.attachments][:4] == [(1, 1, "image", "a.png", 4), (1, 2, "audio", "b", 38), (1, 3, "document", "c", 1024), (1, 5, "image", None, 0)]
    assert one.expanded_tokens == 2 * (4 + 38 + 1024)
    assert out[None].learned == "a]\\b[INST:user]" and out[None].turns[0].text == out[None].learned
    assert out[2].turns[0].role == "a]b\n" and out[2].learned == ""
    assert chat.format_chats(frame.limit(0)).count() == 0


def shares(rows):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    return by_shard


def test_shards_of_given_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op9_stratified_shards"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.size == len((docs[r.doc_id].text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((docs[r.doc_id].text or "").encode()) for r in rows)
    shards = shares(rows)
    assert sorted(shards) == list(range(40)) and {len(s) for s in shards.values()} == {25}
    whole = Counter(d.source for d in docs.values())
    for s in shards.values():
        assert sorted(r.slot for r in s) == list(range(25))
        mixture = Counter(docs[r.doc_id].source for r in s)
        assert all(abs(mixture[k] - n / 40) <= 2 for k, n in whole.items())


@pytest.mark.parametrize("n, shards", [(0, 4), (1, 4), (3, 4), (10, 4), (403, 7)])
def test_uneven_and_odd_shards(spark, n, shards):
    rows = [(i // 2 if i % 7 else None, ["hot", "hot", "hot", None, f"s{i}"][i % 5], "a", 1, 2) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, _key string, shard int, size int")
    out = interleave(frame, shards, blocks=8).collect()
    assert len(out) == n
    found = shares(out)
    sizes = [len(found.get(s, [])) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in found.values())
    assert Counter((r.doc_id, r.source) for r in out) == Counter(r[:2] for r in rows)
    again = interleave(frame.repartition(3), shards, blocks=8).collect()
    assert Counter((r.doc_id, r.source, r.shard, r.slot) for r in again) == Counter((r.doc_id, r.source, r.shard, r.slot) for r in out)


def plainly_dealt(rows, shards, seed):
    """Shard and slot by sorting; hashes are Spark's."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    order = lambda r: (r.h, (r.doc_id is not None, r.doc_id or 0), r.second)
    unit = lambda h: ((h & (2**64 - 1)) >> 11) / 2**53
    placed = []
    for own in by_source.values():
        # Ranks follow the unsigned hash's upper bits, then the hash.
        own.sort(key=lambda r: (unit(r.h), *order(r)))
        placed += [((k + unit(r.phase)) / len(own), r) for k, r in enumerate(own)]
    placed.sort(key=lambda p: (p[0], *order(p[1])))
    small, larger = divmod(len(placed), shards)
    out, at = [], 0
    for shard in range(shards):
        size = small + (shard < larger)
        out += [(str(r.doc_id), str(r.source), r.text, shard, slot) for slot, (_, r) in enumerate(placed[at : at + size])]
        at += size
    return sorted(out)


def test_shards_equal_a_plain_version_whatever_the_partitions(spark):
    """A hot id, null ids, a hot source and sources of one row."""
    rows = [([7, 7, None, i][i % 4], ["hot", "hot", None, f"one{i}"][i % 4 if i % 3 else 0], f"text {i // 2}") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    everything = [F.col(c) for c in frame.columns]
    hashed = frame.withColumns({"h": F.xxhash64(F.lit(17), *everything), "second": F.xxhash64(F.lit(~17), *everything), "phase": F.xxhash64(F.lit(17), F.lit("phase"), F.col("source"))})
    expected = plainly_dealt(hashed.collect(), 7, 17)
    for n in (1, 3, 7, 60):
        out = interleave(frame.repartition(n), 7, blocks=16).collect()
        assert sorted((str(r.doc_id), str(r.source), r.text, r.shard, r.slot) for r in out) == expected


def test_ranks_equal_one_window(spark):
    frame = spark.range(500).select("id", (F.pmod(F.xxhash64("id"), F.lit(97)) / 97).alias("p"))
    rows = ranked(frame, F.col("p"), [F.col("id")], "rank", blocks=13).collect()
    wanted = sorted(rows, key=lambda r: (r.p, r.id))
    assert [r["rank"] for r in wanted] == list(range(500)) and {r.rank_of for r in rows} == {500}


def edited(text, following):
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


def test_fingerprint_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    order = sorted(docs, reverse=True)
    following = {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}
    rows = {r.doc_id: r for r in QUERIES["op10_order_minhash"](spark, SMALL).collect()}
    assert rows.keys() == docs.keys()

    def alike(x, y):
        a, b = x.split(), y.split()
        return len(set(a) & set(b)) / len({e[:2] for e in a} | {e[:2] for e in b})

    for i, r in rows.items():
        assert r.n_chars == len(docs[i]) and r.edited_sha256 == sha(edited(docs[i], docs[following[i]]))
        assert r.near_edited == pytest.approx(alike(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(alike(r.fingerprint, rows[following[i]].fingerprint))
    by_text = {}
    for i, t in docs.items():
        by_text.setdefault(t, set()).add(rows[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert sum(r.near_edited > r.near_next for r in rows.values()) > 0.9 * len(rows)


def test_fingerprints_follow_the_definition(spark):
    """Selection, numbering of repeats and order against a plain version over Spark's hash of the same numbers."""
    texts = ["a b a b a b c", "a", "", None, " x  y ", "w " * 40 + "z", " ".join(f"t{i % 50}" for i in range(400))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashed = lambda *columns: [r[0] for r in spark.createDataFrame(list(columns[0]), columns[1]).select(F.xxhash64("*")).collect()] if columns[0] else []
    import re

    low, got = omh._PLACE, {r.doc_id: r.f for r in omh.with_fingerprint(frame, "text", "f").collect()}
    for i, text in enumerate(texts):
        parts = re.split(r"\s+", text or "")
        words = hashed([(p,) for p in parts], "w string")
        pairs = list(zip(words, words[1:])) or [(words[0], None)]
        kmers = [h & ~low for h in hashed(pairs, "a long, b long")]
        seen, numbered = Counter(), []
        for place, h in enumerate(kmers):
            numbered.append((h, seen[h], place))
            seen[h] += 1
        again = [x for x in numbered if x[1]]
        other = dict(zip(again, [h & ~low for h in hashed([(h >> omh.PLACE_BITS, n) for h, n, _ in again], "h long, n int")]))
        entries = sorted((other.get(x, x[0]), x[2]) for x in numbered)
        bins = {}
        for h, place in entries:
            bins.setdefault(h >> (64 - omh.BIN_BITS), []).append((place, h))
        assert got[i].split() == sorted(got[i].split()) and [int(e[:2], 16) - 32 for e in got[i].split()] == sorted(bins)
        tuples = [[h & ((1 << 64) - 1) for _, h in sorted(members[: omh.SELECTED])] for _, members in sorted(bins.items())]
        signed = [([t - (1 << 64) if t >> 63 else t for t in group],) for group in tuples]
        wanted = [f"{h & ((1 << 64) - 1):016x}"[:8] for h in hashed(signed, "t array<long>")]
        assert [e[2:] for e in got[i].split()] == wanted


def test_order_matters_and_odd_rows(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join(words[100:] + words[:100]), " ".join(words[:100] + words[101:])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = omh.with_fingerprint(frame, "text", "f")
    pairs = prints.alias("a").join(prints.alias("b"), F.col("a.doc_id") == 0).select("b.doc_id", omh.likeness(F.col("a.f"), F.col("b.f")).alias("s"))
    near = {r.doc_id: r.s for r in pairs.collect()}
    assert near[0] == 1 and near[2] > 0.85 and near[1] < 0.8  # the same pairs of words, moved
    odd = spark.createDataFrame([(3, "a b"), (3, None), (3, "a b"), (None, "zz é"), (1, ""), (9, "q" * 9)], "doc_id long, text string").withColumn("fingerprint", F.lit("clash"))
    rows = omh.fingerprints(odd).collect()
    assert len(rows) == 6 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    by_id = {r.doc_id: r.edited_sha256 for r in rows}
    assert by_id[9] == sha("q" * 5) and by_id[1] == sha("") and by_id[None] == sha("zz" + "qq")
    lone = omh.fingerprints(odd.limit(1)).collect()
    assert len(lone) == 1 and lone[0].near_next == 1
    assert omh.fingerprints(odd.limit(0)).count() == 0

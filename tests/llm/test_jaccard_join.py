import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from dugout.llm.jaccard_join import FREQUENT, Threshold, index_keys, near_duplicates, one_per_group, shared_entries
from dugout.llm.shingles import Shingler


def shingles_of(text, width):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return frozenset([tuple(words)] if 0 < len(words) < width else [tuple(words[k : k + width]) for k in range(len(words) - width + 1)])


def brute(docs, width, over):
    """Component by every pair that shares a shingle."""
    sets = {i: shingles_of(t, width) for i, t in docs.items()}
    inverted = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    both = Counter((a, b) for ids in inverted.values() for k, b in enumerate(ids) for a in ids[:k])
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= over * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in docs}


def found(frame, width, over):
    rows = near_duplicates(frame, width, Threshold(over, 100), FREQUENT).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def frame_of(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")


def test_given_documents(spark, documents):
    assert found(frame_of(spark, documents), 4, 85) == brute(documents, 4, 85)


def test_near_copies_and_common_passages(spark):
    """Families around the threshold, short texts of common lines, and sets of one to thirty shingles."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    lines = [" ".join(rng.choices(vocabulary, k=9)) for _ in range(4)]
    docs = {}
    for family in range(6):
        base = rng.choices(vocabulary, k=rng.choice([12, 40, 160, 300]))
        for _ in range(30):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 40])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs[len(docs) * 3 + 1] = " ".join(words)
    for _ in range(120):
        docs[len(docs) * 3 + 1] = "\n".join(rng.choices(lines, k=rng.randrange(1, 4))) + rng.choice(["", " tail", " " + rng.choice(vocabulary)])
    for n in range(1, 40):
        docs[len(docs) * 3 + 1] = " ".join(vocabulary[: n + 1])
    for width, over in ((4, 85), (5, 80), (2, 95)):
        assert found(frame_of(spark, docs), width, over) == brute(docs, width, over)


def test_odd_rows(spark, odd_documents):
    rows = near_duplicates(odd_documents(), 5, Threshold()).collect()
    assert len(rows) == 12
    by_id = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert by_id[1][1] == by_id[2][1] == by_id[3][1] == by_id[None][1] == 1
    assert by_id[4] == (0, 4) and by_id[5] == (0, 5) and by_id[6] == (0, 6)
    assert by_id[7] == (1, 7) and by_id[8] == (1, 7)
    assert by_id[9] == (1, 9)
    assert near_duplicates(odd_documents().limit(0)).count() == 0


def test_near_copies_without_an_id_link(spark):
    """Near but unequal copies with null ids, one of them the only bridge of two documents, beside copies that repeat id and text."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, other = [word() for _ in range(200)], [word() for _ in range(200)]
    bridge = [word() for _ in range(15)] + base[15:]
    far = bridge[:-15] + [word() for _ in range(15)]
    rows = [(1, base), (None, bridge), (2, far), (None, bridge), (None, other), (3, [word(), *other[1:]]), (None, [*other[:-1], word()]), (3, [word(), *other[1:]])]
    texts = [(i, " ".join(w)) for i, w in rows]
    alone = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame([t for t in texts if t[0] in (1, 2)], "doc_id long, text string")).collect()}
    assert alone == {1: 1, 2: 2}
    found = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in found) == [(0, 1), (0, 1), (0, 3), (0, 3), (1, 1), (2, 1), (3, 3), (3, 3)]


def test_one_per_group_keeps_columns(spark, odd_documents):
    docs = odd_documents()
    kept = one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7, 9, 10]


def test_one_per_group_on_null_and_repeated_ids(spark):
    """A copy goes though another row of its id is wordless, unique or leads; of near copies under one id one stays."""
    rng = random.Random(4)
    texts = {k: [f"{k}{rng.randrange(10**6)}" for _ in range(120)] for k in "abcde"}
    near = {k: [*w[:-1], "changed"] for k, w in texts.items()}
    rows = [
        (1, texts["a"]), (None, []), (None, near["a"]), (None, texts["b"]), (5, near["a"][1:]), (5, texts["c"]), (6, texts["d"]), (6, near["d"]),
        (None, texts["e"]), (None, near["e"]), (None, texts["e"]), (None, []),
    ]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    kept = [(r.doc_id, r.text[:1]) for r in one_per_group(docs).collect()]
    assert Counter(kept) == {(1, "a"): 1, (None, ""): 2, (None, "b"): 1, (5, "c"): 1, (6, "d"): 1, (None, "e"): 1}
    again = one_per_group(docs.repartition(5, "text"))
    assert Counter(again.collect()) == Counter(one_per_group(docs).collect())


@pytest.mark.parametrize("n", [2, 7, 8, 63, 64, 65, 130, 700])
def test_every_entry_demand_is_met(n):
    """Linked sets share entries whichever shingles are frequent or repeated."""
    rng = np.random.default_rng(n)
    limit = Threshold(85, 100)
    for _ in range(60):
        common = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        spare = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        left = common
        lose = rng.integers(0, n - limit.least(n) + 1)
        right = np.unique(np.concatenate((rng.permutation(common)[lose:], spare[: rng.integers(0, 3)])))
        both = len(np.intersect1d(left, right))
        if 100 * both < 85 * (len(left) + len(right) - both) or len(left) == len(right) == both:
            continue
        share = rng.choice([0, 0.5, 0.97, 1])
        frequent = lambda v: (v * np.uint64(0x9E3779B97F4A7C15)) < np.uint64(min((1 << 64) - 1, int(share * (1 << 64))))  # noqa: E731, B023
        known = lambda v: np.isin(v, left) & np.isin(v, right)  # noqa: E731, B023
        a, b = (index_keys(s, limit, known, frequent)[0] for s in (left, right))
        assert len(np.intersect1d(a, b)) >= min(shared_entries(len(left)), shared_entries(len(right)))


def test_shingler_matches_words():
    texts = ["A b  c\td", "a B c d", None, "", "a b", "x\x0by\x0cz w a b c d", "é É e", "a\x1cb c d e"]
    sets = list(Shingler(3).sets(pa.array(texts, pa.string())))
    assert [len(s) for s in sets] == [len(shingles_of(t, 3)) for t in texts]
    assert (sets[0] == sets[1]).all()


def test_column_names_of_its_own_clash_with_nothing(spark):
    text = " ".join(f"w{i}" for i in range(30))
    columns = ["doc_id", "text", "_repeat", "_leader", "_leading", "row", "number", "id", "body", "leader", "repeat", "class", "key"]
    frame = spark.createDataFrame([(i, text, *(["x"] * 11)) for i in (3, 1, 1)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in columns[2:]))
    kept = one_per_group(frame)
    assert kept.columns == columns and [r.doc_id for r in kept.collect()] == [1]
    assert [r.component_id for r in near_duplicates(frame).collect()] == [1, 1, 1]


@pytest.mark.parametrize("over, of", [(50, 100), (1, 3), (101, 100)])
def test_thresholds_that_entries_cannot_serve_are_refused(over, of):
    with pytest.raises(ValueError):
        Threshold(over, of)

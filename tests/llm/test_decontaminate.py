import random
import re

from dugout.llm.decontaminate import clean_documents, contaminated_words


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(str(item))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    found |= windows[tuple(w[k : k + m])]
        out.append((i, len(w), sorted(hit), sorted(found)))
    return out


def check(spark, docs, items, window, **how):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, hits string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.n_words, r.hits, r["items"]) for r in contaminated_words(d, b, window, **how).collect()]
    assert sorted(rows, key=str) == sorted(brute(docs, items, window), key=str)
    clean = clean_documents(d, b, window)
    assert clean.columns == d.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _, hit, _ in brute(docs, items, window) if not hit)


def made(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["A", "b", "C", "dé", "É", "x1"]
    item = lambda m: " ".join(rng.choices(vocabulary, k=m))
    items = [(i, item(rng.choice([0, 1, 3, 4, 5, 9]))) for i in range(8)] + [(8, None), (3, item(6))]
    docs = [(i, rng.choice(["-", " ", ", "]).join(rng.choices(vocabulary, k=rng.randrange(40)))) for i in range(n)]
    return docs + [(1, docs[1][1]), (100, None), (101, ""), (102, "?!"), (103, "a " * 5000)], items


def test_against_brute_force(spark):
    docs, items = made(1)
    check(spark, docs, [(i, t) for i, t in items if len(words(t)) != 1], 4)
    check(spark, docs, items, 4)
    check(spark, docs, items, 10)


def test_blocks_of_the_benchmark_are_united(spark):
    docs, items = made(2)
    check(spark, docs, items, 3, block_bytes=40)


def test_empty_tables(spark):
    docs, items = made(3)
    check(spark, docs, [(1, None)], 4)
    check(spark, [], items, 4)


def test_column_names_of_its_own_clash_with_nothing(spark):
    frame = spark.createDataFrame([(1, "a b c", "x", "y", "z"), (2, "d e f", "x", "y", "z")], "doc_id long, text string, _print string, print string, row string")
    kept = clean_documents(frame, spark.createDataFrame([(1, "b c")], "item_id long, text string"), 2)
    assert kept.columns == frame.columns and [tuple(r) for r in kept.collect()] == [(2, "d e f", "x", "y", "z")]

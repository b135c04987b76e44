import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from dugout.llm import filter_audit


def brute(docs, labels):
    """Apply all orders to rows, one by one."""
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    fails = []
    for doc_id, text, source in docs:
        body = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", body)
        own = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", body)) > 5 * len(body),
            "D": bool(re.search(r"[#$%&*|]", body)), "E": doc_id is not None and first[body] < doc_id,
        }
        good = any(i == doc_id and q == 1 for i, q, _ in labels if i is not None)
        toxic = any(i == doc_id and t == 1 for i, _, t in labels if i is not None)
        fails.append((source or "", {k for k, v in own.items() if v}, good, toxic))
    out = {}
    for part in {f[0] for f in fails}:
        rows = [f[1:] for f in fails if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[0]]
                redundant = sum(letter in r[0] for r in rows) - len(gone)
                left = [r for r in left if letter not in r[0]]
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), redundant, sum(r[0] == {letter} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def test_against_brute_force(spark):
    import random

    rng = random.Random(4)
    plain = " ".join(f"w{i}" for i in range(60))
    texts = [plain, plain.upper(), "a b " * 40, plain + " #", "", None, "é" * 70, "short one", plain[:-1], "x " * 3000]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["s", "t", "", None])) for _ in range(150)]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"mask": F.lit("m"), "print": F.lit(1), "copy": F.lit(2)})
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("p"))
    found = filter_audit.audit(filter_audit.mask_counts(frame, told)).collect()
    expected = brute(docs, labels)
    assert len(found) == len(expected)
    for r in found:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == expected[r.part, r.filter_order, r.step]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.mask_counts(docs, labels)).count() == 0
    one = spark.createDataFrame([(1, "x", None)], docs.schema)
    assert filter_audit.audit(filter_audit.mask_counts(one, labels)).count() == 600


@pytest.mark.parametrize("bits", [3, 16])
def test_a_sketch_never_clears_a_repeat(spark, monkeypatch, bits):
    """Even where the sketch is far too small."""
    monkeypatch.setattr(filter_audit, "_LEAST_BITS", bits)
    monkeypatch.setattr(filter_audit, "_MOST_BITS", bits)
    docs = [(i, f"text {i % 70}", "s") for i in range(100)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    masks = filter_audit.mask_counts(frame, labels).collect()
    assert sum(r.documents for r in masks if r["mask"] & 16) == 30

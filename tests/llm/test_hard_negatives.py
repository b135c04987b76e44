import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dugout.llm import hard_negatives as hn


def brute(rows, how):
    """Python's own whole numbers, every pair."""
    valid = []
    for vec_id, label, vec in rows:
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        valid.append((vec_id, label, [math.floor(256 * x) for x in vec]))
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    key = lambda pair: (-pair[0], math.inf if pair[1] is None else pair[1])
    out = []
    for a, (anchor, label, v) in enumerate(valid):
        if anchor is None or anchor % how.every:
            continue
        scored = [(clip(sum(x * y for x, y in zip(v, w))), i, other) for r, (i, other, w) in enumerate(valid) if r != a]
        positives = sorted(((s, i) for s, i, other in scored if other == label), key=key)[: how.positives]
        for p, positive in positives:
            near = sorted(((s, i) for s, i, other in scored if other != label and how.low * p <= 100 * s <= how.high * p), key=key)[: how.negatives]
            out += [(anchor, positive, rank, i, p, s) for rank, (s, i) in enumerate(near, 1)]
    return out


def check(spark, rows, how):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"row": F.lit("r"), "score": F.lit(1), "a": F.lit(2), "anchor": F.lit(3)})
    found = [tuple(r) for r in hn.mined(frame, how).collect()]
    as_float = [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    assert sorted(found, key=str) == sorted(brute(as_float, how), key=str)
    return found


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 1, 2, None]), [rng.gauss(0.3, 0.5) for _ in range(8)]) for i in range(120)]
    rows += [(200 + i, 1, rows[0][2]) for i in range(15)]  # ties
    rows += [(300, 0, None), (301, 0, [1.0, None]), (302, 1, [math.nan] * 8), (303, 1, [math.inf] + [0.0] * 7), (304, 2, []), (305, 2, [0.9] * 3), (None, 1, [0.5] * 8)]
    rows += [(10, 0, rows[10][2]), (10, 0, [0.1] * 8), rows[20], rows[20]]  # repeated ids and rows
    assert check(spark, rows, hn.Mining(every=10, anchor_block=4, row_block=16))
    assert check(spark, rows, hn.Mining(every=7, positives=2, negatives=3))


def test_components_of_any_size(spark):
    rng = random.Random(6)
    rows = [(i, i % 2, [rng.gauss(0, 1) * 10 ** rng.choice([0, 3, 9, 12]) for _ in range(5)]) for i in range(40)]
    check(spark, rows, hn.Mining(every=5))


def test_products_are_exact():
    rng = np.random.default_rng(7)
    for top in (1, 256, 1 << 20, 1 << 29):
        a, b = (rng.integers(-top, top + 1, (5, 3000)).astype(float) for _ in range(2))
        product = hn.Residues(a, b).scores(slice(0, 5), slice(0, 5))
        exact = [[max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(u, v)))) for v in b] for u in a]
        assert product.tolist() == exact


def test_empty_tables(spark):
    frame = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hn.mined(frame).count() == 0
    assert hn.mined(hn.relabelled(spark.createDataFrame([(0, 1, [1.0]), (7, None, [1.0])], frame.schema))).count() == 0


@pytest.mark.parametrize("label,moved", [(9, 0), (3, 4), (None, None)])
def test_labels_move(spark, label, moved):
    frame = spark.createDataFrame([(14, label, [1.0]), (15, label, [1.0])], "vec_id long, label int, embedding array<float>")
    assert [r.label for r in hn.relabelled(frame).orderBy("vec_id").collect()] == [moved, label]

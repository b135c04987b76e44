import zlib

import numpy as np
import pytest

from dugout.llm import string_kernel as sk
from dugout.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scores(spark):
    rows = QUERIES["op5_string_kernel"](spark, SF).collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return rows, toxic


def test_held_out_accuracy(scores):
    rows, toxic = scores
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    known = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    bad, good = ([s for s, t in known if t == side] for side in (1, 0))
    auc = np.mean([(a > b) + (a == b) / 2 for a in bad for b in good])
    assert auc > 0.9
    assert np.mean([s >= 0.5 for s in good]) < 0.03


@pytest.fixture(scope="module")
def machine():
    rng = np.random.default_rng(1)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    texts, toxic = [], []
    for i in range(600):
        words = [word() for _ in range(80)]
        toxic.append(i % 3 == 0)
        if toxic[-1]:
            for _ in range(4):
                words.insert(rng.integers(80), rng.choice(["idiot", "stupid", "scumbag"]))
        texts.append(" ".join(words).encode())
    return sk.fit(texts, np.array(toxic), 1 / 3), " ".join(word() for _ in range(40))


@pytest.mark.parametrize("insult", ["idiot", "i d i o t", "id-iot", "id.io.t", "idxiot", "sstuxpid", "STUPID", "scum_bag"])
def test_gapped_and_inserted(machine, insult):
    model, plain = machine

    def score(text):
        raw = text.encode()
        codes, starts = sk.letters(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return model.score(sk.strongest_windows(codes, starts, model.weights)[0].astype(float))[0]

    assert score(plain) < 0.5
    assert score(f"{plain} {insult} {plain}") > max(0.3, 4 * score(plain))


def test_odd_rows(spark, odd_documents):
    docs = odd_documents()
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (77, 0)], "doc_id long, toxic int")
    out = sk.scored(docs, labels, out="score")
    assert sorted(out.columns) == sorted(docs.columns)
    rows = out.collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert sk.scored(docs.limit(0), labels).count() == 0
    assert all(r.score < 0.01 for r in sk.scored(docs, labels.limit(0)).collect())

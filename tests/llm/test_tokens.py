import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dugout.llm import byte_bpe, token_counts

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts(documents):
    rng = random.Random(3)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 0x250), rng.randrange(0x300, 0x3000), rng.randrange(0x3000, 0xD7FF), rng.randrange(0x1F300, 0x1F6FF), 32, 10, 9]))
    made = ["".join(pick() for _ in range(rng.randrange(80))) for _ in range(2000)]
    odd = ["", "<|startoftext|>hi<|endoftext|> <|ENDOFTEXT|>", "a" * 5000, " " * 5000, "\n" * 300 + "x", "ΑΣ ΟΔΟΣ", "İstanbul", "\x1c\x85a", "</w> a</w>b", "é é"]
    return [*documents.values(), *made, *odd]


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string").withColumn("ids", F.lit("clash"))


def test_byte_bpe_is_the_library(frame, texts):
    ranks = {piece: rank for rank, piece in enumerate(byte_bpe.read_ranks(RANKS))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = byte_bpe.decoded(byte_bpe.encoded(frame, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    rows = {r.doc_id: r for r in tokens.collect()}
    assert len(rows) == len(texts) + 1
    assert rows[-1].n_tokens == 0 and bytes(rows[-1].ids) == b"" and bytes(rows[-1].decoded) == b""
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text)
        assert rows[i].n_tokens == len(ids)
        assert bytes(rows[i].ids) == struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(rows[i].decoded) == text.encode()
    assert byte_bpe.encoded(frame.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_counts_are_the_library(frame, texts):
    library = Tokenizer.from_file(WORDS)
    rows = {r.doc_id: r for r in token_counts.token_counts(frame, WORDS, limit=100).collect()}
    assert (rows[-1].n_bytes, rows[-1].n_tokens, rows[-1].over_limit) == (0, 0, False)
    for i, text in enumerate(texts):
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len(text.encode()), n, n > 100)
    assert token_counts.token_counts(frame.limit(0), WORDS).count() == 0


def test_query_digests(spark):
    from dugout.llm.queries import QUERIES

    rows = QUERIES["op1_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    given = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in given.items()}

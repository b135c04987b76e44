"""Byte-level BPE by a sentencepiece model made from a rank vocabulary.

Each byte is written as one printable character, so a rank file's byte strings
become pieces; a piece scores minus its rank, so the highest score is the lowest
rank.  The model is serialised directly, with identity normalisation and no white
space handling.  Texts are cut by the tokenizer's pattern, each match is encoded
on its own, and ids are turned back by the inverse mapping.
"""

from __future__ import annotations

import base64
import struct
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.llm.runtime import releasing, ship

#: Matches kept with their ids per worker; beyond it the table starts anew.
REMEMBERED = 100_000
#: Rows encoded at a time, so that a worker holds few texts and ids at once.
_ROWS = 512


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if it is one, else the next from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank, from lines of base64 and rank."""
    found = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                piece, rank = line.split()
                found[int(rank)] = base64.b64decode(piece)
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must run from 0 without gaps")
    return [found[rank] for rank in range(len(found))]


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialised_model(ranks: list[bytes]) -> bytes:
    """The protocol message of a sentencepiece BPE model; the unknown piece comes last, so that ids are ranks."""
    # Field numbers and enum values of the sentencepiece model format.
    pieces, trainer, normalizer = 1, 2, 3
    normal, unknown, bpe = 1, 2, 2
    letters = byte_characters()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(pieces, _field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))

    body = [piece("".join(letters[b] for b in item), -float(rank), normal) for rank, item in enumerate(ranks)]
    body.append(piece("<unk>", 0.0, unknown))
    trained = _number(3, bpe) + _number(4, len(ranks) + 1) + _number(40, len(ranks)) + b"".join(_varint(f << 3) + _varint((1 << 64) - 1) for f in (41, 42, 43))
    plain = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(body) + _field(trainer, trained) + _field(normalizer, plain)


@dataclass(frozen=True)
class Vocabulary:
    """What workers need: the serialised model, the pattern of pre-tokens, the byte string of each id, late characters."""

    model: bytes
    pattern: str
    ranks: list[bytes]
    late: str


def late_characters() -> str:
    """Letters and numbers that the pattern's library here knows and the tokenizer's own, of an older Unicode version, does not."""
    import regex
    import tiktoken

    young = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")
    young = regex.findall(r"[\p{L}\p{N}]", young)
    probe = tiktoken.Encoding("probe", pat_str=r"\p{L}|\p{N}", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    known = set(bytes(probe.encode_ordinary("".join(young))).decode())
    return "".join(c for c in young if c not in known)


def vocabulary(path: str, pattern: str) -> Vocabulary:
    ranks = read_ranks(path)
    return Vocabulary(serialised_model(ranks), pattern, ranks, late_characters())


class _Cutter:
    """The pattern's matches in a text."""

    #: A character that no version assigns stands in for late ones while the text is cut.
    STAND_IN = "\u0378"

    def __init__(self, known: Vocabulary):
        import regex

        self._pattern = regex.compile(known.pattern)
        self._late = regex.compile(f"[{''.join(map(regex.escape, known.late))}]") if known.late else None
        self._first = min(known.late, default=chr(0x10FFFF))

    def __call__(self, text: str) -> list[str]:
        if self._late is None or text.isascii() or max(text) < self._first or not self._late.search(text):
            return self._pattern.findall(text)
        return [text[m.start() : m.end()] for m in self._pattern.finditer(self._late.sub(self.STAND_IN, text))]


class _Encoder(dict):
    """Pre-token to its ids as little-endian bytes, encoded when first met."""

    def __init__(self, known: Vocabulary):
        import sentencepiece

        super().__init__()
        self._processor = sentencepiece.SentencePieceProcessor(model_proto=known.model)
        self._letters = byte_characters()

    def __missing__(self, match: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        raw = match.encode()
        ids = np.array(self._processor.encode("".join(map(self._letters.__getitem__, raw))), dtype="<u4").tobytes()
        if len(raw) <= 64:
            self[match] = ids
        return ids


_ENCODERS: dict[int, tuple[_Cutter, _Encoder]] = {}


def _encoder(shared) -> tuple[_Cutter, _Encoder]:
    """One encoder per worker process and vocabulary."""
    known = shared.value
    key = hash((known.model, known.pattern))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = _Cutter(known), _Encoder(known)
    return _ENCODERS[key]


def _pieces(encoder: _Encoder, known: Vocabulary) -> list[bytes]:
    """Bytes of each id, from the model's own pieces, not from the rank file."""
    back = {letter: byte for byte, letter in enumerate(byte_characters())}
    return [bytes(back[c] for c in encoder._processor.id_to_piece(rank)) for rank in range(len(known.ranks))]


def _text_of(ids: bytes, pieces: list[bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _encode(shared, decode: bool):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, encoder = _encoder(shared)
        look_up = encoder.__getitem__
        pieces = _pieces(encoder, shared.value) if decode else []
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                ids = [b"".join(map(look_up, cut(text.as_py() or ""))) for text in part.column(1)]
                columns = {"doc_id": part.column(0), "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
                if decode:
                    columns["decoded"] = pa.array([_text_of(i, pieces) for i in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _decode(shared):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = _encoder(shared)
        pieces = _pieces(encoder, shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                texts = [_text_of(ids.as_buffer(), pieces) for ids in part.column(2)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (unsigned 32-bit integers, little-endian) of every row of ``docs``.

    A null text counts as empty and has no ids.  Special strings in a text are
    ordinary text.  Repeated rows are encoded alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary(path, pattern))
    return _rows(docs).mapInArrow(_encode(shared, decode=False), "doc_id long, n_tokens long, ids binary")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add ``decoded``, the bytes that ``ids`` stand for, to what ``encoded`` gives."""
    spark = tokens.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary(path, pattern))
    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(_decode(shared), "doc_id long, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """What ``encoded`` gives with ``decoded``, the bytes that the ids give back, by one worker in one pass."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary(path, pattern))
    return _rows(docs).mapInArrow(_encode(shared, decode=True), "doc_id long, n_tokens long, ids binary, decoded binary")

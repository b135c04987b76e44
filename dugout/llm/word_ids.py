"""Token ids of a lower-casing word tokenizer, each pre-token encoded once by its library.

Pre-tokens of many texts are found and hashed in numpy; only those that a worker
has not met go through the ``tokenizers`` library, and ids are laid out from its
answers.  Texts with the file's special strings, or with letters whose
normalisation is not plain, go through the library whole.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

from dugout.llm.shingles import mix

#: Below this code point composition changes nothing and all Unicode versions agree on letters.
_PLAIN = 0x250
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CHUNK = 1 << 20
#: Pre-tokens kept per worker; beyond it the table starts anew.
_REMEMBERED = 1 << 20
_BASE = 0xD1342543DE82EF95


def _classes() -> np.ndarray:
    import regex

    kinds = np.full(_PLAIN, _OTHER, dtype=np.uint8)
    for kind, pattern in ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_DIGIT, r"\p{N}")):
        kinds[[c for c in range(_PLAIN) if regex.match(pattern, chr(c))]] = kind
    return kinds


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes ``start, start + 1, ...`` of every stretch, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _is_plain(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return max(text) < chr(_PLAIN)
    return True


@dataclass(frozen=True)
class Definition:
    """What workers need of a tokenizer file: its text, special strings, the width of an id, and which ids end a word."""

    text: str
    special: tuple[str, ...]
    id_type: str
    ends_word: bytes

    @classmethod
    def read(cls, path: str) -> Definition:
        with open(path, encoding="utf-8") as file:
            text = file.read()
        spec = json.loads(text)
        vocabulary, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        special = tuple(token["content"] for token in spec["added_tokens"])
        size = 1 + max([*vocabulary.values(), *(token["id"] for token in spec["added_tokens"])])
        ends = np.zeros(size, dtype=bool)
        ends[[number for piece, number in vocabulary.items() if piece.endswith(suffix)]] = True
        return cls(text, special, "<u2" if size <= 1 << 16 else "<u4", np.packbits(ends).tobytes())


class WordIds:
    """Ids of texts under a tokenizer file, without added special tokens."""

    def __init__(self, definition: Definition):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition.text)
        self._special = definition.special
        self.dtype = np.dtype(definition.id_type)
        self._is_last = np.unpackbits(np.frombuffer(definition.ends_word, dtype=np.uint8)).astype(bool)
        self._kinds = _classes()
        self._up = _powers(_BASE, _CHUNK + 2)
        self._down = _powers(pow(_BASE, -1, 1 << 64), _CHUNK + 2)
        self._forget()

    def _forget(self) -> None:
        # Hashes of the pre-tokens met, ascending, and where their ids stand.
        self._prints, self._slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self._starts, self._lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self._pool, self._used, self._count = np.zeros(1 << 14, self.dtype), 0, 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a null text has none."""
        out: list[np.ndarray] = [np.empty(0, self.dtype)] * len(texts)
        held, at, size = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            lowered = None
            if not any(mark in text for mark in self._special) and _is_plain(text):
                lowered = text.lower()
                if len(lowered) >= _CHUNK or not _is_plain(lowered):
                    lowered = None
            if lowered is None:
                out[i] = self.whole(text)
                continue
            if size + len(lowered) + 1 > _CHUNK:
                self._chunk(held, at, out)
                held, at, size = [], [], 0
            held.append(lowered)
            at.append(i)
            size += len(lowered) + 1
        if held:
            self._chunk(held, at, out)
        return out

    def _cut(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens: contractions, runs of letters, single numbers, runs of anything else but space."""
        kinds = self._kinds[codes]
        opens = np.ones(len(kinds), dtype=bool)
        np.not_equal(kinds[1:], kinds[:-1], out=opens[1:])
        opens |= kinds == _DIGIT
        edges = np.flatnonzero(opens)
        ends = np.append(edges[1:], len(codes))
        keep = kinds[edges] != _SPACE
        starts, ends = edges[keep], ends[keep]
        # An apostrophe alone takes the letters of a contraction from the run that follows it.
        single = np.flatnonzero((codes[starts] == ord("'")) & (ends - starts == 1))
        single = single[single + 1 < len(starts)]
        single = single[(starts[single + 1] == ends[single]) & (kinds[ends[single]] == _LETTER)]
        if len(single):
            one = codes[ends[single]]
            two = codes[np.minimum(ends[single] + 1, len(codes) - 1)]
            taken = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
            longer = ends[single + 1] - starts[single + 1] >= 2
            for pair in ("re", "ve", "ll"):
                taken[longer & (one == ord(pair[0])) & (two == ord(pair[1]))] = 2
            ends[single] += taken
            starts[single + 1] += taken
            full = starts < ends
            starts, ends = starts[full], ends[full]
        return starts, ends

    def _chunk(self, lowered: list[str], at: list[int], out: list[np.ndarray]) -> None:
        joined = "\n".join(lowered)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        starts, ends = self._cut(codes)
        total = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self._up[: len(codes)], out=total[1:])
        prints = mix((total[ends] - total[starts]) * self._down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_BASE))
        distinct, first, inverse = np.unique(prints, return_index=True, return_inverse=True)
        if len(self._prints) + len(distinct) > _REMEMBERED:
            self._forget()
        place = np.searchsorted(self._prints, distinct)
        met = np.zeros(len(distinct), dtype=bool)
        inside = place < len(self._prints)
        met[inside] = self._prints[place[inside]] == distinct[inside]
        slots = np.empty(len(distinct), dtype=np.int64)
        slots[met] = self._slots[place[met]]
        if not met.all():
            firsts = first[~met]
            slots[~met] = self._learn([joined[s:e] for s, e in zip(starts[firsts].tolist(), ends[firsts].tolist())])
            self._prints = np.insert(self._prints, place[~met], distinct[~met])
            self._slots = np.insert(self._slots, place[~met], slots[~met])
        slot = slots[inverse]
        lengths = self._lengths[slot]
        ids = self._pool[ragged(self._starts[slot], lengths)]
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        tails = np.cumsum(sizes + 1)
        # Ids before each text's end.
        upto = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(starts, tails)]
        low = 0
        for i, high in zip(at, upto.tolist()):
            out[i] = ids[low:high]
            low = high

    def _answers(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some pre-tokens and how many each has; set apart by spaces, each ends with a piece that ends a word."""
        answers = self.library.encode_batch_fast([" ".join(words[i : i + 256]) for i in range(0, len(words), 256)], add_special_tokens=False)
        flat = np.array([i for answer in answers for i in answer.ids], dtype=self.dtype)
        last = np.flatnonzero(self._is_last[flat])
        if len(last) == len(words) and last[-1] == len(flat) - 1:
            return flat, np.diff(last, prepend=-1)
        alone = [answer.ids for answer in self.library.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in alone for i in ids], dtype=self.dtype), np.fromiter(map(len, alone), np.int64, len(alone))

    def _learn(self, words: list[str]) -> np.ndarray:
        """Keep the ids of new pre-tokens; their slots."""
        base = self._count
        flat, lengths = self._answers(words)
        while base + len(words) > len(self._starts):
            self._starts, self._lengths = (np.concatenate((a, np.zeros_like(a))) for a in (self._starts, self._lengths))
        while self._used + len(flat) > len(self._pool):
            self._pool = np.concatenate((self._pool, np.zeros_like(self._pool)))
        self._starts[base : base + len(words)] = self._used + np.cumsum(lengths) - lengths
        self._lengths[base : base + len(words)] = lengths
        self._pool[self._used : self._used + len(flat)] = flat
        self._used += len(flat)
        self._count += len(words)
        return np.arange(base, self._count)


_ENCODERS: dict[int, WordIds] = {}


def encoder(definition: Definition) -> WordIds:
    """This worker's encoder, with the pre-tokens that earlier tasks met."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordIds(definition)
    return _ENCODERS[key]

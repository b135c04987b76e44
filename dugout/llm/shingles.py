"""Sets of hashed word shingles, computed in numpy over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK_BYTES = 1 << 19
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    if count:
        out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Shingles of ``width`` words; a text of fewer words is one shingle, a text of none has none.

    A word is a run of bytes other than space and 0x09-0x0D, with A-Z lowered.
    Words and shingles are 64-bit hashes: two different shingles of one pair of
    texts meet with a chance of about 5e-20.
    """

    def __init__(self, width: int):
        self.width = width
        self._up = self._down = np.empty(0, dtype=np.uint64)
        self._place = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_STEP)) | np.uint64(1)

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The sorted distinct shingles of each text."""
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if len(texts) and texts.buffers()[2] else np.empty(0, np.uint8)
        nulls = texts.is_null().to_numpy(zero_copy_only=False) if texts.null_count else None
        start = 0
        while start < len(texts):
            end = start + 1
            while end < len(texts) and offsets[end + 1] - offsets[start] <= _CHUNK_BYTES:
                end += 1
            yield from self._chunk(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start], None if nulls is None else nulls[start:end])
            start = end

    def _chunk(self, raw: np.ndarray, offsets: np.ndarray, nulls: np.ndarray | None) -> Iterator[np.ndarray]:
        if len(self._up) < len(raw) + 1:
            self._up, self._down = _powers(_BASE, len(raw) + 1), _powers(_BASE_INVERSE, len(raw) + 1)
        # A text's end is a word's end: edges of texts count as spaces between bytes.
        word = ~_SPACE[raw]
        starts_here = np.zeros(len(raw) + 1, dtype=bool)
        starts_here[offsets] = True
        before = np.concatenate(([False], word[:-1])) if len(raw) else word
        first = np.flatnonzero(word & (~before | starts_here[:-1]))
        after = np.concatenate((word[1:], [False])) if len(raw) else word
        last = np.flatnonzero(word & (~after | starts_here[1:])) + 1
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((_LOWER[raw] + np.uint64(1)) * self._up[: len(raw)], out=total[1:])
        words = mix((total[last] - total[first]) * self._down[first] + (last - first).astype(np.uint64) * np.uint64(_STEP))
        bounds = np.searchsorted(first, offsets)
        width = self.width
        joined = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for k in range(width):
            joined += words[k : k + len(joined)] * self._place[k]
        joined = mix(joined)
        for i in range(len(offsets) - 1):
            low, high = bounds[i], bounds[i + 1]
            if nulls is not None and nulls[i] or high == low:
                yield np.empty(0, dtype=np.uint64)
            elif high - low < width:
                few = words[low:high]
                yield mix((few * self._place[: len(few)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(few)))
            else:
                values = np.sort(joined[low : high - width + 1])
                keep = np.ones(len(values), dtype=bool)
                np.not_equal(values[1:], values[:-1], out=keep[1:])
                yield values[keep]

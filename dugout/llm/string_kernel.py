"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A text is read as its letters only, accents taken off and repeats passed over, so
other characters inserted between letters do nothing.  A window of letters is described by its subsequences of four
letters that span at most six, each weighted by ``DECAY`` per gap; the kernel of
two windows is the product of these descriptions.  Landmark windows span a
subspace (Nyström): a window becomes its kernel with the landmarks, whitened.  A
linear machine with hinge loss is fitted there.  As its decision is a weighted
sum of kernels with landmarks, it is one weight per subsequence, and a text is
scored by its strongest window in one pass over its letters.

Labels belong to texts, not windows: in each round a toxic text is represented
by its strongest sentence window and clean texts by theirs and by random ones.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dugout.llm.runtime import release, ship

SPAN, DECAY = 6, 0.7
PATTERNS = [(p, np.float32(DECAY ** (p[2] - 3))) for p in combinations(range(1, SPAN), 3)]
#: Letters in a window's start positions; a text's end is padded so that windows don't cross texts.
WINDOW = 6
PAD = WINDOW + SPAN
_EDGE = 31
_TABLE = 1 << 20
_CHUNK = 1 << 19

#: Code points below this are looked up, those beyond are dealt over all codes.
_FOLDED = 0x250


def _codes() -> np.ndarray:
    """1 to 26 for letters, accents taken off; 0 for what is passed over; other letters are dealt over 30 codes.

    Digits and signs read as the letters they resemble.
    """
    out = np.zeros(_FOLDED, dtype=np.uint8)
    for point in range(_FOLDED):
        base = unicodedata.normalize("NFKD", chr(point))[0].lower()
        if "a" <= base <= "z":
            out[point] = ord(base) - ord("a") + 1
        elif base.isalpha():
            out[point] = _dealt(np.array([point]))[0]
    for digit, letter in zip("013457@$", "oieastas"):
        out[ord(digit)] = ord(letter) - ord("a") + 1
    return out


def _dealt(points: np.ndarray) -> np.ndarray:
    return ((points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % 30 + 1


_CODES = _codes()


@dataclass(frozen=True)
class Fitting:
    """Bounds and parameters of the fit."""

    toxic_rows: int = 1500
    clean_rows: int = 3000
    #: Bytes of the sampled texts of either label; rows are taken in the order of a hash, whatever their length, until these are full.
    sample_bytes: int = 5 << 20
    #: One letter in so many is followed by a strewn one in the copies that set the curve; 0: no such copies.
    strewn: int = 6
    landmarks: int = 300
    rounds: int = 3
    penalty: float = 1e-2
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """Weight per subsequence, and the logistic curve from a text's strongest window to its score."""

    weights: np.ndarray
    slope: float
    offset: float

    def score(self, strongest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * strongest + self.offset, -60, 60)))


def letters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of concatenated texts, each followed by ``PAD`` edges, and where each text starts.

    ``raw`` is UTF-8.  A letter that repeats the one before it is passed over.
    """
    codes = _CODES[raw]
    if (raw >= 0x80).any():
        codes[raw >= 0x80] = 0
        padded = np.concatenate((raw, np.zeros(3, raw.dtype))).astype(np.int64)
        for low, high, more in ((0xC2, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0xF8, 3)):
            at = np.flatnonzero((raw >= low) & (raw < high))
            points = padded[at] & (0x3F >> more)
            for k in range(1, more + 1):
                points = points << 6 | padded[at + k] & 0x3F
            codes[at] = np.where(points < _FOLDED, _CODES[np.minimum(points, _FOLDED - 1)], _dealt(points))
    places = np.flatnonzero(codes)
    kept = codes[places]
    owner = np.searchsorted(offsets, places, side="right")
    fresh = np.ones(len(places), dtype=bool)
    fresh[1:] = (kept[1:] != kept[:-1]) | (owner[1:] != owner[:-1])
    places, codes = places[fresh], kept[fresh] - 1
    upto = np.searchsorted(places, offsets)
    starts = upto + PAD * np.arange(len(upto))
    out = np.full(starts[-1], _EDGE, dtype=np.uint32)
    where = np.repeat(PAD * np.arange(len(upto) - 1), np.diff(upto)) + np.arange(len(codes))
    out[where] = codes
    return out, starts


def _subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.float32]]:
    """Per pattern the number of the four letters from every position, and the pattern's weight."""
    n = len(codes) - SPAN + 1
    at = [codes[k : k + n] << np.uint32(15 - 5 * place) for place, k in ((0, 0),)]
    shifted = {(place, k): codes[k : k + n] << np.uint32(15 - 5 * place) for place in (1, 2, 3) for k in range(place, SPAN - 3 + place)}
    for (a, b, c), weight in PATTERNS:
        yield at[0] | shifted[1, a] | shifted[2, b] | shifted[3, c], weight


def window_scores(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The decision, without its offset, for the window that starts at each position."""
    n = len(codes) - SPAN + 1
    local = np.zeros(n, dtype=np.float32)
    for numbers, weight in _subsequences(codes):
        local += weight * weights.take(numbers)
    total = np.concatenate(([0.0], np.cumsum(local, dtype=np.float64)))
    return (total[WINDOW:] - total[:-WINDOW]).astype(np.float32)


def strongest_windows(codes: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the score of its strongest window and where it starts; an empty text scores 0.

    Some texts at a time: windows don't cross them.
    """
    best, first = np.zeros(len(starts) - 1, dtype=np.float32), np.full(len(starts) - 1, -1, dtype=np.int64)
    i = 0
    while i < len(best):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _CHUNK, side="right")) - 1)
        inner = starts[i : j + 1] - starts[i]
        scores = window_scores(codes[starts[i] : starts[j]], weights)
        scores = np.concatenate((scores, np.zeros(inner[-1] - len(scores), dtype=np.float32)))
        best[i:j] = np.maximum.reduceat(scores, inner[:-1])
        owner = np.repeat(np.arange(j - i), np.diff(inner))
        hits = np.flatnonzero(scores == best[i:j][owner])
        first[i + owner[hits][::-1]] = starts[i] + hits[::-1]
        i = j
    return best, first


def _describe(codes: np.ndarray, at: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Descriptions of the windows at ``at`` over the subsequences that ``index`` numbers (-1: none)."""
    windows = codes[at[:, None] + np.arange(PAD)]
    width, n = int(index.max()) + 1, WINDOW
    out = np.zeros(len(at) * width)
    rows = np.repeat(np.arange(len(at)) * width, n)
    for (a, b, c), weight in PATTERNS:
        numbers = (windows[:, :n] << 15) | (windows[:, a : a + n] << 10) | (windows[:, b : b + n] << 5) | windows[:, c : c + n]
        column = index[numbers.ravel()]
        known = column >= 0
        cells = np.sort(rows[known] + column[known])
        first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else cells
        out[cells[first]] += weight * np.diff(np.append(first, len(cells)))
    return out.reshape(len(at), width).astype(np.float32)


def _numbers(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    windows = codes[at[:, None] + np.arange(PAD)]
    n = WINDOW
    found = [((windows[:, :n] << 15) | (windows[:, a : a + n] << 10) | (windows[:, b : b + n] << 5) | windows[:, c : c + n]).ravel() for (a, b, c), _ in PATTERNS]
    found = np.unique(np.concatenate(found))
    edge = np.uint32(_EDGE)
    real = ((found & edge) != edge) & ((found >> np.uint32(5) & edge) != edge) & ((found >> np.uint32(10) & edge) != edge) & (found >> np.uint32(15) != edge)
    return found[real]


def _hinge_fit(x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, classes weighing alike; full-batch Nesterov steps."""
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    ones = np.hstack((x, np.ones((len(x), 1), dtype=x.dtype)))
    ridge = np.full(ones.shape[1], penalty)
    ridge[-1] = penalty * 1e-2
    steep = 2 * np.linalg.norm(ones * np.sqrt(each)[:, None], 2) ** 2 + penalty
    w = v = np.zeros(ones.shape[1])
    for step in range(300):
        slack = np.maximum(0, 1 - y * (ones @ v))
        after = v - (ridge * v - 2 * ones.T @ (each * y * slack)) / steep
        v = after + step / (step + 3) * (after - w)
        w = after
    return w[:-1], float(w[-1])


def _curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic curve by Newton steps on smoothed targets; labels weigh as if ``share`` of the rows were toxic."""
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    weigh = np.where(y, share / max(1, y.sum()), (1 - share) / max(1, (~y).sum())) * len(y)
    centre, scale = x.mean(), x.std() + 1e-6
    design = np.stack(((x - centre) / scale, np.ones(len(x))), axis=1)
    beta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = design.T @ (design * (weigh * p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2)
        beta -= np.linalg.solve(hessian, design.T @ (weigh * (p - target)) + 1e-6 * beta)
    slope = max(float(beta[0]), 0.0) / scale
    return slope, float(beta[1] - slope * centre)


def fit(texts: list[bytes], toxic: np.ndarray, share: float, how: Fitting = Fitting()) -> Model:
    """Fit on labelled texts, the last quarter of which only sets the curve; without both labels every text scores 0.

    ``share`` is the share of toxic rows among all labels that may be learned.
    """
    nothing = Model(np.zeros(_TABLE, dtype=np.float32), 0.0, -60.0)
    if not len(texts) or toxic.all() or not toxic.any():
        return nothing
    rng = np.random.default_rng(how.seed)
    mixed = rng.permutation(len(texts))
    kept_back = mixed[: len(texts) // 4] if len(texts) >= 40 else mixed
    learned = mixed[len(texts) // 4 :] if len(texts) >= 40 else mixed
    machine = _machine([texts[i] for i in learned], toxic[learned], rng, how)
    # The curve also sees the toxic texts with letters strewn in, so that a spoiled insult counts as one.
    spoiled = [_strewn(texts[i], rng, how.strewn) for i in kept_back if toxic[i]] if how.strewn else []
    codes, starts = _joined([texts[i] for i in kept_back] + spoiled)
    best, _ = strongest_windows(codes, starts, machine)
    return Model(machine, *_curve(best.astype(np.float64), np.append(toxic[kept_back], np.ones(len(spoiled), dtype=bool)), share))


def _strewn(text: bytes, rng: np.random.Generator, every: int) -> bytes:
    """A text with a random letter after one byte of ASCII in ``every``."""
    raw = np.frombuffer(text, dtype=np.uint8)
    at = np.flatnonzero((rng.random(len(raw)) < 1 / every) & (raw < 0x80)) + 1
    return np.insert(raw, at, rng.integers(ord("a"), ord("z") + 1, len(at)).astype(np.uint8)).tobytes()


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all texts, made of some texts at a time: the steps between need many bytes a letter."""
    parts, starts, end = [], [np.zeros(1, np.int64)], 0
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= _CHUNK:
            size += len(texts[j])
            j += 1
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts[i:j]]))).astype(np.int64)
        codes, inner = letters(np.frombuffer(b"".join(texts[i:j]), dtype=np.uint8), offsets)
        parts.append(codes)
        starts.append(inner[1:] + end)
        end += len(codes)
        i = j
    return np.concatenate(parts or [np.empty(0, np.uint32)]), np.concatenate(starts)


def _machine(texts: list[bytes], toxic: np.ndarray, rng: np.random.Generator, how: Fitting) -> np.ndarray:
    """The decision's weight per subsequence.  Its constant is left to the curve."""
    codes, starts = _joined(texts)
    # First guess: how much oftener toxic texts have four letters in a row.
    has = np.zeros((2, _TABLE), dtype=np.int32)
    for i, side in enumerate(toxic):
        own = codes[starts[i] : starts[i + 1]]
        run = own[:-3] << np.uint32(15) | own[1:-2] << np.uint32(10) | own[2:-1] << np.uint32(5) | own[3:]
        has[int(side), np.unique(run)] += 1
    rate = [(h + 0.5) / (side.sum() + 1) for h, side in zip(has, (~toxic, toxic))]
    # Half-way between a ratio and a difference: rare letters prove little.
    guess = np.where(has[1] > 2, (rate[1] - rate[0]) / np.sqrt(rate[1] + rate[0]), 0)
    weights = np.maximum(guess, 0).astype(np.float32)
    edge = np.arange(_TABLE)
    weights[((edge & 31) == 31) | ((edge >> 5 & 31) == 31) | ((edge >> 10 & 31) == 31) | ((edge >> 15) == 31)] = 0
    lengths = np.diff(starts) - PAD
    for _ in range(how.rounds):
        best, at = strongest_windows(codes, starts, weights)
        full = lengths > 0
        bad, good = at[toxic & full], at[~toxic & full]
        chance = (starts[:-1] + rng.integers(0, np.maximum(lengths, 1)))[~toxic & full]
        good = np.concatenate((good, chance))
        keep = lambda these: these[these + PAD <= len(codes)]
        bad, good = keep(bad), keep(good)
        half = how.landmarks // 2
        landmarks = np.concatenate((rng.permutation(bad)[:half], rng.permutation(good)[:half]))
        numbers = _numbers(codes, landmarks)
        index = np.full(_TABLE, -1, dtype=np.int32)
        index[numbers] = np.arange(len(numbers))
        basis = _describe(codes, landmarks, index)
        values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
        strong = values > values[-1] * 1e-6
        whiten = vectors[:, strong] / np.sqrt(values[strong])
        kernels = np.concatenate([_describe(codes, part, index) @ basis.T for part in np.array_split(np.concatenate((bad, good)), 64)])
        y = np.concatenate((np.ones(len(bad)), -np.ones(len(good))))
        u, _ = _hinge_fit(kernels.astype(np.float64) @ whiten, y, how.penalty)
        weights = np.zeros(_TABLE, dtype=np.float32)
        weights[numbers] = (whiten @ u) @ basis
    return weights


def sampled(docs: DataFrame, labels: DataFrame, how: Fitting) -> tuple[list[bytes], np.ndarray, float]:
    """A bounded sample of labelled rows, chosen by a hash of doc_id (the numbers and bytes of ``how`` per label), and the share of toxic labels."""
    known = labels.filter("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") == 1).alias("toxic")).distinct()
    order = F.xxhash64(F.lit(how.seed), "doc_id")
    there = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    halves = ((True, how.toxic_rows), (False, how.clean_rows))
    # At most 4,500 ids.
    chosen = [there.filter(F.col("toxic") == label).orderBy(order, "doc_id").limit(rows) for label, rows in halves]
    found = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id").filter(F.octet_length("text") > 0)
    sized = found.select("toxic", "doc_id", order.alias("o"), F.xxhash64("text").alias("print"), F.octet_length("text").cast("long").alias("size"))
    upto = F.sum("size").over(W.partitionBy("toxic").orderBy("o", "doc_id", "print").rowsBetween(W.unboundedPreceding, 0))
    taken = sized.filter(F.col("size") <= how.sample_bytes).withColumn("upto", upto).filter(F.col("upto") <= how.sample_bytes)
    kept = taken.groupBy("toxic", "doc_id", "print", "o").agg(F.count("*").alias("n"))
    rows = found.withColumn("print", F.xxhash64("text")).join(F.broadcast(kept), ["toxic", "doc_id", "print"])
    rows = rows.select("toxic", "o", "doc_id", "n", F.col("text").cast("binary").alias("raw")).distinct().collect()
    rows.sort(key=lambda row: (not row.toxic, row.o, row.doc_id, bytes(row.raw)))
    counts = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return [bytes(row.raw) for row in rows], np.array([row.toxic for row in rows], dtype=bool), float(counts or 0.0)


def _strongest(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    text = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] else np.empty(0, np.uint8)
    best, start = [np.empty(0, np.float32)], 0
    while start < len(text):
        end = start + 1
        while end < len(text) and offsets[end + 1] - offsets[start] <= _CHUNK:
            end += 1
        codes, starts = letters(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
        best.append(strongest_windows(codes, starts, weights)[0])
        start = end
    return np.concatenate(best)


def score(docs: DataFrame, labels: DataFrame, how: Fitting = Fitting()) -> Column:
    """The score of ``text``, 0 to 1, by a machine fitted on ``labels`` (doc_id, toxic) of ``docs``.

    A null, empty or letterless text gets the score of no evidence.  Without labels
    of both kinds all scores are near 0.  Only the text goes to Python workers.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(*sampled(docs, labels, how), how))

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = model.value
        for texts in batches:
            yield pa.array(known.score(_strongest(texts, known.weights).astype(np.float64)), pa.float64())
        release()

    return run(F.col("text").cast("string"))


def scored(docs: DataFrame, labels: DataFrame, how: Fitting = Fitting(), carry: list[str] | None = None, out: str = "score") -> DataFrame:
    """Columns ``carry`` of ``docs`` (all by default) and ``out``, the score of every row.

    ``docs`` has doc_id and text; a column of its own that is named ``out`` is
    replaced.  Rows that repeat are scored alike.  An empty table gives no rows.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c != out]
    return docs.select(*(F.col(f"`{c}`") for c in carry), score(docs, labels, how).alias(out))


def held_out(doc_id) -> object:
    """The fifth of the rows whose labels are never learned: crc32 of doc_id as text leaves 0 by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learnable(labels: DataFrame) -> DataFrame:
    return labels.filter(~held_out(F.col("doc_id")))

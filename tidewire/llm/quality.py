"""Quality classifier from weak labels: expectation-maximisation over overlapping heuristic labellers, then a hashed linear scorer.

1. vote(): each labeller says good, bad or nothing of a document. All documents vote; votes are counted per pattern (a partial
   aggregate with at most 3^labellers keys, so what comes to the driver doesn't grow with the data).
2. LabelModel: a naive-Bayes mixture of two classes in which a labeller that speaks is right with an accuracy of its own per
   class; expectation-maximisation over the pattern counts estimates accuracies and the share of good documents without any given
   label. It gives each pattern a posterior.
3. Scorer: hashed byte trigrams, lower- and upper-case as they stand, and hashed marks of shape (buckets of the shares of distinct
   words, of the commonest word, of capitals, symbols and repeated lines) with weights fitted by logistic regression to the
   posteriors of a sample of at most TRAIN_ROWS documents, drawn by the hash of id and text (a documented bound; the counts of
   step 2 are over all documents).
4. A document is kept if its score is at least KEEP.

Texts are read whole by each pass and never shuffled; each pass carries a row of bytes at most.

Cases: ties between equal hashes in the sample go by pattern, and rows equal in id and text are equal in the sample; null or empty
text: no labeller speaks, its score is the intercept's and the marks' of nothing, so it is judged like any other
(without evidence against it, kept); rows that share an id are judged one by one; null ids are judged; an empty table has the prior
model, which keeps all. An input column of the name quality_model is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, ship, with_row

TRAIN_ROWS = 2000
#: Buckets of the hashed trigrams, and of the hashed marks after them.
TRIGRAM_BITS = 12
TRIGRAMS, MARKS = 1 << TRIGRAM_BITS, 1 << 8
KEEP = 0.35
#: Labellers are written to be precise: of good documents each is held to be right in this share, with the weight of so many imagined
#: documents per document. It is a Beta prior, and accuracies are estimated under it; without it the likelihood is highest where junk
#: that only one labeller sees counts as good.
PRECISE, WEIGHT = 0.999, 2.0
_CAPITALS = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGITS, _SPACES, _POINTS = b"0123456789", b" \t\n\r\x0b\x0c", b".,;:?'\"-()"


@dataclass
class Shape:
    """What labellers look at."""

    words: int
    capitals: float
    symbols: float
    digits: float
    distinct: float
    top: float
    length: float
    echoes: float
    lines: float
    ends: float

    @classmethod
    def of(cls, text: bytes) -> Shape:
        n = len(text)
        share = lambda drop: n - len(text.translate(None, drop))
        letters = share(_LETTERS)
        symbols = n - letters - share(_DIGITS) - share(_SPACES) - share(_POINTS)
        words = text.lower().split()
        hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
        kinds = np.unique(hashes, return_counts=True)[1]
        different, most = len(kinds), int(kinds.max(initial=0))
        echoes = int((hashes[1:] == hashes[:-1]).sum())
        rows = [x for x in text.split(b"\n") if x.strip()]
        return cls(len(words), share(_CAPITALS) / max(1, letters), symbols / max(1, n), share(_DIGITS) / max(1, n), different / max(1, len(words)), most / max(1, len(words)), letters / max(1, len(words)), echoes / max(1, len(words)), len(set(rows)) / max(1, len(rows)), sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in rows) / max(1, len(rows)))

    def marks(self) -> list[str]:
        """Names of this shape's buckets."""
        size = "s" if self.words < 30 else "m" if self.words < 400 else "l"
        deal = lambda name, x, step, top: f"{name}{min(int(x / step), top)}"
        return [deal("capitals", self.capitals, 0.1, 6), deal("symbols", self.symbols, 0.01, 10), deal("digits", self.digits, 0.05, 8), deal("distinct" + size, self.distinct, 0.08, 12), deal("top" + size, self.top, 0.06, 8), deal("echoes", self.echoes, 0.08, 5), deal("lines", self.lines, 0.15, 6), deal("ends", self.ends, 0.25, 4), deal("length", self.length, 1.5, 8)]


def _between(low: float | None, high: float | None) -> Callable[[float], int]:
    """A vote by a value: 1 at low or under, -1 at high or over (None: never)."""
    return lambda x: 1 if low is not None and x <= low else -1 if high is not None and x >= high else 0


#: The labellers, by name. Each gives 1 (good), -1 (bad) or 0 (silent).
LABELLERS: dict[str, Callable[[Shape], int]] = {
    "capitals": lambda s: _between(0.12, 0.3)(s.capitals) if s.words >= 5 else 0,
    "symbols": lambda s: _between(0.005, 0.04)(s.symbols) if s.words >= 5 else 0,
    "distinct words": lambda s: 0 if s.words < 30 else -_between(0.3 if s.words < 3000 else 0.15, 0.5)(s.distinct),
    "commonest word": lambda s: 0 if s.words < 30 else _between(0.1, 0.22)(s.top),
    "echoes": lambda s: 0 if s.words < 8 else _between(0.05, 0.3)(s.echoes),
    "repeated lines": lambda s: 0 if s.words < 30 else -_between(0.6, 0.95)(s.lines),
    "sentence ends": lambda s: 0 if s.words < 30 else -_between(0.3, 0.8)(s.ends),
    "word length": lambda s: 0 if s.words < 30 else -1 if s.length < 2.5 or s.length > 12 else 1 if 3.5 <= s.length <= 8 else 0,
}


def vote(shape: Shape) -> int:
    """The pattern of all labellers' votes, three values a digit."""
    code = 0
    for f in LABELLERS.values():
        code = code * 3 + f(shape) + 1
    return code


def votes_of(codes: np.ndarray) -> np.ndarray:
    """A row of votes for each pattern."""
    m = len(LABELLERS)
    return codes[:, None] // 3 ** np.arange(m - 1, -1, -1)[None, :] % 3 - 1


class LabelModel:
    """Accuracies of the labellers and the share of good documents, by expectation-maximisation."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, rounds: int = 200):
        m = len(LABELLERS)
        #: the chance that a labeller that speaks is right, of good (row 0) and of bad documents (row 1)
        #: junk is of many kinds, each seen by few labellers: of bad documents a labeller may well be wrong more often than right
        self.right = np.stack([np.full(m, PRECISE), np.full(m, 0.3)])
        self.good = 0.8
        self.codes = codes
        votes, total = votes_of(codes), max(1, counts.sum())
        # the first guess: a document that some labeller calls bad is bad
        p = np.where((votes == -1).any(axis=1), 0.1, 0.98)
        for step in range(rounds if len(codes) else 0):
            p = self.posterior(codes) if step else p
            weight = np.stack([p * counts, (1 - p) * counts])
            # the priors as imagined documents: of bad ones a few, which keep a labeller that hardly speaks where it began
            imagined = np.array([[WEIGHT * total], [10.0]])
            hits = np.stack([weight[0] @ (votes == 1), weight[1] @ (votes == -1)]) + imagined * np.array([[PRECISE], [0.3]])
            spoken = np.stack([w @ (votes != 0) for w in weight]) + imagined
            before, self.right = self.right, np.clip(hits / spoken, 0.01, 0.9999)
            self.good = float(np.clip(weight[0].sum() / total, 0.02, 0.98))
            if np.abs(before - self.right).max() < 1e-7:
                break

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """The chance of good for each pattern."""
        v = votes_of(codes)
        good, bad = np.log(self.good), np.log1p(-self.good)
        a = good + np.where(v == 1, np.log(self.right[0]), np.where(v == -1, np.log1p(-self.right[0]), 0.0)).sum(axis=1)
        b = bad + np.where(v == -1, np.log(self.right[1]), np.where(v == 1, np.log1p(-self.right[1]), 0.0)).sum(axis=1)
        return 1 / (1 + np.exp(b - a))


def trigrams(text: bytes) -> np.ndarray:
    """The bucket of each byte trigram."""
    b = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, dtype=np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - TRIGRAM_BITS)


def _mark_buckets(shape: Shape) -> list[int]:
    return [TRIGRAMS + zlib.crc32(m.encode()) % MARKS for m in shape.marks()]


def features(text: bytes, shape: Shape) -> np.ndarray:
    """A dense row: shares of trigrams, scaled, and marks."""
    x = np.zeros(TRIGRAMS + MARKS, dtype=np.float32)
    t = trigrams(text)
    if len(t):
        x[:TRIGRAMS] = np.bincount(t, minlength=TRIGRAMS) * (10.0 / len(t))
    for k in _mark_buckets(shape):
        x[k] += 1
    return x


class Scorer:
    """Logistic regression on hashed features."""

    def __init__(self, x: np.ndarray, p: np.ndarray, rounds: int = 150, rate: float = 0.05, ridge: float = 1e-3):
        self.w, self.b = np.zeros(TRIGRAMS + MARKS, dtype=np.float32), 2.0
        first, second, fb, sb = np.zeros_like(self.w), np.zeros_like(self.w), 0.0, 0.0
        for step in range(1, rounds + 1 if len(x) else 1):
            z = x @ self.w + self.b
            e = 1 / (1 + np.exp(-z)) - p
            g, gb = x.T @ e / np.float32(len(x)) + ridge * self.w, float(e.mean())
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            fb, sb = 0.9 * fb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
            c, d = 1 - 0.9**step, 1 - 0.999**step
            self.w -= (rate * (first / c) / (np.sqrt(second / d) + 1e-8)).astype(np.float32)
            self.b -= rate * (fb / c) / (np.sqrt(sb / d) + 1e-8)

    def score(self, text: bytes) -> float:
        """The chance that text is good."""
        t = trigrams(text)
        z = self.b + (float(self.w[t].sum(dtype=np.float64)) * 10.0 / len(t) if len(t) else 0.0)
        z += sum(float(self.w[k]) for k in _mark_buckets(Shape.of(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[LabelModel, Scorer]:
    """Both models, from docs alone."""
    ship(docs.sparkSession)
    text = F.col(f"`{text_col}`")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, n = np.unique(np.array([vote(Shape.of(t)) for t in byte_rows(batch.column("t"))], dtype=np.int64), return_counts=True)
            yield pa.record_batch([pa.array(codes), pa.array(n.astype(np.int64))], names=["code", "n"])

    counted = sorted((r["code"], r["n"]) for r in docs.select(text.alias("t")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect())
    codes, counts = np.array([c for c, _ in counted], dtype=np.int64), np.array([n for _, n in counted], dtype=np.float64)
    model = LabelModel(codes, counts)
    rows = int(counts.sum())
    draw = F.xxhash64(F.col(f"`{id_col}`"), text)
    part = min(1.0, 1.5 * TRAIN_ROWS / max(1, rows))
    few = docs.select(draw.alias("h"), text.alias("t")).where(F.pmod("h", F.lit(1_000_003)) < F.lit(int(1_000_003 * part) + 1))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes_, raw = [], []
            for t in byte_rows(batch.column("t")):
                shape = Shape.of(t)
                x = features(t, shape)
                at = np.flatnonzero(x).astype(np.int32)
                codes_.append(vote(shape))
                raw.append(at.tobytes() + x[at].tobytes())
            yield pa.record_batch([batch.column("h"), pa.array(codes_, pa.int64()), pa.array(raw, pa.binary())], names=["h", "code", "x"])

    sample = few.mapInArrow(rows_of, "h long, code long, x binary").orderBy("h", "code").limit(TRAIN_ROWS).collect()
    x = np.zeros((len(sample), TRIGRAMS + MARKS), dtype=np.float32)
    for i, r in enumerate(sample):
        n = len(r["x"]) // 8
        x[i, np.frombuffer(r["x"][: 4 * n], np.int32)] = np.frombuffer(r["x"][4 * n :], np.float32)
    p = model.posterior(np.array([r["code"] for r in sample], dtype=np.int64)) if sample else np.empty(0)
    return model, Scorer(x, p.astype(np.float32))


def classify(docs: DataFrame, scorer: Scorer, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """docs plus quality_model: struct<score, keep>."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # TRIGRAMS + MARKS floats
    kept = [c for c in docs.columns if c != "quality_model"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text_col}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = np.array([own.score(t) for t in byte_rows(batch.column("t"))], dtype=np.float64)
            yield pa.record_batch([batch.column("row"), pa.array(scores)], names=["row", "score"])

    out = rows.mapInArrow(run, with_row(rows, "score double"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.struct("score", (F.col("score") >= keep).alias("keep")).alias("quality_model"))

"""Periodic run detection: an all-lag scan of word-id arrays finds every stretch of a text that repeats with some period.

Words `[^\\x20\\x09-\\x0D]+` become numbers, and the array of numbers is compared with itself shifted by each lag q up to
n / min_exponent. A true stretch of m(q) = max(min_length, min_exponent * q) - q places or more at lag q is a run of period q, unless
a divisor of q is a period of it too (by Fine and Wilf no other smaller period can be, as a run holds two periods at least).

Each lag is first compared at every m(q)-th place only: a stretch that is long enough covers one of these, so a lag without a hit
there has no run, and the places of all lags come to about n ln(n) / 2. Hits whose neighbours don't agree on either side fall in a
second vectorised step; a lag that still has one is compared in whole and its true stretches are run-length coded. Both steps take
whole slices of texts at once.

Spark distributes document-lag ranges: a text up to LONG_BYTES is one range and is scanned where it lies, without a shuffle; a longer
one (distinct by SHA-256) is sent to as many tasks as its lags times words need at BUDGET comparisons each, and the runs of its ranges,
fewer than its words, meet again by key. So no task has more than BUDGET comparisons, however long a text is.

Cases: a null or empty text has no words, no runs and an empty collapsed text; ties of exponent go to the smallest start, then the smallest
period; rows that are repeated or share an id are scanned each for itself; ids are not used. A column named periodic_runs is
replaced, further columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, ship, with_row, written

#: Texts over so many bytes are dealt to tasks by ranges of lags.
LONG_BYTES = 1 << 20
#: Comparisons of a range at most (words times lags).
BUDGET = 1 << 33
#: Words whose texts are scanned together, and sampled places compared at once.
SLICE, PLACES = 1 << 18, 1 << 21

RUN = "struct<start: bigint, length: bigint, period: bigint>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def gaps(lags: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """m(q): how many places in a row must agree at lag q."""
    return np.maximum(min_length - lags, (min_exponent - 1) * lags)


def _hits(ids: np.ndarray, begins: np.ndarray, counts: np.ndarray, lags: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of `counts` numbers at `begins` in ids and one lag each: the row and the place of each sampled pair that agrees
    together with its neighbours on one side."""
    tests = np.maximum(0, -(-(counts - lags) // step))
    rows = np.repeat(np.arange(len(lags)), tests)
    at = (np.arange(len(rows)) - np.repeat(np.cumsum(tests) - tests, tests)) * step[rows]
    here = begins[rows] + at
    same = ids[here] == ids[here + lags[rows]]
    rows, at = rows[same], at[same]
    # of the places in a row that must agree, half lie on one side of this one
    half = (step[rows] + 1) // 2
    fits = np.zeros(len(rows), dtype=bool)
    for sign in (-1, 1):
        left = np.arange(len(rows))
        for k in range(1, 8):
            place, row = at[left] + sign * k, rows[left]
            inside = (place >= 0) & (place + lags[row] < counts[row])
            here = begins[row] + np.where(inside, place, 0)
            agree = (k >= half[left]) | (inside & (ids[here] == ids[here + lags[row]]))
            left = left[agree]
        fits[left] = True
    return rows[fits], at[fits]


def _stretches(a: np.ndarray, q: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the true stretches of at least `least` places of a compared with a shifted by q, as words of the text."""
    same = np.zeros(len(a) - q + 2, dtype=np.int8)
    same[1:-1] = a[:-q] == a[q:]
    edges = np.flatnonzero(np.diff(same))
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if e - s >= least:
            yield s, e + q


def _divisors(q: int) -> list[int]:
    """q over each of its prime factors."""
    out, rest, f = [], q, 2
    while f * f <= rest:
        if rest % f == 0:
            out.append(q // f)
            while rest % f == 0:
                rest //= f
        f += 1
    return out + ([q // rest] if rest > 1 else [])


def scan(texts: list[np.ndarray], ranges: list[tuple[int, int]], min_length: int = 24, min_exponent: int = 3) -> list[list[tuple[int, int, int]]]:
    """For each array of word numbers its runs (start, length, period) whose period lies in its range [low, high), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not len(texts):
        return out
    ids, offsets = np.concatenate(texts), np.cumsum(sizes) - sizes
    lows = np.array([max(1, low) for low, _ in ranges], dtype=np.int64)
    highs = np.minimum(np.array([high for _, high in ranges], dtype=np.int64), sizes // min_exponent + 1)
    highs = np.where(sizes < min_length, lows, np.maximum(highs, lows))
    many = highs - lows
    # the flat list of all (text, lag), in blocks of about PLACES sampled places
    ends = np.cumsum(many)
    total, done = int(ends[-1]), 0
    while done < total:
        take = np.arange(done, min(total, done + PLACES // 4))
        text = np.searchsorted(ends, take, side="right")
        lag = lows[text] + take - (ends[text] - many[text])
        step = gaps(lag, min_length, min_exponent)
        load = np.cumsum(np.maximum(1, -(-(sizes[text] - lag) // step)))
        take_n = max(1, int(np.searchsorted(load, PLACES, side="right")))
        text, lag, step = text[:take_n], lag[:take_n], step[:take_n]
        done += take_n
        rows, at = _hits(ids, offsets[text], sizes[text], lag, step)
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else []
        for i, row in enumerate(rows[first].tolist()):
            d, q, least = int(text[row]), int(lag[row]), int(step[row])
            places = at[first[i] : first[i + 1] if i + 1 < len(first) else len(at)]
            # places inside a run whose period divides q agree at q as well and tell nothing new
            for s, n, p in out[d]:
                if q % p == 0:
                    places = places[(places < s) | (places >= s + n - q)]
            if not len(places):
                continue
            a = texts[d]
            for s, e in _stretches(a, q, least):
                if not any(np.array_equal(a[s : e - p], a[s + p : e]) for p in _divisors(q)):
                    out[d].append((s, e - s, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, p in runs:
        gone[s + p] += 1
        gone[s + n] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def numbers(words: list[bytes]) -> np.ndarray:
    """Each word's number within its text."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int32, count=len(words))


def _arrays(done: list[tuple[int, list[tuple[int, int, int]], bytes]]) -> list[pa.Array]:
    """n_words, runs and the collapsed text as Arrow columns."""
    dicts = [[{"start": s, "length": n, "period": p} for s, n, p in runs] for _, runs, _ in done]
    return [pa.array([n for n, _, _ in done], pa.int64()), pa.array(dicts, _RUNS), pa.array([c.decode() for _, _, c in done], pa.string())]


def _scan_here(rows: DataFrame, min_length: int, min_exponent: int) -> DataFrame:
    """row, t -> row, n_words, runs, kept: every text scanned where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, held, size, begin = [], [], 0, 0
            texts = byte_rows(batch.column("t"))
            for k in range(batch.num_rows):
                held.append(next(texts).split())
                size += len(held[-1])
                if size < SLICE and k + 1 < batch.num_rows:
                    continue
                arrays = [numbers(w) for w in held]
                found = scan(arrays, [(1, len(a) + 1) for a in arrays], min_length, min_exponent)
                done = [(len(w), r, collapse(w, r)) for w, r in zip(held, found, strict=True)]
                yield pa.record_batch([batch.column("row").slice(begin, len(held)), *_arrays(done)], names=["row", "n_words", "runs", "kept"])
                held, size, begin = [], 0, k + 1

    return rows.mapInArrow(run, with_row(rows, f"n_words bigint, runs array<{RUN}>, kept string"))


def _scan_ranges(rows: DataFrame, min_length: int, min_exponent: int) -> DataFrame:
    """row, t -> row, n_words, runs, kept: each distinct text's lags are dealt to tasks in ranges."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (key, part, parts, text) in enumerate(zip(batch.column("key").to_pylist(), batch.column("part").to_pylist(), batch.column("parts").to_pylist(), byte_rows(batch.column("t")), strict=True)):
                a = numbers(text.split())
                lags = len(a) // min_exponent
                found = scan([a], [(1 + lags * part // parts, 1 + lags * (part + 1) // parts)], min_length, min_exponent)[0]
                yield pa.record_batch([pa.array([key]), pa.array([[{"start": s, "length": n, "period": p} for s, n, p in found]], _RUNS)], names=["key", "runs"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(byte_rows(batch.column("t"))):
                words, runs = text.split(), [(r["start"], r["length"], r["period"]) for r in batch.column("runs")[k].as_py()]
                yield pa.record_batch([batch.column("row").slice(k, 1), *_arrays([(len(words), runs, collapse(words, runs))])], names=["row", "n_words", "runs", "kept"])

    size = F.octet_length("t").cast("double") / 6
    keyed = rows.withColumn("key", F.sha2("t", 256))
    units = keyed.select("key", "t").dropDuplicates(["key"]).withColumn("parts", F.ceil(size * size / min_exponent / BUDGET).cast("int"))
    units = units.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).repartition("key", "part")
    parts = units.mapInArrow(ranges, f"key string, runs array<{RUN}>")
    runs = written(parts.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs")), "runs")
    both = keyed.join(runs, "key").select("row", "t", F.transform("runs", lambda r: r).alias("runs"))
    return both.mapInArrow(finish, with_row(rows, f"n_words bigint, runs array<{RUN}>, kept string"))


def collapse_runs(docs: DataFrame, text_col: str = "text", min_length: int = 24, min_exponent: int = 3) -> DataFrame:
    """docs with text_col collapsed, plus periodic_runs: struct<n_words, n_runs, start, length, period, exponent_milli, runs>.

    A run is a stretch of consecutive words of smallest period q, of at least max(min_length, min_exponent * q) words, that no
    neighbouring word extends keeping that period. Of each run the words after its first q go, those left are joined by a space.
    start to exponent_milli are of the run with the greatest length / period, runs holds all of them by start, then period.
    min_length must be 8 at least and min_exponent 2.
    """
    if min_length < 8 or min_exponent < 2:
        raise ValueError("runs are of 8 words and two periods at least")
    ship(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{text_col}`").alias("t"))
    is_long = F.coalesce(F.octet_length("t") > LONG_BYTES, F.lit(False))
    found = _scan_here(rows.where(~is_long), min_length, min_exponent)
    if not rows.where(is_long).isEmpty():
        found = found.unionByName(_scan_ranges(rows.where(is_long), min_length, min_exponent))
    # the greatest exact length / period: a / b > c / d as a * d > c * b, in whole numbers
    better = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"]) | ((x["length"] * y["period"] == y["length"] * x["period"]) & (F.struct(x["start"], x["period"]) < F.struct(y["start"], y["period"])))
    best = F.aggregate("runs", F.lit(None).cast(RUN), lambda x, y: F.when(x.isNull() | better(y, x), y).otherwise(x))
    found = found.withColumn("best", best)
    milli = F.expr("(1000 * best.length) div best.period")
    digest = F.struct("n_words", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs")
    cols = [F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "periodic_runs"]
    return found.select(*cols, digest.alias("periodic_runs"))

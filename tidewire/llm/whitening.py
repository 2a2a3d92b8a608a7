"""Embedding whitening by TSQR: rows are centred with exact sums, each partition is factored by QR, R factors merge in a tree, and the
SVD of the last R gives the directions; no covariance matrix is formed.

Plan: vectors become whole numbers, x = floor(64 c) + 1000000, in one pass. Each distinct x vector once is the fit list (a distinct whose
partial side takes copies out before the shuffle), written to the shared folder with small integers, so three reads of it are cheap:

1. partial sums of each partition, added up exactly: n and S per dimension;
2. each partition's rows, (n x - S) / n with the difference taken in whole numbers, are folded into one R factor block by block, and FAN_IN
   factors at a time are stacked and factored again, level after level, until one is left (d x d numbers each, whatever the rows);
3. the largest deviation from the identity of what the rows become.

With R = U s V', the rows' covariance is V (s^2 / n) V', so whitening projects on V's columns over s / sqrt(n). The driver holds the
model alone, d x d numbers for each length of vector. The last pass goes over all rows without a shuffle.

Cases: rows whose vector is null, or holds a null or non-finite entry, go; so do those with an entry whose x is beyond 2^53 in size, which a
double would not hold. Vectors of another length are whitened by a fit list of their own; an empty vector has no components and
gives no rows. Repeated vectors count once for the fit and each give their rows; ids may be null or repeated. A direction without
variance (fewer distinct vectors than dimensions, a constant entry) has null whitened and explained 0, and is left out of identity_error, null if
nothing has variance. A deviation that no long can hold is null. Ties of eigenvalues keep the order of the SVD; a component's largest
entry is positive. An empty table gives no rows. Further columns of the table go unless named in keep.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, with_row, written

#: Fixed values of the grid: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: R factors that one task stacks, and rows folded into an R factor at a time.
FAN_IN, BLOCK = 16, 4096
#: A direction has no variance if its standard deviation is below this share of the largest.
NOTHING = 1e-11


@dataclass
class Model:
    """What whitening vectors of one length takes."""

    n: int
    sums: list[int]
    directions: np.ndarray  # [dimension, component]
    scales: np.ndarray  # sqrt of each component's eigenvalue; 0 where there is no variance
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, in whole numbers; Python's own where 64 bits might not do."""
        if self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) < 1 << 62:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """[row, component]; NaN where there is no variance."""
        out = self.rows(x) @ self.directions
        return np.divide(out, self.scales, out=np.full_like(out, np.nan), where=self.scales > 0)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        d = self.centred(x)
        most = max(abs(int(d.max(initial=0))), abs(int(d.min(initial=0))))
        if most * most * d.shape[1] < 1 << 63:
            return (d * d).sum(axis=1).tolist()
        exact = [sum(v * v for v in row) for row in d.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def grid(vectors: DataFrame, vec_col: str):
    """The column of whole numbers, null for vectors that take no part."""
    fine = lambda v: v.isNotNull() & (F.abs(v.cast("double")) < 2.0**53 / SCALE - SHIFT)  # noqa: E731  (false for NaN and infinities)
    v = F.col(f"`{vec_col}`")
    return F.when(F.forall(v, lambda c: F.coalesce(fine(c), F.lit(False))), F.transform(v, lambda c: F.floor(F.lit(SCALE) * c.cast("double")) + F.lit(SHIFT)))


def _lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, [place, dimension]) for each length of the lists in a column."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False))
    begins = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths).tolist():
        if dim:
            at = np.flatnonzero(lengths == dim)
            yield at, flat[begins[at][:, None] + np.arange(dim)].astype(np.int64)


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length of vector: n and S."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for batch in batches:
            for _, x in _lists(batch.column("x")):
                own = held.setdefault(x.shape[1], [0] * (x.shape[1] + 1))
                top = max(1, (1 << 62) // max(1, int(np.abs(x).max(initial=0))))
                for b in range(0, len(x), min(top, len(x))):
                    part = x[b : b + top]
                    held[x.shape[1]] = own = [s + t for s, t in zip(own, [len(part), *part.sum(axis=0).tolist()], strict=True)]
        rows = [(dim, i, str(s)) for dim, own in held.items() for i, s in enumerate(own)]
        dims, at, sums = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch([pa.array(dims, pa.int32()), pa.array(at, pa.int32()), pa.array(sums, pa.string())], names=["dim", "i", "s"])

    parts = fit.mapInArrow(run, "dim int, i int, s string")
    out: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("dim", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out.setdefault(r["dim"], {})[r["i"]] = int(r["s"])
    return {dim: (own[0], [own[i] for i in range(1, dim + 1)]) for dim, own in out.items()}


def _r_factors(fit: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """For each length of vector the R factor of its centred rows."""
    blank = {dim: Model(n, s, np.empty((dim, 0)), np.empty(0), np.empty(0)) for dim, (n, s) in sums.items()}
    fold = lambda r, rows: np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")
    kind = "dim int, part int, r binary"

    def pack(held: dict[int, tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for dim, (part, r) in held.items():
            yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([part], pa.int32()), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], names=["dim", "part", "r"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            for _, x in _lists(batch.column("x")):
                dim = x.shape[1]
                for b in range(0, len(x), BLOCK):
                    held[dim] = (part, fold(held[dim][1] if dim in held else None, blank[dim].rows(x[b : b + BLOCK])))
        yield from pack(held)

    def merge(tables: pa.Table) -> pa.Table:
        dim, part, r = tables.column("dim")[0].as_py(), min(tables.column("part").to_pylist()) // FAN_IN, None
        for _, raw in sorted(zip(tables.column("part").to_pylist(), tables.column("r").to_pylist(), strict=True)):
            r = fold(r, np.frombuffer(raw, dtype=np.float64).reshape(-1, dim))
        return pa.Table.from_batches(list(pack({dim: (part, r)})))

    parts = fit.rdd.getNumPartitions()
    level = fit.mapInArrow(first, kind)
    while parts > 1:
        level = level.groupBy("dim", F.expr(f"part div {FAN_IN}")).applyInArrow(merge, kind)
        parts = -(-parts // FAN_IN)
    return {r["dim"]: np.frombuffer(r["r"], dtype=np.float64).reshape(-1, r["dim"]) for r in level.collect()}


def _model(n: int, sums: list[int], r: np.ndarray, components: int) -> Model:
    """The SVD of R; singular values come by falling size."""
    dim = len(sums)
    _, s, vt = np.linalg.svd(r)
    s = np.concatenate([s, np.zeros(dim - len(s))])
    values = s * s / n
    live = s > s[0] * NOTHING
    k = min(components, dim)
    v = vt[:k].T.copy()
    v *= np.where(np.take_along_axis(v, np.abs(v).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0)
    whole = values.sum()
    return Model(n, sums, v, np.where(live[:k], s[:k] / np.sqrt(n), 0.0), np.where(live[:k], values[:k] / (whole or 1.0), 0.0))


def _identity_errors(fit: DataFrame, models: dict[int, Model]) -> dict[int, float | None]:
    """For each length of vector the largest absolute entry of the whitened rows' covariance minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _lists(batch.column("x")):
                model = models[x.shape[1]]
                for b in range(0, len(x), BLOCK):
                    w = np.nan_to_num(model.whitened(x[b : b + BLOCK]))
                    w = np.hstack([np.ones((len(w), 1)), w])
                    held[x.shape[1]] = held.get(x.shape[1], 0.0) + w.T @ w
        rows = [(dim, i, float(s)) for dim, own in held.items() for i, s in enumerate(own.ravel())]
        dims, at, sums = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch([pa.array(dims, pa.int32()), pa.array(at, pa.int32()), pa.array(sums, pa.float64())], names=["dim", "i", "s"])

    parts, out = fit.mapInArrow(run, "dim int, i int, s double"), {}
    got: dict[int, dict[int, float]] = {}
    for r in parts.groupBy("dim", "i").agg(F.sum("s").alias("s")).collect():
        got.setdefault(r["dim"], {})[r["i"]] = r["s"]
    for dim, own in got.items():
        k = len(models[dim].scales) + 1
        m = np.array([own[i] for i in range(k * k)]).reshape(k, k) / models[dim].n
        live = models[dim].scales > 0
        off = (m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(k - 1))[np.ix_(live, live)]
        out[dim] = float(np.abs(off).max()) if live.any() else None
    return out


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = 16) -> tuple[dict[int, Model], dict[int, float | None]]:
    """For each length of vector its model and how far from the identity the covariance of its whitened fit list is."""
    ship(vectors.sparkSession)
    x = vectors.select(grid(vectors, vec_col).alias("x")).where("x is not null and size(x) > 0").distinct()
    # whole numbers near zero: a byte or two an entry
    x = written(x, "fit-list")
    sums = _sums(x)
    models = {dim: _model(*sums[dim], r, components) for dim, r in _r_factors(x, sums).items()}
    return models, _identity_errors(x, models)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per vector and component: the id column, component, n, deviation, whitened, explained, identity_error, and the columns in keep."""
    models, errors = fit(vectors, vec_col, components)
    raw = pickle.dumps((models, errors))
    rows = vectors.select(F.struct(*[F.col(f"`{c}`") for c in (id_col, *keep)]).alias("row"), grid(vectors, vec_col).alias("x")).where("x is not null and size(x) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, errors = pickle.loads(raw)
        for whole in batches:
            for b in range(0, whole.num_rows, BLOCK // 4):
                batch = whole.slice(b, BLOCK // 4)
                for at, x in _lists(batch.column("x")):
                    model = models[x.shape[1]]
                    k = len(model.scales)
                    w = model.whitened(x).ravel()
                    each = lambda v: np.repeat(v, k)
                    columns = [
                        batch.column("row").take(pa.array(each(at))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(at) * k, model.n, dtype=np.int64)),
                        pa.array([v for v in model.deviations(x) for _ in range(k)], pa.int64()),
                        pa.array(w, mask=np.isnan(w)),
                        pa.array(np.tile(model.explained, len(at))),
                        pa.array([errors[x.shape[1]]] * (len(at) * k), pa.float64()),
                    ]
                    yield pa.record_batch(columns, names=["row", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = rows.mapInArrow(run, with_row(rows, "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"))
    names = [id_col, *keep]
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "component", "n", "deviation", "whitened", "explained", "identity_error")

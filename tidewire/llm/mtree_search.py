"""Exact top-k by inner product: best-first search in M-trees of paged metric nodes.

Inner products become distances by one more component: with M at least every norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) have
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the nearest rows are those of highest score, and the triangle inequality holds.

1. Rows are dealt to blocks of about BLOCK_ROWS: to the nearest of at most PIVOTS pivots (a bounded sample, the rows of smallest id
   hash) and, where a pivot has more rows than a block, by the hash of the row. So a block is a metric neighbourhood, and a vector
   that a third of all rows share is spread over as many blocks as it fills.
2. Each block is bulk-loaded into an M-tree: inner nodes hold routing objects with covering radius and distance to the parent,
   leaf pages hold rows with their distance to the page's router. A block's tree is one row of the written page table; its centre and
   covering radius are its entry in the routing level above all blocks.
3. Each query first searches the block that it lies in, the nearest one, from the bound that the sample gives. With the k-th best
   found there, packs of queries meet the routing level: only blocks whose covering radius reaches into the bound are asked.
4. In a block the search pops nodes by their least possible distance, skips children and rows by |d(q, parent) - d(x, parent)| before
   their own distance is computed, and stops when the nearest node left is beyond the k-th best so far.
5. The k best of each query's blocks are ranked.

Distances only prune, with a margin for rounding; scores are exact integers. While all squared norms are under 2^53, floats hold them
exactly. Beyond, distances and first scores are of vectors scaled by a power of two, with margins for their rounding, and what may be
among the k best is scored in whole integers.

Cases: a null vector, or one with a null, NaN or infinite component, or whose scaled component is infinite, takes no part, nor does a
null id; rows that share an id are rows of their own: each is a candidate, and a query if the id says so, and only the very row is left
out of its own candidates; vectors meet those of their own dimension only, empty ones each other, with score 0; ties go to the smaller id; fewer than k candidates give
fewer rows; a score beyond 64 bits ranks and shows as the nearest 64-bit integer. Further columns don't take part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written

PIVOTS = 256
SAMPLE = 2048
#: Rows and megabytes of a block.
BLOCK_ROWS, BLOCK_MB = 4096, 16
#: Blocks whose queries are packed together, and blocks in an entry of the routing level.
PACK_BLOCKS, ROUTER_BLOCKS = 6, 1024
PAGE_ROWS = 256
FANOUT = 16
LONG = 1 << 63


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with the component that makes all norms sqrt(top)."""
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def _distances(a: np.ndarray, one: np.ndarray) -> np.ndarray:
    d = a - one
    return np.sqrt((d * d).sum(axis=1))


@dataclass(frozen=True)
class Space:
    """The metric space of vectors of one dimension: how they are scaled and lifted, and the margins of bounds."""

    dim: int
    top: float  # least square that no scaled norm exceeds
    scale: float  # 1 while scores are exact in floats, else a power of two
    k: int

    @classmethod
    def of(cls, dim: int, top: float, big: float, k: int) -> Space:
        if top < 2**53:
            return cls(dim, top, 1.0, k)
        scale = 2.0 ** -int(np.frexp(big)[1])
        norm = top * scale * scale
        return cls(dim, float(norm) * (1 + 1e-9) if np.isfinite(norm) and norm > 0 else float(dim), scale, k)

    @property
    def exact(self) -> bool:
        return self.scale == 1.0

    @property
    def slack(self) -> float:
        """How far a scaled score may be from the true one."""
        return 0.0 if self.exact else 4 * (self.dim + 2) * 2.0**-52 * self.top

    def bound(self, score: np.ndarray | float) -> np.ndarray:
        """A scaled score as a bound for others: those beyond 64 bits on one side count as equal."""
        if self.exact:
            return np.asarray(score)
        cap = float(LONG) * self.scale * self.scale
        return np.where(np.asarray(score) <= -cap, -np.inf, np.minimum(score, cap))

    def lift(self, x: np.ndarray) -> np.ndarray:
        return lifted(x * self.scale, self.top)

    def reach(self, q2: np.ndarray | float, score: np.ndarray | float) -> np.ndarray:
        """The distance within which rows score at least score with a query of squared norm q2, with margins."""
        wide = 1e-6 if self.exact else 8 * np.sqrt((self.dim + 2) * 2.0**-52 * self.top)
        return np.sqrt(np.maximum(q2 + self.top - 2 * (score - 2 * self.slack), 0.0)) * (1 + 1e-9) + wide


class Tree:
    """An M-tree over the rows of a block, its nodes in flat arrays.

    rows are in page order. Node i holds entries entry[i]..entry[i + 1]: for an inner node (leaf[i] false) the entries are children,
    with child, router, radius and parent distance; for a page they are rows: child is the row's place, radius 0.
    """

    def __init__(self, ids: np.ndarray, uids: np.ndarray, x: np.ndarray, space: Space):
        self.space = space
        self.leaf: list[bool] = []
        self.spans: list[tuple[int, int]] = []
        child, radius, parent, router = [], [], [], []
        points, order = space.lift(x), []
        draw = np.random.default_rng(len(ids))

        def add(rows: np.ndarray, center: np.ndarray) -> int:
            me = len(self.leaf)
            self.leaf.append(len(rows) <= PAGE_ROWS)
            self.spans.append((0, 0))
            if self.leaf[me]:
                first = len(order)
                order.extend(rows.tolist())
                begin = len(child)
                child.extend(range(first, first + len(rows)))
                radius.extend([0.0] * len(rows))
                parent.extend(_distances(points[rows], center).tolist())
                router.extend([-1] * len(rows))
                self.spans[me] = (begin, len(child))
                return me
            picks = draw.choice(rows, size=min(FANOUT, len(rows)), replace=False)
            far = np.stack([_distances(points[rows], points[p]) for p in picks])
            own = far.argmin(axis=0)
            parts = [(int(p), rows[own == j], far[j][own == j]) for j, p in enumerate(picks) if (own == j).any()]
            if max(len(r) for _, r, _ in parts) > 0.9 * len(rows):  # as good as equal: cut by count
                cuts = np.array_split(np.arange(len(rows)), FANOUT)
                parts = [(int(picks[0]), rows[c], far[0][c]) for c in cuts if len(c)]
            kids = [(add(r, points[p]), p, float(d.max()), float(_distances(points[[p]], center)[0])) for p, r, d in parts]
            begin = len(child)
            for c, p, d, up in kids:
                child.append(c)
                router.append(p)
                radius.append(d)
                parent.append(up)
            self.spans[me] = (begin, len(child))
            return me

        center = points[0] if len(points) else np.zeros(1)
        self.root = add(np.arange(len(ids)), center) if len(ids) else -1
        where = np.array(order, dtype=np.int64)
        self.ids, self.uids, self.x = ids[where], uids[where], x[where]
        self.child, self.radius, self.parent = np.array(child), np.array(radius), np.array(parent)
        self.routers = points[np.maximum(np.array(router, dtype=np.int64), 0)] if len(ids) else points
        self.center, self.reach = center, float(_distances(points, center).max()) if len(ids) else 0.0
        self.computed = 0

    def best(self, q: np.ndarray, own: int, floor: float) -> tuple[list[tuple[int, int, int]], float]:
        """((-score, id, uid) of the k rows of highest score but the row own, a scaled score that the k-th best reaches); rows that
        score under floor may be left out."""
        space, k = self.space, self.space.k
        scaled = q * space.scale
        lift, q2 = np.append(scaled, 0.0), float(scaled @ scaled)
        at, scores = np.empty(0, dtype=np.int64), np.empty(0)
        bound = float(space.reach(q2, floor))
        away = float(_distances(self.center[None], lift)[0])
        heap = [(max(away - self.reach, 0.0), self.root, away)]
        while heap:
            least, node, to_parent = heapq.heappop(heap)
            if least > bound:
                break
            begin, end = self.spans[node]
            near = np.flatnonzero(np.abs(to_parent - self.parent[begin:end]) - self.radius[begin:end] <= bound) + begin
            if not len(near):
                continue
            self.computed += len(near)
            if not self.leaf[node]:
                d = _distances(self.routers[near], lift)
                low = np.maximum(d - self.radius[near], 0.0)
                for i in np.flatnonzero(low <= bound).tolist():
                    heapq.heappush(heap, (float(low[i]), int(self.child[near[i]]), float(d[i])))
                continue
            # a page's rows lie side by side
            rows = np.arange(int(self.child[begin]), int(self.child[end - 1]) + 1) if len(near) == end - begin else self.child[near]
            s = ((self.x[rows[0] : rows[-1] + 1] if len(near) == end - begin else self.x[rows]) * space.scale) @ scaled
            fit = np.flatnonzero((s >= floor - 2 * space.slack) & (self.uids[rows] != own))
            if len(fit):
                at, scores = np.concatenate([at, rows[fit]]), np.concatenate([scores, s[fit]])
                if len(scores) > k:
                    kth = float(space.bound(np.partition(scores, -k)[-k]))
                    keep = scores >= kth - 2 * space.slack
                    at, scores = at[keep], scores[keep]
                    if space.exact and len(scores) > k:  # ties
                        first = np.lexsort((self.uids[at], self.ids[at], -scores))[:k]
                        at, scores = at[first], scores[first]
                if len(scores) >= k:
                    floor = max(floor, float(space.bound(np.partition(scores, -k)[-k])))
                    bound = min(bound, float(space.reach(q2, floor)))
        if space.exact:
            whole = [-int(x) for x in scores]
        else:
            parts = [int(c) for c in q]
            whole = [-max(-LONG, min(LONG - 1, sum(a * int(b) for a, b in zip(parts, self.x[r].tolist(), strict=True)))) for r in at.tolist()]
        return sorted(zip(whole, self.ids[at].tolist(), self.uids[at].tolist(), strict=True))[:k], floor

    def to_row(self) -> dict[str, list]:
        nodes = np.array([(*s, leaf) for s, leaf in zip(self.spans, self.leaf, strict=True)], dtype=np.int64)
        inner = np.concatenate([np.arange(a, b) for a, b, leaf in nodes.tolist() if not leaf] or [np.empty(0, np.int64)]).astype(np.int64)
        raw = {"ids": self.ids, "uids": self.uids, "x": self.x, "nodes": nodes, "child": self.child.astype(np.int64), "radius": self.radius, "parent": self.parent, "inner": inner, "routers": self.routers[inner], "center": self.center}
        return {**{name: [np.ascontiguousarray(v).tobytes()] for name, v in raw.items()}, "root": [self.root], "reach": [self.reach]}

    @classmethod
    def from_row(cls, r: dict, space: Space) -> Tree:
        t, dim = cls.__new__(cls), space.dim
        nodes = np.frombuffer(r["nodes"], np.int64).reshape(-1, 3)
        t.space, t.spans, t.leaf = space, [(a, b) for a, b, _ in nodes.tolist()], [bool(x) for x in nodes[:, 2]]
        t.ids, t.uids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["uids"], np.int64)
        t.x = np.frombuffer(r["x"]).reshape(len(t.ids), dim)
        t.child, t.radius, t.parent = np.frombuffer(r["child"], np.int64), np.frombuffer(r["radius"]), np.frombuffer(r["parent"])
        t.routers = np.zeros((len(t.child), dim + 1))
        t.routers[np.frombuffer(r["inner"], np.int64)] = np.frombuffer(r["routers"]).reshape(-1, dim + 1)
        t.center, t.root, t.reach, t.computed = np.frombuffer(r["center"]), r["root"], r["reach"], 0
        return t


_TREE = "ids binary, uids binary, x binary, nodes binary, child binary, radius binary, parent binary, inner binary, routers binary, center binary, root int, reach double"
_HITS = pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64()), ("uid", pa.int64())]))


def _hits(found: list[tuple[int, int, int]]) -> list[dict[str, int]]:
    return [{"score": -s, "vec_id": i, "uid": u} for s, i, u in found]


def top_k(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, the k best of all others, by floor(scale * x) of components x."""
    spark = table.sparkSession
    ship(spark)
    v = F.col(f"`{vector_col}`")
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = table.where(F.col(f"`{id_col}`").isNotNull() & good).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.monotonically_increasing_id().alias("uid"), v.cast("array<double>").alias("v"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            with np.errstate(over="ignore"):
                flat = np.floor(scale * flat)
                cuts = np.concatenate([[0], np.cumsum(batch.column("v").value_lengths().to_numpy())]).tolist()
                parts = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                keep = [i for i, x in enumerate(parts) if np.isfinite(x).all()]
                made = [(len(parts[i]), parts[i].tobytes(), float(parts[i] @ parts[i]), float(np.abs(parts[i]).max(initial=0.0))) for i in keep]
            cols = list(zip(*made, strict=True)) if made else [()] * 4
            kinds = (pa.int32(), pa.binary(), pa.float64(), pa.float64())
            yield pa.record_batch([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("id", "uid")] + [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "uid", "dim", "x", "norm", "big"])

    # written, so that a row keeps its uid
    rows = written(rows.mapInArrow(whole, "id long, uid long, dim int, x binary, norm double, big double"), "vectors")
    shapes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("top"), F.max("big").alias("big")).collect()  # a row per dimension
    results = None
    for r in shapes:
        found = _one_dimension(rows.where(F.col("dim") == r["dim"]), int(r["n"]), Space.of(int(r["dim"]), float(r["top"]), float(r["big"]), k), every)
        results = found if results is None else results.unionByName(found)
    if results is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_dimension(rows: DataFrame, n: int, space: Space, every: int) -> DataFrame:
    spark, dim, k = rows.sparkSession, space.dim, space.k
    block_rows = max(64, min(BLOCK_ROWS, (BLOCK_MB << 20) // (8 * (dim + 1))))
    blocks = -(-n // block_rows)
    drawn = rows.orderBy(F.xxhash64(F.lit(17), "id"), "id", "uid").limit(SAMPLE).collect()
    sample_uids = np.array([r["uid"] for r in drawn], dtype=np.int64)
    sample = np.frombuffer(b"".join(bytes(r["x"]) for r in drawn)).reshape(len(drawn), dim) * space.scale
    pivots = space.lift(sample[: min(blocks, PIVOTS)] / space.scale)
    vectors = lambda column: np.frombuffer(b"".join(column)).reshape(len(column), dim)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = space.lift(vectors(batch.column("x").to_pylist()))
            near = np.concatenate([(points[s : s + 1024] @ pivots.T).argmax(axis=1) for s in range(0, len(points), 1024)]) if len(points) else np.empty(0, np.int64)
            yield pa.record_batch([batch.column("id"), batch.column("uid"), batch.column("x"), pa.array(near.astype(np.int32))], names=["id", "uid", "x", "pivot"])

    dealt = written(rows.select("id", "uid", "x").mapInArrow(deal, "id long, uid long, x binary, pivot int"), "dealt")
    first, shape = 0, []
    for r in sorted(dealt.groupBy("pivot").count().collect()):  # at most PIVOTS rows
        parts = -(-r["count"] // block_rows)
        shape.append((r["pivot"], first, parts))
        first += parts
    placed = dealt.join(F.broadcast(spark.createDataFrame(shape, "pivot int, first int, parts int")), "pivot").withColumn("block", F.col("first") + F.pmod(F.xxhash64("uid"), "parts").cast("int")).select("block", "id", "uid", "x")

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        tree = Tree(pdf["id"].to_numpy(np.int64), pdf["uid"].to_numpy(np.int64), vectors(pdf["x"]), space)
        return pd.DataFrame({"block": [key[0]], **tree.to_row()})

    pages = written(placed.groupBy("block").applyInPandas(build, f"block int, {_TREE}"), "pages")

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """A block's queries, each with the score that the k-th best of the sample reaches."""
        uids, x = pdf["uid"].to_numpy(np.int64), vectors(pdf["x"])
        scores = (x * space.scale) @ sample.T
        scores[uids[:, None] == sample_uids[None, :]] = -np.inf
        floor = space.bound(np.partition(scores, -k, axis=1)[:, -k]) if scores.shape[1] >= k else np.full(len(uids), -np.inf)
        return pd.DataFrame({"block": [key[0]], "quids": [uids.tobytes()], "qids": [pdf["id"].to_numpy(np.int64).tobytes()], "q": [x.tobytes()], "floor": [floor.tobytes()]})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of each query in a block; from is that block."""
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                tree = Tree.from_row(r, space)
                uids, ids, floor = np.frombuffer(r["quids"], np.int64), np.frombuffer(r["qids"], np.int64), np.frombuffer(r["floor"])
                q = np.frombuffer(r["q"]).reshape(len(ids), dim)
                found = [tree.best(q[j], own, float(floor[j])) for j, own in enumerate(uids.tolist())]
                yield pa.record_batch(
                    [pa.array([r["block"]] * len(uids), pa.int32()), pa.array(uids), pa.array(ids), pa.array([x.tobytes() for x in q], pa.binary()), pa.array([f for _, f in found], pa.float64()), pa.array([_hits(h) for h, _ in found], _HITS)],
                    names=["from", "query_uid", "query_id", "x", "floor", "hits"],
                )

    asked = "block int, quids binary, qids binary, q binary, floor binary"
    searched = "from int, query_uid long, query_id long, x binary, floor double, hits array<struct<score:long,vec_id:long,uid:long>>"
    own = placed.where(F.col("id") % every == 0).groupBy("block").applyInPandas(pack, asked)
    home = written(own.join(pages, "block").mapInArrow(search, searched), "home")

    def routers(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"entry": [key[0]], "blocks": [pdf["block"].to_numpy(np.int32).tobytes()], "centers": [b"".join(pdf["center"])], "reaches": [pdf["reach"].to_numpy(np.float64).tobytes()]})

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"homes": [pdf["from"].to_numpy(np.int32).tobytes()], "quids": [pdf["query_uid"].to_numpy(np.int64).tobytes()], "qids": [pdf["query_id"].to_numpy(np.int64).tobytes()], "q": [b"".join(pdf["x"])], "floor": [pdf["floor"].to_numpy(np.float64).tobytes()]})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block of an entry of the routing level the queries of a pack that it may serve."""
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                blocks_, centers, reaches = np.frombuffer(r["blocks"], np.int32), np.frombuffer(r["centers"]).reshape(-1, dim + 1), np.frombuffer(r["reaches"])
                homes, uids, ids, floor = np.frombuffer(r["homes"], np.int32), np.frombuffer(r["quids"], np.int64), np.frombuffer(r["qids"], np.int64), np.frombuffer(r["floor"])
                q = np.frombuffer(r["q"]).reshape(len(ids), dim)
                scaled = q * space.scale
                q2 = (scaled * scaled).sum(axis=1)
                bound = space.reach(q2, floor)
                lifts = np.concatenate([scaled, np.zeros((len(q), 1))], axis=1)
                for b, center, reach in zip(blocks_.tolist(), centers, reaches.tolist(), strict=True):
                    at = np.flatnonzero((_distances(lifts, center) - reach <= bound) & (homes != b))
                    if len(at):
                        yield pa.record_batch([pa.array([b], pa.int32()), *[pa.array([np.ascontiguousarray(v[at]).tobytes()], pa.binary()) for v in (uids, ids, q, floor)]], names=["block", "quids", "qids", "q", "floor"])

    level = pages.select("block", "center", "reach").groupBy(F.floor(F.col("block") / ROUTER_BLOCKS).alias("entry")).applyInPandas(routers, "entry long, blocks binary, centers binary, reaches binary")
    packs = home.groupBy(F.floor(F.col("from") / PACK_BLOCKS).alias("pack")).applyInPandas(packed, "homes binary, quids binary, qids binary, q binary, floor binary")
    every_entry = F.explode(F.sequence(F.lit(0), F.lit((max(1, first) - 1) // ROUTER_BLOCKS)).cast("array<bigint>"))
    asks = packs.withColumn("entry", every_entry).join(written(level, "routers"), "entry").mapInArrow(route, asked)
    rest = asks.join(pages, "block").mapInArrow(search, searched)
    return home.unionByName(rest).select("query_uid", "query_id", F.inline("hits"))

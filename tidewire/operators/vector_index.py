"""Nearest neighbours by an inverted file: vectors in cells around centroids, of which a query reads a few; and an exact search by bounds.

Build: centroids come from Spark's own k-means over at most SAMPLE unit vectors, drawn by the hash of the id (the sample bounds the
training alone: every vector is indexed). Each vector goes to the cell of its nearest centroid, in one pass over the table; the index is
a Parquet table with a folder for each cell, so a probe reads that cell's files alone. A cell is as many files as it needs: one that
holds a third of all vectors is dealt out by id like the rest. Cells' centroids and radii (the largest angle of a member) are a small table.

Search: each query meets the cells by angle. approximate() probes the nearest n_probe of them; calibrate() finds the n_probe that reaches
a wanted recall on queries of the table itself, measured against all rows. exact() probes cells in rounds until the k-th best found is
nearer than any vector of an unread cell can be: angles obey the triangle inequality, so a cell whose centroid is at a and whose radius is
r holds nothing nearer than a - r.

Similarity is the cosine, to six digits, ties to the smaller id. Cases: null vectors, those with null, NaN or infinite entries or without
length, vectors of another dimension than the first of the sample, and rows without an id are not indexed; rows that share an id are rows of their own;
a query without such a vector finds nothing; fewer than k rows are all returned; an empty table gives an empty index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that the centroids are fitted to, rows of a cell that are aimed at, cells at most, and rows that a file of a cell holds, about.
SAMPLE, CELL_ROWS, MAX_CELLS, FILE_ROWS = 20_000, 2_000, 4_096, 500_000
#: Queries that calibrate() measures with.
PROBES = 200
#: Rounding of angles.
SLACK = 1e-6


@dataclass
class VectorIndex:
    """A written index: its folder, its centroids (unit vectors) and each cell's radius and number of rows."""

    path: str
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null, NaN or infinite entry, and not all zero."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that have dim entries, and these as a matrix."""
    at = np.flatnonzero(column.value_lengths().to_numpy(zero_copy_only=False) == dim)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    return at, np.asarray(flat, dtype=np.float64).reshape(len(at), dim)


def build(df: DataFrame, id_col: str, vector_col: str, path: str, cells: int | None = None, seed: int = 1) -> VectorIndex:
    """Writes the index of df's vectors to path."""
    spark = df.sparkSession
    rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    total = rows.count()
    if not total:
        return VectorIndex(path, np.empty((0, 0)), np.empty(0), np.empty(0, dtype=np.int64))
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE)
    dim = sample.select(F.size("v").alias("n")).first()["n"]
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    points = sample.where(F.size("v") == dim).select(array_to_vector(F.transform("v", lambda x: x / norm)).alias("features"))
    k = cells or max(1, min(MAX_CELLS, total // CELL_ROWS, SAMPLE // 20) or 1)
    model = KMeans(k=max(2, k), seed=seed, maxIter=15, initMode="k-means||").fit(points) if k > 1 else None
    centers = np.array(model.clusterCenters()) if model else np.array([np.eye(1, dim)[0]])
    centroids = _unit(centers[np.linalg.norm(centers, axis=1) > 0])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _rows_of(batch.column("v"), dim)
            near = np.empty(len(x), dtype=np.int32)
            angle = np.empty(len(x))
            for s in range(0, len(x), 1024):
                cosines = _unit(x[s : s + 1024]) @ centroids.T
                near[s : s + 1024] = cosines.argmax(axis=1)
                angle[s : s + 1024] = np.arccos(np.clip(cosines.max(axis=1), -1, 1))
            yield pa.record_batch([batch.column("id").take(pa.array(at)), batch.column("v").take(pa.array(at)), pa.array(near), pa.array(angle)], names=["id", "v", "cell", "angle"])

    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.mapInArrow(deal, f"id {kind}, v array<double>, cell int, angle double")
    # a cell of more than FILE_ROWS rows goes to several tasks, by id
    parts = -(-total // FILE_ROWS)
    dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", F.pmod(F.xxhash64("id"), F.lit(parts))).write.mode("overwrite").partitionBy("cell").parquet(path)
    radii, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), dtype=np.int64)
    for r in spark.read.parquet(path).groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect():  # a row per cell
        radii[r["cell"]], sizes[r["cell"]] = r["r"], r["n"]
    return VectorIndex(path, centroids, radii, sizes)


def _angles(index: VectorIndex, queries: list[tuple]) -> tuple[list, np.ndarray, np.ndarray]:
    """The ids of queries that can be asked, their vectors and their angles to all centroids. Queries are what a user asks at once: a list."""
    dim = index.centroids.shape[1] if len(index.centroids) else -1
    kept = [(i, v) for i, v in queries if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.array([v for _, v in kept], dtype=np.float64).reshape(len(kept), max(dim, 0))
    return [i for i, _ in kept], x, np.arccos(np.clip(_unit(x) @ index.centroids.T, -1, 1)) if len(kept) else np.empty((0, len(index.centroids)))


def _probe(spark: SparkSession, index: VectorIndex, ids: list, x: np.ndarray, probes: list[np.ndarray], k: int, id_type: str) -> DataFrame:
    """query, id, similarity: the k best of each query's cells. Reads the cells asked for alone."""
    asked: dict[int, list[int]] = {}
    for q, cells in enumerate(probes):
        for c in cells.tolist():
            asked.setdefault(c, []).append(q)
    units = _unit(x) if len(x) else x

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of each batch and query; ties by id."""
        for batch in batches:
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            _, v = _rows_of(batch.column("v"), units.shape[1])
            v = _unit(v)
            names = batch.column("id")
            order = np.argsort(pc.sort_indices(names).to_numpy(), kind="stable")
            of, at, value = [], [], []
            for c in np.unique(cells).tolist():
                here = np.flatnonzero(cells == c)
                for s in range(0, len(asked[c]), 256):
                    some = asked[c][s : s + 256]
                    found = np.round(v[here] @ units[some].T, 6)
                    for j, q in enumerate(some):
                        best = np.lexsort((order[here], -found[:, j]))[:k]
                        of.extend([q] * len(best))
                        at.extend(here[best].tolist())
                        value.extend(found[best, j].tolist())
            yield pa.record_batch([pa.array(of, pa.int32()), names.take(pa.array(at, pa.int64())), pa.array(value, pa.float64())], names=["q", "id", "similarity"])

    rows = spark.read.parquet(index.path).where(F.col("cell").isin(sorted(asked))).select("id", "v", "cell")
    hits = rows.mapInArrow(score, f"q int, id {id_type}, similarity double")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)
    names = F.broadcast(spark.createDataFrame(list(enumerate(ids)), f"q int, query {id_type}"))
    return ranked.join(names, "q").select("q", "query", "rank", "id", "similarity")


def _empty(spark: SparkSession, id_type: str) -> DataFrame:
    return spark.createDataFrame([], f"query {id_type}, rank int, id {id_type}, similarity double")


def approximate(spark: SparkSession, index: VectorIndex, queries: list[tuple], k: int, n_probe: int, id_type: str = "bigint") -> DataFrame:
    """query, rank, id, similarity: the k best of the n_probe nearest cells of each query (id, vector)."""
    ids, x, angles = _angles(index, queries)
    if not ids:
        return _empty(spark, id_type)
    return _probe(spark, index, ids, x, [np.argsort(a, kind="stable")[:n_probe] for a in angles], k, id_type).drop("q")


def exact(spark: SparkSession, index: VectorIndex, queries: list[tuple], k: int, first: int = 4, id_type: str = "bigint") -> DataFrame:
    """query, rank, id, similarity: the k best of all rows. The first cells give each query a bound; then those whose radius reaches into it are read."""
    ids, x, angles = _angles(index, queries)
    if not ids:
        return _empty(spark, id_type)
    order = np.argsort(angles, axis=1, kind="stable")
    near = _probe(spark, index, ids, x, [o[:first] for o in order], k, id_type)
    kth = {r["q"]: r["s"] for r in near.groupBy("q").agg(F.count("*").alias("n"), F.min("similarity").alias("s")).where(F.col("n") >= k).collect()}  # a row per query
    reach = np.array([math.acos(max(-1.0, min(1.0, kth[q] - 1e-6))) if q in kth else math.pi for q in range(len(ids))])
    probes = [np.flatnonzero((a - index.radii <= r + SLACK) & (index.sizes > 0)) for a, r in zip(angles, reach, strict=True)]
    return _probe(spark, index, ids, x, probes, k, id_type).drop("q")


def calibrate(df: DataFrame, index: VectorIndex, id_col: str, vector_col: str, k: int, recall: float = 0.95) -> int:
    """The least n_probe whose cells hold at least this share of the k nearest of PROBES queries drawn from df, measured against all rows."""
    spark = df.sparkSession
    rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    queries = [(r["id"], r["v"]) for r in rows.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(PROBES).collect()]
    ids, x, angles = _angles(index, queries)
    if not ids:
        return 1
    place = np.argsort(np.argsort(angles, axis=1, kind="stable"), axis=1, kind="stable")  # of each cell in a query's order
    kind = rows.schema["id"].dataType.simpleString()
    truth = exact(spark, index, queries, k + 1, id_type=kind).where("query != id")
    cells = spark.read.parquet(index.path).select("id", "cell").join(F.broadcast(truth.select("id").distinct()), "id")
    row = {i: q for q, i in enumerate(ids)}
    depth = sorted(place[row[r["query"]], r["cell"]] for r in truth.join(cells, "id").select("query", "cell").collect())  # k rows per query
    return int(depth[min(len(depth) - 1, math.ceil(recall * len(depth)) - 1)]) + 1 if depth else 1

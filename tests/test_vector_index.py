"""The inverted file against a search of all rows."""

import numpy as np
import pytest

from tidewire.operators import vector_index


def brute(rows, q, k):
    """Ids and cosines of the k nearest by all rows, six digits, ties to the smaller id."""
    near = [(-round(float(np.dot(q, v) / (np.linalg.norm(q) * np.linalg.norm(v))), 6), i) for i, v in rows]
    return [(i, -s) for s, i in sorted(near)[:k]]


@pytest.fixture(scope="module")
def clustered():
    """Vectors in clusters, a third of them in one and many of these equal; a hundred copies of one."""
    r = np.random.default_rng(5)
    centers = r.normal(size=(12, 16))
    which = np.where(r.random(3000) < 0.33, 0, r.integers(0, 12, 3000))
    x = centers[which] + 0.25 * r.normal(size=(3000, 16))
    x[100:200] = x[100]
    return [(int(i), v.tolist()) for i, v in enumerate(x)]


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    df = spark.createDataFrame(clustered, "id long, v array<double>").repartition(4)
    return df, vector_index.build(df, "id", "v", (tmp_path_factory.mktemp("cells") / "index").as_uri(), cells=24)


def test_exact_search(spark, clustered, index):
    _, made = index
    asked = [(i, clustered[i][1]) for i in range(0, 3000, 150)]
    got = {}
    for r in vector_index.exact(spark, made, asked, 7).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["id"], r["similarity"])
    for i, v in asked:
        want = brute(clustered, v, 7)
        assert sorted(got[i]) == list(range(1, 8))
        for n, (_, s) in enumerate(want, 1):
            assert abs(got[i][n][1] - s) < 2e-6
        if len({s for _, s in want}) == 7:
            assert [got[i][n][0] for n in range(1, 8)] == [j for j, _ in want]
    copies = vector_index.exact(spark, made, [(100, clustered[100][1])], 5).collect()
    assert [r["id"] for r in copies] == [100, 101, 102, 103, 104]


def test_recall_of_probes(spark, clustered, index):
    df, made = index
    n_probe = vector_index.calibrate(df, made, "id", "v", 10, recall=0.95)
    assert 1 <= n_probe < len(made.centroids)
    asked = [(i, clustered[i][1]) for i in range(7, 3000, 60)]
    found = {}
    for r in vector_index.approximate(spark, made, asked, 10, n_probe).collect():
        found.setdefault(r["query"], set()).add(r["similarity"])
    hits = [sum(s in found[i] or s - 1e-6 in found[i] for _, s in brute(clustered, v, 10)) / 10 for i, v in asked]
    assert np.mean(hits) >= 0.9


def test_recall_on_the_given_vectors(spark, small, tmp_path):
    """Vectors without clusters need more of the cells; the measured number of them reaches the recall."""
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    made = vector_index.build(df, "vec_id", "embedding", (tmp_path / "index").as_uri(), cells=12)
    n_probe = vector_index.calibrate(df, made, "vec_id", "embedding", 5)
    asked = rows[::10]
    got = {(r["query"], r["id"]) for r in vector_index.approximate(spark, made, asked, 5, n_probe).collect()}
    assert np.mean([(i, j) in got for i, v in asked for j, _ in brute(rows, v, 5)]) >= 0.9


def test_probes_read_their_cells_alone(spark, clustered, index):
    _, made = index
    assert int(made.sizes.sum()) == 3000
    plan = vector_index.approximate(spark, made, [(0, clustered[0][1])], 5, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell#" in plan and "IN (" in plan


def test_awkward_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [0.0, 0.0]), (8, []), (9, [1.0, 0.1]), (9, [1.0, 0.1]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "id long, v array<double>, cell int, angle int")
    made = vector_index.build(df, "id", "v", (tmp_path / "index").as_uri())
    asked = [(1, [1.0, 0.0]), (2, None), (3, [nan, 0.0]), (4, [0.0, 0.0]), (5, [1.0, 2.0, 3.0])]
    got = [(r["query"], r["rank"], r["id"]) for r in vector_index.exact(spark, made, asked, 9).orderBy("query", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 9), (1, 3, 9), (1, 4, 2)]
    none = vector_index.build(df.where("false"), "id", "v", (tmp_path / "none").as_uri())
    assert vector_index.exact(spark, none, asked, 3).count() == 0 and vector_index.approximate(spark, none, asked, 3, 1).count() == 0
    assert vector_index.calibrate(df.where("false"), none, "id", "v", 3) == 1

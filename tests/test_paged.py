"""Paged sources and batched sinks over SQLite: whole ranges, once each, whatever fails."""

import sqlite3
from contextlib import closing

import pytest

from tidewire.sources import paged
from tidewire.sources.paged import SqliteStore

COLUMNS = {"id": "INTEGER", "text": "TEXT", "score": "REAL"}
SCHEMA = "id long, text string, score double"


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "points.db")
    paged.register(spark, "points", lambda options: SqliteStore(options["path"], "points", "id", COLUMNS), SCHEMA)
    return path


def rows_of(path, table="points"):
    with closing(sqlite3.connect(path)) as db:
        return db.execute(f"SELECT * FROM {table} ORDER BY 1").fetchall()


def test_written_and_read_by_pages(spark, store):
    given = [(i * 3, f"text {i}" if i % 5 else None, i / 2 if i % 7 else None) for i in range(1, 251)]
    df = spark.createDataFrame(given, SCHEMA).repartition(5)
    df.write.format("points").option("path", store).option("page", 7).mode("append").save()
    assert rows_of(store) == given and rows_of(store, "points_staged") == []
    read = spark.read.format("points").option("path", store).option("page", 11).option("splits", 6).load()
    assert read.rdd.getNumPartitions() == 6
    assert sorted(tuple(r) for r in read.collect()) == given
    # an upsert by key: new rows come, old ones change
    spark.createDataFrame([(3, "new", 1.0), (1000, "more", None)], SCHEMA).write.format("points").option("path", store).mode("append").save()
    assert rows_of(store)[0] == (3, "new", 1.0) and len(rows_of(store)) == 251


def test_empty_store_and_write(spark, store):
    assert spark.read.format("points").option("path", store).load().count() == 0
    spark.createDataFrame([], SCHEMA).write.format("points").option("path", store).mode("append").save()
    assert rows_of(store) == []
    with pytest.raises(Exception, match="append"):
        spark.createDataFrame([(1, "a", 1.0)], SCHEMA).write.format("points").option("path", store).mode("overwrite").save()


def test_failed_write_leaves_nothing(spark, store):
    """A task that fails aborts the write; what it staged before goes."""

    class Failing(SqliteStore):
        def stage(self, write, attempt, batch, rows):
            super().stage(write, attempt, batch, rows)
            if any(r[0] == 99 for r in rows):
                raise OSError("lost")

    paged.register(spark, "failing", lambda options: Failing(options["path"], "points", "id", COLUMNS), SCHEMA)
    df = spark.createDataFrame([(i, "x", 0.0) for i in range(100)], SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="lost"):
        df.write.format("failing").option("path", store).option("page", 10).mode("append").save()
    assert rows_of(store) == [] and rows_of(store, "points_staged") == []


def test_only_counted_attempts_are_published(store):
    """An attempt that was run twice, or that Spark doesn't count, adds no row; a batch is published once under its number."""
    s = SqliteStore(store, "points", "id", COLUMNS)
    s.stage("w", "000000-1", 0, [(1, "lost attempt", 0.0), (2, "lost attempt", 0.0)])
    for _ in range(2):
        s.stage("w", "000000-2", 0, [(1, "kept", 1.0)])
    s.publish("w", ["000000-2"])
    assert rows_of(store) == [(1, "kept", 1.0)] and rows_of(store, "points_staged") == []
    for text in ("first", "again"):
        s.stage("stream", "a", 0, [(5, text, None)])
        s.publish("stream", ["a"], 7)
    assert rows_of(store) == [(1, "kept", 1.0), (5, "first", None)]


def test_stream_takes_what_is_new(spark, store, tmp_path):
    out = str(tmp_path / "out.db")
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).write.format("points").option("path", store).mode("append").save()

    def run():
        read = spark.readStream.format("points").option("path", store).load()
        read.writeStream.format("points").option("path", out).option("stream", "copy").option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination(120)

    put([(i, "a", 1.0) for i in range(40)])
    run()
    assert len(rows_of(out)) == 40
    put([(i, "b", 2.0) for i in range(40, 60)])
    run()
    assert [r[1] for r in rows_of(out)] == ["a"] * 40 + ["b"] * 20
    run()
    assert len(rows_of(out)) == 60


def test_ranges():
    for first, last, parts in [(0, 0, 8), (5, 9, 3), (1, 1000, 7)]:
        got = paged.ranges(first, last, parts)
        assert got[0].after == first - 1 and got[-1].until == last
        assert all(a.until == b.after for a, b in zip(got[:-1], got[1:], strict=True))

"""Streams over files, run until nothing is left."""

import datetime as dt

from pyspark.sql import functions as F

from tidewire.sources import readers
from tidewire.streaming import streams


def source(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def run(df, spark, name, mode="complete"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_anchored_windows(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 11), "a"), (dt.datetime(2024, 1, 20), "a"), (dt.datetime(2024, 1, 21), "a")]
    got = run(streams.anchored_counts(source(spark, tmp_path, rows, "ts timestamp, k string"), "ts", 10, "2024-01-11", ["k"]), spark, "w")
    assert sorted((r["window"]["start"].day, r["n"]) for r in got) == [(11, 2), (21, 1)]


def test_first_seen(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1), "a"), (dt.datetime(2024, 1, 1, 1), "a"), (dt.datetime(2024, 1, 1), "b")]
    assert len(run(streams.first_seen(source(spark, tmp_path, rows, "ts timestamp, k string"), "ts", ["k"]), spark, "f", "append")) == 2


def test_incremental_ingest(spark, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for batch in ([("x", 1), ("y", 1)], [("x", 2)]):
        streams.ingest(source(spark, tmp_path, batch, "k string, v int"), streams.upsert_batches(out, "k"), check).awaitTermination(120)
    assert sorted((r["k"], r["v"]) for r in streams.latest_rows(spark.read.parquet(out), "k").collect()) == [("x", 2), ("y", 1)]


def test_cache_hits(spark, tmp_path):
    got = run(streams.cache_hits(source(spark, tmp_path, [("a",), ("a",), ("b",)], "k string"), "k", 3600), spark, "c", "append")
    assert sorted((r["k"], r["n"], r["n_hits"]) for r in got) == [("a", 2, 1), ("b", 1, 0)]


def test_sessions(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h), "a") for h in (0, 1, 9)]
    df = spark.createDataFrame(rows, "ts timestamp, k string")
    assert sorted(r["n"] for r in streams.sessions(df, "ts", "2 hours", "k").collect()) == [1, 2]
    assert streams.sliding_counts(df, "ts", "2 hours", "1 hour", ["k"]).agg(F.sum("n")).first()[0] == 6


def test_landed_files_and_progress(spark, tmp_path):
    seen = []
    listener = streams.Progress(seen.append)
    spark.streams.addListener(listener)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "in/b.txt").write_bytes(b"x")
    got = []
    for _ in range(2):  # the second run finds nothing new
        q = streams.ingest(readers.landed(spark, str(tmp_path / "in")).select("length"), lambda batch, i: got.extend(r["length"] for r in batch.collect()), str(tmp_path / "ck"))
        q.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(listener)
    assert got == [6]
    assert {"started", "processing", "done"} <= {x["status"] for x in seen} and sum(x["rows"] for x in seen) == 1

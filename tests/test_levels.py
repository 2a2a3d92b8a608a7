"""The two-level cache over a stream of batches."""

import datetime as dt

from tidewire.streaming import levels

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def at(hours):
    return START + dt.timedelta(hours=hours)


def test_levels_over_batches(spark, tmp_path):
    schema = "k string, ts timestamp"
    batches = [
        [("a", at(0)), ("a", at(0.5)), ("b", at(0)), ("a", at(1)), (None, at(0))],
        [("a", at(30)), ("a", at(2)), ("b", at(24 * 7)), (None, at(0.25))],
        [("a", at(24 * 7 + 1)), ("b", at(24 * 7 + 1)), ("b", at(24 * 7 + 1.5)), ("c", None)],
        [("d", at(24 * 30))],
        [("d", at(24 * 31)), ("a", at(24 * 30))],
    ]
    want = {("a", 0): "miss", ("a", 0.5): "memory", ("b", 0): "miss", ("a", 1): "memory", (None, 0): "miss", ("a", 30): "disk", ("a", 2): "disk", ("b", 168): "disk", (None, 0.25): "memory"}
    want |= {("a", 169): "miss", ("b", 169): "miss", ("b", 169.5): "memory", ("d", 720): "miss", ("d", 744): "disk", ("a", 720): "miss"}
    got = {}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = levels.two_level_cache(stream, "k", "ts", lateness="8 days")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    state = q.lastProgress
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        hours = (r["ms"] / 1000 - START.timestamp()) / 3600
        got[r["k"], round(hours, 3)] = r["level"]
    assert got == want
    # entries of the first week are gone from the state: a's and d's last ones are left
    assert state is None or sum(s["numRowsTotal"] for s in state["stateOperators"]) <= 8

"""Streams: tumbling windows from an anchor, running dedup, incremental ingestion, state with a time to live."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How late a row may come; the batch rules have no notion of it.
LATENESS = "1 day"


def anchored_counts(events: DataFrame, time: str, days: int, anchor: str, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """Rows per window of so many days counted from anchor (an ISO date), and keys."""
    # window() counts from the epoch; startTime moves it to the anchor
    offset = f"{days_since_epoch(anchor) % days} days"
    w = F.window(F.col(time), f"{days} days", f"{days} days", offset)
    return events.withWatermark(time, lateness).groupBy(w.alias("window"), *keys).agg(F.count("*").alias("n"))


def days_since_epoch(day: str) -> int:
    return (pd.Timestamp(day) - pd.Timestamp("1970-01-01")).days


def sliding_counts(events: DataFrame, time: str, length: str, step: str, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    return events.withWatermark(time, lateness).groupBy(F.window(time, length, step), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, gap: str, key: str, lateness: str = LATENESS) -> DataFrame:
    """Rows per key and session, a session ending with a gap."""
    return events.withWatermark(time, lateness).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, time: str, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """Rows whose keys haven't come within the lateness; state is dropped with the watermark."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def ingest(source: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs write(batch, id) on what is new in source; the checkpoint remembers what has been taken, so a restart repeats the
    last batch under its old id at most, which an idempotent write absorbs."""
    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def upsert_batches(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A write for ingest(): each batch appended once under its id; read with latest_rows()."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest_rows(df: DataFrame, key: str) -> DataFrame:
    """Of batches written by upsert_batches the newest row of each key."""
    fields = F.struct(*[c for c in df.columns if c not in (key, "batch")])
    newest = df.groupBy(key).agg(F.max_by(fields, F.col("_batch")).alias("_r"))
    return newest.select(key, "_r.*").drop("_batch")


def cache_hits(requests: DataFrame, key: str, ttl_seconds: int) -> DataFrame:
    """key, n, n_hits per batch and key: a request is a hit if its key came within the time to live before; state ends with it."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = sum(len(p) for p in parts)
        hits = n if state.exists else n - 1
        state.update((n,))
        state.setTimeoutDuration(ttl_seconds * 1000)
        yield pd.DataFrame({key: [k[0]], "n": [n], "n_hits": [hits]})

    kind = requests.schema[key].dataType.simpleString()
    return requests.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, n_hits long", "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def frames(batch_column: Column) -> Column:
    """A row's JSON frame."""
    return F.to_json(batch_column)


class Progress(StreamingQueryListener):
    """Tells report(event) how the session's streams go: a dict with query, batch, rows and status ('started', 'processing', 'done', 'failed').

    The driver's own thread runs it, so a report should be short: a line to a socket or writers.write_progress().
    """

    def __init__(self, report: Callable[[dict], None]):
        self.report = report

    def onQueryStarted(self, event) -> None:
        self.report({"query": event.name or str(event.id), "batch": -1, "rows": 0, "status": "started"})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.report({"query": p.name or str(p.id), "batch": p.batchId, "rows": p.numInputRows, "status": "processing"})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report({"query": str(event.id), "batch": -1, "rows": 0, "status": "failed" if event.exception else "done"})

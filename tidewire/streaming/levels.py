"""A cache of two levels as the state of a stream: entries live in memory for a short time, on disk for a long one, and are evicted after it.

The first request for a key is a miss and stamps its entry; later ones find it in memory while it is younger than the memory's time to live,
on disk while it is younger than the disk's, and miss again, with a new stamp, when it is older. An entry found on disk keeps its stamp. Time
is that of the requests, so results don't depend on when batches run; a timer at the end of the disk's time to live evicts the entry once
the watermark has passed it, so state holds the keys of that time alone. It lies in RocksDB, beyond the executors' heap.

Cases: requests of a batch are taken in order of time, whatever their order of arrival; one that comes behind the watermark is
dropped by Spark; one older than its entry's stamp finds it in memory; a null key is a key, a request without a time is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: How long entries live, in seconds.
MEMORY_SECONDS, DISK_SECONDS = 3600, 7 * 24 * 3600


class TwoLevels(StatefulProcessor):
    """One state a key: when its entry was stamped, in milliseconds."""

    def __init__(self, key: str, memory: int, disk: int):
        self.key, self.memory, self.disk = key, memory * 1000, disk * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stamp = handle.getValueState("stamp", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t for part in rows for t in part["requested_ms"].tolist())
        stamp = self.stamp.get()[0] if self.stamp.exists() else None
        first, found = stamp, []
        for t in times:
            age = None if stamp is None else t - stamp
            level = "miss" if age is None or age > self.disk else "memory" if age <= self.memory else "disk"
            if level == "miss":
                stamp = t
            found.append(level)
        if stamp != first:
            self.stamp.update((stamp,))
            self.handle.registerTimer(stamp + self.disk + 1)
        yield pd.DataFrame({self.key: [key[0]] * len(times), "ms": times, "level": found})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a later stamp has a timer of its own
        if self.stamp.exists() and self.stamp.get()[0] + self.disk < expiredTimerInfo.getExpiryTimeInMs():
            self.stamp.clear()
        yield pd.DataFrame({self.key: pd.Series(dtype="object"), "ms": pd.Series(dtype="int64"), "level": pd.Series(dtype="object")})

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def two_level_cache(requests: DataFrame, key: str, time: str, memory: int = MEMORY_SECONDS, disk: int = DISK_SECONDS, lateness: str = "1 day") -> DataFrame:
    """key, ms (of the request), level ('memory', 'disk' or 'miss') for each request of a stream."""
    use_rocksdb(requests.sparkSession)
    stamped = requests.where(F.col(time).isNotNull()).withWatermark(time, lateness).withColumn("requested_ms", F.unix_millis(F.col(time)))
    kind = requests.schema[key].dataType.simpleString()
    return stamped.groupBy(key).transformWithStateInPandas(TwoLevels(key, memory, disk), f"{key} {kind}, ms bigint, level string", "Append", "EventTime")

"""Keyed tables: upsert, insert-ignore, back-fill, histories, TTL caches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """target with source's rows in place of those of the same key; of source rows with one key the last by order.

    Rows without a key are appended. Columns that only one side has are null on the other.
    """
    if order:
        w = Window.partitionBy(key).orderBy(F.desc(order))
        source = source.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn").eqNullSafe(1) | F.col(key).isNull()).drop("_rn")
    return target.join(source.select(key).distinct(), key, "left_anti").unionByName(source, allowMissingColumns=True)


def insert_ignore(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """target and those rows of source, one per key, whose key it lacks."""
    w = Window.partitionBy(key).orderBy(*[F.col(c) for c in source.columns if c != key])
    fresh = source.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return target.unionByName(fresh.join(target.select(key), key, "left_anti"), allowMissingColumns=True)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """df written to a new version below path; the version's path. Readers of older versions aren't disturbed, and a failed write leaves none."""
    at = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(at)
    return at


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replaces just the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def backfill(df: DataFrame, name: str, value: Column) -> DataFrame:
    """name where it is missing set to value; the column is added if there is none."""
    return df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)


def unprocessed(links: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """links that the history lacks; links without a key count as new."""
    return links.join(history.select(key).distinct(), key, "left_anti")


def selected(links: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return links.join(keys.select(key).distinct(), key, "left_semi")


def extend_history(history: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """The set union, with is_new for keys that come from links alone."""
    both = history.select(key, F.lit(False).alias("is_new")).unionByName(links.select(key, F.lit(True).alias("is_new"))).where(F.col(key).isNotNull())
    return both.groupBy(key).agg(F.every("is_new").alias("is_new"))


def cache_put(cache: DataFrame, entries: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """cache with entries (key, content, optionally expiry_seconds) stamped now."""
    own = F.col("expiry_seconds") if "expiry_seconds" in entries.columns else F.lit(None).cast("long")
    stamped = entries.select("key", "content", now.cast("timestamp").alias("stored_at"), F.coalesce(own, F.lit(ttl_seconds)).cast("long").alias("expiry_seconds"))
    return upsert(cache, stamped, "key")


def cache_fresh(cache: DataFrame, now: Column) -> DataFrame:
    """Entries that haven't expired, to the microsecond."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("stored_at").cast("timestamp"))
    # a whole number of seconds is over the age if it is over its whole seconds; micros of the expiry could overflow
    return cache.where(F.floor(age / 1_000_000) < F.col("expiry_seconds"))


def with_cached(df: DataFrame, key: Column, cache: DataFrame, now: Column, column: str) -> DataFrame:
    """df plus column from fresh cache entries, null on a miss."""
    fresh = cache_fresh(cache, now).select(F.col("key").alias("_k"), F.col("content").alias(column))
    return df.withColumn("_k", key).join(fresh, "_k", "left").drop("_k")


def empty_cache(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "key string, content string, stored_at timestamp, expiry_seconds long")


def embed_once(df: DataFrame, text_col: str, embed, column: str = "embedding") -> DataFrame:
    """df plus embed(text), computed once per different text (embed: pandas UDF from texts to vectors) and joined back."""
    distinct = df.where(F.col(text_col).isNotNull()).select(text_col).distinct()
    return df.join(distinct.withColumn(column, embed(F.col(text_col))), text_col, "left")

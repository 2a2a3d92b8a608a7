"""Rules about downloaded media: names, sizes, errors and how long they are remembered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .urls import path

#: Extension by MIME subtype.
MIME_EXTENSIONS = {"jpeg": ".jpg", "jpg": ".jpg", "png": ".png", "gif": ".gif", "bmp": ".bmp", "webp": ".webp", "tiff": ".tiff", "svg+xml": ".svg", "mpeg": ".mp3", "mp3": ".mp3", "ogg": ".ogg", "wav": ".wav", "x-wav": ".wav", "x-m4a": ".m4a", "mp4": ".mp4"}
#: Parts of error messages that mean an image can never be read.
TOO_HEAVY = ["timeout", "too large", "too big", "size limit", "demasiado grande", "demasiado pesada", "limits exceeded", "memory", "memoria", "out of", "unable to process", "quota", "rate limit", "rate-limit"]
PERMANENT_SECONDS, ERROR_SECONDS = 315_360_000, 3600
MAX_BYTES, MAX_PIXELS, MAX_SIDE = 10 << 20, 8_000_000, 2500


def media_extension(content_type: Column, url: Column) -> Column:
    """By the URL's extension, else by MIME type, else .jpg."""
    by_url = F.regexp_extract(F.lower(path(url)), r"(\.(?:jpg|jpeg|png|gif|bmp|webp|svg|tiff|mp3|wav|ogg|m4a|mp4))$", 1)
    mime = F.create_map(*[x for k, v in MIME_EXTENSIONS.items() for x in (F.lit(k), F.lit(v))])
    by_type = F.try_element_at(mime, F.element_at(F.split(F.coalesce(content_type, F.lit("")), "/"), -1))
    return F.when(by_url == ".jpeg", ".jpg").when(by_url != "", by_url).otherwise(F.coalesce(by_type, F.lit(".jpg")))


def media_name(index: Column, url: Column, day: Column, extension: Column) -> Column:
    return F.concat(F.lit("img_"), index.cast("string"), F.lit("_"), F.left(F.md5(F.coalesce(url, F.lit(""))), F.lit(8)), F.lit("_"), day, extension)


def error_ttl(message: Column, default: int) -> Column:
    """Seconds for which a result is kept: ten years if it can never succeed, an hour after another error, else default."""
    low, heavy = F.lower(F.coalesce(message, F.lit(""))), F.lit(False)
    for part in TOO_HEAVY:
        heavy = heavy | low.contains(part)
    return F.when(low == "", F.lit(default)).when(heavy, F.lit(PERMANENT_SECONDS)).otherwise(F.lit(ERROR_SECONDS))


def is_permanent(message: Column) -> Column:
    return error_ttl(message, 0) == PERMANENT_SECONDS


def is_readable(kind: Column, size: Column) -> Column:
    """An image of a known kind that isn't too large."""
    return kind.startswith("image/") & (size > 0) & (size <= MAX_BYTES)


def fitted(width: Column, height: Column) -> Column:
    """struct<width, height>: as it is up to MAX_PIXELS, else with a longer side of at most MAX_SIDE."""
    wide = F.least(F.lit(MAX_SIDE), width)
    high = F.least(F.lit(MAX_SIDE), height)
    scaled = F.when(width > height, F.struct(wide.cast("int").alias("width"), F.floor(wide * height / width).cast("int").alias("height"))).otherwise(F.struct(F.floor(high * width / height).cast("int").alias("width"), high.cast("int").alias("height")))
    return F.when(width.cast("long") * height <= MAX_PIXELS, F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))).otherwise(scaled)


def within_area(width: Column, height: Column, most: int = 25_000_000) -> Column:
    """struct<width, height>: scaled down to an area of at most `most` pixels."""
    ratio = F.least(F.lit(1.0), F.sqrt(F.lit(float(most)) / (width.cast("double") * height)))
    return F.struct(F.floor(width * ratio).cast("int").alias("width"), F.floor(height * ratio).cast("int").alias("height"))


def bounded_settings(batch: int, pause: int) -> tuple[int, int]:
    return max(1, min(batch, 5)), max(10, min(pause, 300))


def backoff_seconds(attempt: Column) -> Column:
    return F.pow(F.lit(2), attempt).cast("long")


def prompt_for(key: Column, prompts: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in prompts.items() for x in (F.lit(k), F.lit(v))]), key), F.lit(default))


def numbered_in_batch(df: DataFrame, batch: str, order: list[Column]) -> DataFrame:
    """df plus image_index: the place in its batch, from 1."""
    return df.withColumn("image_index", F.row_number().over(Window.partitionBy(batch).orderBy(*order)))


def only_errors(df: DataFrame, error: Column) -> DataFrame:
    """One row: only_errors (all rows have an error; true without rows), any_error, n."""
    bad = F.coalesce(error, F.lit("")) != ""
    return df.agg(F.coalesce(F.every(bad), F.lit(True)).alias("only_errors"), F.coalesce(F.some(bad), F.lit(False)).alias("any_error"), F.count("*").alias("n"))

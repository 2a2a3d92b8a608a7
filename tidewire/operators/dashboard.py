"""Roll-ups of runs, links and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.dates import from_ddmmyyyy, local_time


def average(total: Column, n: Column, digits: int = 2) -> Column:
    """total / n rounded, n counted as 1 if there is none."""
    return F.round(F.coalesce(total, F.lit(0.0)) / F.greatest(n, F.lit(1)), digits)


def totals(df: DataFrame, sums: list[str], averages: list[str], stamp: str | None = None) -> DataFrame:
    """One row: n, a total_ per column of sums, an avg_ per column of averages, and the last time of stamp in local time."""
    aggs = [F.count("*").alias("n")] + [F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in sums] + [average(F.sum(F.coalesce(F.col(c), F.lit(0.0))), F.count("*")).alias(f"avg_{c}") for c in averages]
    if stamp:
        aggs.append(local_time(F.max(stamp)).alias("last_run"))
    return df.agg(*aggs)


def date_bounds(df: DataFrame, day_text: Column) -> DataFrame:
    """first, last of the valid days."""
    d = from_ddmmyyyy(day_text)
    return df.agg(F.min(d).alias("first"), F.max(d).alias("last"))


def by_two_levels(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """category, subcategory, n with the sums of each level."""
    return df.select(a.alias("category"), b.alias("subcategory")).rollup("category", "subcategory").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def count_by(df: DataFrame, key: Column, name: str, least: int = 0) -> DataFrame:
    """name, n in falling order, those of more than least rows."""
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n")).where(F.col("n") > least).orderBy(F.desc("n"), name)


def success_ratios(df: DataFrame, key: str, ok: Column) -> DataFrame:
    """Per key: n, n_ok, ratio, whether all and whether any failed."""
    ok = F.coalesce(ok, F.lit(False))
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.round(F.avg(ok.cast("int")), 6).alias("ratio"), F.every(~ok).alias("only_errors"), F.some(~ok).alias("any_error"))


def run_stats(df: DataFrame, ok: Column, relevance: Column, threshold: float = 0.3) -> DataFrame:
    """processed, successful, relevant (at threshold or over), average_relevance (0 without rows)."""
    return df.agg(F.count("*").alias("processed"), F.count_if(ok).alias("successful"), F.count_if(relevance >= threshold).alias("relevant"), F.round(F.coalesce(F.avg(relevance), F.lit(0.0)), 6).alias("average_relevance"))


def reduction(total: Column, groups: Column) -> Column:
    """Percentage of rows that grouping saves; 0 without rows."""
    return F.when(total > 0, F.round((total - groups) / total * 100, 2)).otherwise(F.lit(0.0))

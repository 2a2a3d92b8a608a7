"""Top-k retrieval: by vector, by keyword, hybrid, per day window; and what answers are made of.

Every ranking has a total order (score, then id), so results don't depend on partitioning. A single query is a literal or one broadcast row; top-k
is TakeOrderedAndProject (k rows per partition reach the driver side of the exchange), per group a window that Spark limits
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.dates import per_window, window_index
from tidewire.functions.similarity import cosine


def metadata_filter(df: DataFrame, **equal) -> DataFrame:
    """Conjunction of equalities; values that are None or '' don't filter."""
    for name, value in equal.items():
        if value not in (None, ""):
            df = df.where(F.col(name).isin(value) if isinstance(value, list | tuple) else F.col(name) == value)
    return df


def vector_top_k(df: DataFrame, query: list[float] | Column, k: int, id_col: str = "id", vector_col: str = "embedding", min_similarity: float | None = None) -> DataFrame:
    """df's k rows nearest to query by cosine, with similarity."""
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    out = df.withColumn("similarity", F.round(cosine(F.col(vector_col), q), 6)).where(F.col("similarity").isNotNull())
    if min_similarity is not None:
        out = out.where(F.col("similarity") > min_similarity)
    return out.orderBy(F.desc("similarity"), id_col).limit(k)


def best_reference(df: DataFrame, vector_col: str, references: dict[str, list[float]], floor: float = 0.8) -> DataFrame:
    """df plus best (name of the nearest reference vector, null under floor) and similarity. References are a handful of literals."""
    scored = F.array(*[F.struct(F.coalesce(F.round(cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in v])), 6), F.lit(-2.0)).alias("s"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, v) in enumerate(references.items())])
    out = df.withColumn("_b", F.array_max(scored))
    return out.withColumns({"similarity": F.col("_b.s"), "best": F.when(F.col("_b.s") >= floor, F.col("_b.n"))}).drop("_b")


def terms(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _equal_to(value: str) -> Callable[[Column], Column]:
    return lambda x: x == value


def keyword_rank(t: Column, query: list[str]) -> Column:
    """Of a text's terms: the sum over the query's terms of ln(1 + tf) / ln(2 + number of terms); null unless all occur."""
    total, every = F.lit(0.0), F.lit(True)
    for q in query:
        tf = F.size(F.filter(t, _equal_to(q)))
        total, every = total + F.log(1.0 + tf), every & (tf > 0)
    return F.when(every, total / F.log(2.0 + F.size(t)))


def keyword_top_k(df: DataFrame, query: list[str], k: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """df's k best rows by keyword_rank, with rank_score. The terms are searched as substrings first, which is cheap."""
    low = F.lower(F.col(text_col))
    for q in query:
        df = df.where(low.contains(q))
    ranked = df.withColumn("_t", terms(F.col(text_col))).withColumn("rank_score", F.round(keyword_rank(F.col("_t"), query), 6)).drop("_t")
    return ranked.where(F.col("rank_score").isNotNull()).orderBy(F.desc("rank_score"), id_col).limit(k)


def hybrid(vector: DataFrame, keyword: DataFrame, id_col: str, k: int, vector_weight: float = 0.6, keyword_weight: float = 0.4) -> DataFrame:
    """id, vector_score, keyword_score, score: both rankings scaled to a best of 1 and mixed; a missing side counts 0."""
    if vector_weight + keyword_weight <= 0:
        raise ValueError("weights must have a positive sum")
    total = vector_weight + keyword_weight

    def scaled(df: DataFrame, name: str) -> DataFrame:
        # both sides are top-k results; the maximum is a broadcast row
        best = df.agg(F.max(name).alias("_m"))
        return df.join(F.broadcast(best)).select(id_col, F.when(F.coalesce("_m", F.lit(0.0)) != 0, F.col(name) / F.col("_m")).otherwise(F.col(name)).alias(name))

    v, w = scaled(vector.select(id_col, F.col("similarity").alias("vector_score")), "vector_score"), scaled(keyword.select(id_col, F.col("rank_score").alias("keyword_score")), "keyword_score")
    both = v.join(w, id_col, "full").select(id_col, F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"))
    mixed = F.col("vector_score") * (vector_weight / total) + F.col("keyword_score") * (keyword_weight / total)
    return both.withColumn("score", F.round(mixed, 6)).orderBy(F.desc("score"), id_col).limit(k)


def windowed_top_k(df: DataFrame, day_col: str, first: Column, last: Column, k_total: int, n_days: int, score: Column, id_col: str, days: int = 10, stop_at: int | None = None) -> DataFrame:
    """window_idx, rank and df's columns: of each window of so many days from first the best rows, an id only in its first window.

    stop_at ends the run with the window in which so many rows have been found.
    """
    k = per_window(k_total, n_days, days)
    inside = df.where(F.col(day_col).between(first, last)).withColumn("window_idx", window_index(F.col(day_col), first, days))
    best = inside.withColumn("rank", F.row_number().over(Window.partitionBy("window_idx").orderBy(score.desc(), F.col(id_col)))).where(F.col("rank") <= k)
    fresh = best.withColumn("_rn", F.row_number().over(Window.partitionBy(id_col).orderBy("window_idx", "rank"))).where("_rn = 1").drop("_rn")
    if stop_at is None:
        return fresh
    # a row per window; the running sum is over windows, not rows
    counts = fresh.groupBy("window_idx").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("window_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return fresh.join(F.broadcast(counts.withColumn("_b", before).where(F.col("_b") < stop_at).select("window_idx")), "window_idx")


def balanced(df: DataFrame, day_col: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of the days in turn, most in all: a top-k by (day, order)."""
    return df.orderBy(day_col, *order).limit(most)


def per_day(df: DataFrame, day_col: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each day, with rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(day_col).orderBy(*order))).where(F.col("rank") <= most)


def blocks(df: DataFrame, order: list[Column], size: int = 3) -> DataFrame:
    """df, the rows of one answer, plus block (from 1) and n_blocks: parts of size rows in order."""
    n = F.row_number().over(Window.orderBy(*order))
    total = F.count("*").over(Window.partitionBy())
    return df.withColumns({"block": (F.floor((n - 1) / size) + 1).cast("int"), "n_blocks": F.ceil(total / size).cast("int")})


def context_line(day: Column, source: Column, section: Column, text: Column) -> Column:
    return F.format_string("[fecha: %s] [fuente: %s] [sección: %s]\n%s", *[F.coalesce(c.cast("string"), F.lit("")) for c in (day, source, section, text)])


def digest(df: DataFrame, day_col: str, text_col: str, source_col: str, section_col: str, order: list[Column], most: int = 3, shortest: int = 30, cut: int = 300) -> DataFrame:
    """day, n_events, digest: per day the first texts of over `shortest` characters, each cut, in lines."""
    t = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    rows = per_day(df.where(F.char_length(t) > shortest), day_col, order, most)
    line = F.concat(F.lit("- [fuente: "), F.coalesce(F.col(source_col), F.lit("")), F.lit("] [sección: "), F.coalesce(F.col(section_col), F.lit("")), F.lit("] "), F.trim(F.regexp_replace(F.left(t, F.lit(cut)), "\n", " ")), F.lit("..."))
    grouped = rows.groupBy(F.col(day_col).alias("day")).agg(F.count("*").alias("n_events"), F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("ls"))
    head = F.concat(F.lit("[fecha: "), F.col("day").cast("string"), F.lit("] ("), F.col("n_events").cast("string"), F.lit(" eventos)\n"))
    return grouped.select("day", "n_events", F.concat(head, F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("digest"))

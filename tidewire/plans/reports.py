"""Composite reports: a day's run, the dashboard, answers to questions, link reports, topics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import questions, similarity, stemming, urls
from tidewire.functions.dates import from_ddmmyyyy, question_date
from tidewire.functions.text import ascii_terms, normalize_for_topics, whitespace_lower
from tidewire.operators import dashboard, dedup, fitted, joins, retrieval, upsert
from tidewire.sources import writers

from . import ingest

#: Thresholds of the semantic clean, two posts and any other pair.
POSTS, OTHERS = 0.85, 0.7
#: Fixed values of the grouping by topics: threshold of any pair, and relevance from which a page takes part.
TOPICS, RELEVANT = 0.65, 0.3
#: Characters of context from which an answer works with the day digest instead.
DIGEST_FROM = 8000
#: Rows of a retrieval, and of the balanced choice for an answer.
RECALL, BALANCED = 50, 21


def nearest_day(points: DataFrame, day_number: str, day: str, first: Column, last: Column) -> DataFrame:
    """Points between two days by their number, or by their text where they have none: one filter in place of a second try."""
    number = F.coalesce(F.col(day_number), F.date_format(from_ddmmyyyy(F.col(day)), "yyyyMMdd").cast("int"))
    return points.where(number.between(F.date_format(first, "yyyyMMdd").cast("int"), F.date_format(last, "yyyyMMdd").cast("int")))


def stemmed_terms(text: Column) -> Column:
    """The stems of a text's lower-case words, without ASCII punctuation and stop words."""
    return stemming.stems(ascii_terms(text, []))


def semantic_groups(texts: DataFrame, order: str = "ord", posts: float = POSTS, others: float = OTHERS, terms: Callable[[Column], Column] = stemmed_terms) -> DataFrame:
    """ord, component of texts (ord, source, text) that say the same: each text joins the first one before it, in order, that opened a
    group and is similar to it, or opens one itself; component is the ord of the one that opened it.

    Similarity is the TF-IDF cosine fitted to the two texts alone, see operators.fitted; two posts need posts, other pairs others.
    Texts without terms are similar to each other. order is of whole numbers.
    terms: what of a text is compared, by default the stems of its words without punctuation and stop words.
    """
    post = F.coalesce("source", F.lit("")) == "facebook"
    return fitted.leaders_in_order(texts, order, post, terms(F.col("text")), posts, others).select("ord", F.col("leader").alias("component"))


@dataclass
class Day:
    """What a day's run gives."""

    links: DataFrame
    categories: DataFrame
    texts: DataFrame
    documents: DataFrame
    stats: DataFrame
    markdown: DataFrame


def run_day(docs: DataFrame, links: DataFrame, history: DataFrame) -> Day:
    """New links by class, texts without near duplicates, clean documents, figures, report: one lazy plan from scans to outputs.

    docs as read_documents() gives them, links with URL, history with URL.
    """
    fresh = dedup.keep_first(upsert.unprocessed(links, history, "URL"), [F.col("URL")], [F.col("Page")])
    kinds = urls.classify_two_level(F.col("URL"))
    fresh = fresh.withColumns({"category": kinds["category"], "subcategory": kinds["subcategory"]})
    # a row's id is the hash of what it says and where, so no global order is needed; rows equal in all of it are one
    place = ["file", "source", "source_key", "page"]
    texts = ingest.texts_of(docs).withColumn("ord", F.xxhash64(*place, "text")).dropDuplicates(["ord"])
    grouped = texts.join(semantic_groups(texts), "ord")
    reps = dedup.representatives(grouped, [F.col("component")], F.col("relevance_score"), F.col("text"), [F.col(x) for x in [*place, "ord"]])
    figures = texts.agg(F.count("*").alias("original_texts")).join(reps.agg(F.count("*").alias("representative_texts")))
    figures = figures.withColumn("reduction_percentage", dashboard.reduction(F.col("original_texts"), F.col("representative_texts")))
    return Day(fresh, dashboard.by_two_levels(fresh, F.col("category"), F.col("subcategory")), reps, ingest.only_representatives(docs, reps), figures, writers.markdown_report(writers.markdown_sections(reps.withColumn("pos", F.struct(*place, "ord")), "pos")))


def dashboard_parts(points: DataFrame, stats: DataFrame) -> dict[str, DataFrame]:
    """supervision, events, news, pages (first chunks, the first of each key) and totals."""
    first = points.where("chunk_index = 0")
    order = [F.col("date_day"), F.col("id")]
    shown = F.when(F.lower("section").endswith(".jpg"), "No se encontró título").otherwise(F.col("section"))
    page = F.coalesce(F.nullif("page", F.lit(0)), F.lit(1))
    pick = lambda df, *keys: dedup.keep_first(df, [F.col(k) for k in keys], order)
    sums = ["total_urls", "html_processed", "html_successful", "image_attempted", "image_downloaded", "facebook_extracted", "semantic_chunks"]
    times = ["time_pdf_extraction", "time_text_extraction_pdf", "time_image_download", "time_image_api", "time_html_scraping", "time_facebook_processing"]
    stamped = stats.withColumn("run_at", F.try_to_timestamp(F.nullif("run_timestamp", F.lit(""))))
    return {
        "supervision": pick(first.where("event_type = 'supervision'"), "section", "event_type").select(shown.alias("title"), F.col("text").alias("summary"), "event_type", page.alias("page")),
        "events": first.where(F.col("event_type").isin("interrupcion", "denuncia")).select(F.col("section").alias("title"), F.col("text").alias("summary"), page.alias("page"), "event_type"),
        "news": pick(first.where("source_type = 'pdf_paragraph'"), "section", "page").select(F.col("section").alias("title"), F.col("text").alias("summary"), F.coalesce("page", F.lit(0)).alias("page")),
        "pages": pick(first.where("source_type = 'html'"), "url").select("url", F.col("section").alias("title"), F.col("text").alias("summary")),
        "totals": dashboard.totals(stamped, sums, times, "run_at"),
    }


def context_for(spark: SparkSession, points: DataFrame, question: str, vector: list[float], k: int = RECALL) -> DataFrame:
    """The points that answer a question: of the day, month or range that it names and of its event class, the nearest to vector.

    A range is read in windows of ten days, each with its share of rows; equal texts count once. points: id, text, date_day,
    event_type, embedding and payload. Adds similarity, rank and context (the line shown to the answerer).
    """
    asked = spark.createDataFrame([(question,)], "q string").select(question_date(F.col("q")).alias("d"), questions.event_class(F.col("q")).alias("e")).first()
    rows = points.withColumn("day", from_ddmmyyyy(F.col("date_day")))
    if asked["e"]:
        rows = rows.where(F.col("event_type") == asked["e"])
    scored = rows.withColumn("similarity", F.round(similarity.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])), 6)).where(F.col("similarity").isNotNull())
    d = asked["d"]
    if d and d["tipo"] == "rango":
        first, last = (F.to_date(F.lit(x), "ddMMyyyy") for x in (d["inicio"], d["fin"]))
        days = spark.range(1).select(F.datediff(last, first) + 1).first()[0]
        best = retrieval.windowed_top_k(scored, "day", first, last, k, max(1, days), F.col("similarity"), "id").drop("rank")
    else:
        if d and d["tipo"] == "exacta":
            scored = scored.where(F.col("date_day") == d["valor"])
        elif d and d["tipo"] == "mes":
            scored = scored.where(F.substring("date_day", 3, 6) == d["valor"])
        best = scored.orderBy(F.desc("similarity"), "id").limit(k)
    once = dedup.exact_dedup(best, "text", [F.desc("similarity"), F.col("id")])
    line = retrieval.context_line(F.col("date_day"), F.col("source_type"), F.col("section"), F.col("text"))
    # at most k rows a window are left here
    return once.withColumns({"rank": F.row_number().over(Window.orderBy(F.desc("similarity"), "id")), "context": line})


def answer_parts(context: DataFrame, most: int = BALANCED, size: int = 3) -> DataFrame:
    """context's rows in the parts of an answer: days in turn up to most, blocks of size."""
    return retrieval.blocks(retrieval.balanced(context, "day", [F.col("rank")], most), [F.col("day"), F.col("rank")], size)


def count_answer(context: DataFrame, question: str) -> DataFrame:
    """One row: event, n, plural, examples (the first five texts, 200 characters each)."""
    event = questions.event_class(F.lit(question))
    hit = event.isNotNull()
    for name, keys in questions.EVENTS.items():
        found = F.lit(False)
        for key in keys:
            found = found | F.lower("text").contains(key)
        hit = hit & F.when(event == name, found).otherwise(F.lit(True))
    rows = context.where(hit)
    # the first five alone are gathered: a top-k, whatever the number of rows
    shown = rows.orderBy("rank").limit(5).select(F.struct("rank", F.concat(F.trim(F.left("text", F.lit(200))), F.lit("...")).alias("t")).alias("s"))
    examples = shown.agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]).alias("examples"))
    return rows.agg(event.alias("event"), F.count("*").alias("n"), questions.plural(event).alias("plural")).join(F.broadcast(examples))


class LinkReport:
    """The duplicate report of a list: classified (links with class), categories (counts), labels (leader of each link in its class), stats.

    Parts are made as they are asked for: counting classes compares no texts. By name as attributes or as items.
    """

    def __init__(self, classified: DataFrame, text: str, order: str, thresholds: dict | float):
        self.classified, self._by = classified, (text, order, thresholds)

    @cached_property
    def categories(self) -> DataFrame:
        return dashboard.count_by(self.classified, F.col("category"), "category")

    @cached_property
    def labels(self) -> DataFrame:
        text, order, thresholds = self._by
        return dedup.leader_cluster(self.classified.withColumn("_t", whitespace_lower(F.col(text))), "category", order, "_t", thresholds)

    @cached_property
    def stats(self) -> DataFrame:
        return dedup.cluster_stats(self.labels)

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)


def link_report(links: DataFrame, url: str, text: str, order: str, thresholds: dict | float = 0.85) -> LinkReport:
    """The duplicate report of links: text compared within the class of url, in order."""
    return LinkReport(links.withColumn("category", urls.classify_one_level(F.col(url))), text, order, thresholds)


def preselected(urls_df: DataFrame, history: DataFrame, url: str = "url") -> DataFrame:
    """urls_df with preselected: whether the history has no text of it yet."""
    known = history.where(F.coalesce(F.col("text"), F.lit("")) != "").select(F.col(url)).distinct().withColumn("_k", F.lit(True))
    return urls_df.join(known, url, "left").withColumn("preselected", F.col("_k").isNull()).drop("_k")


def pair_decision(a: dict[str, Column], b: dict[str, Column], threshold: Column) -> Column:
    """struct<similar, similarity, reason> of two links by host, success, text and title columns."""
    base = lambda h: urls.base_domain(h)
    social = F.lit(False)
    for host in ("facebook.com", "twitter.com", "x.com", "youtube.com", "t.co"):
        social = social | a["host"].contains(host) | b["host"].contains(host)
    foreign = (a["host"] != b["host"]) & ~social & a["host"].contains(".") & b["host"].contains(".") & (base(a["host"]) != base(b["host"]))
    body = lambda x: F.coalesce(F.nullif(x["text"], F.lit("")), x["title"], F.lit(""))
    s = similarity.block_ratio(F.lower(body(a)), F.lower(body(b)))
    say = lambda ok, value, why: F.struct(ok.alias("similar"), value.alias("similarity"), F.lit(why).cast("string").alias("reason"))
    no = lambda why: say(F.lit(False), F.lit(0.0), why)
    return (
        F.when(foreign, no("Dominios diferentes"))
        .when(~F.coalesce(a["success"], F.lit(False)), no("Fallo en extracción de primera URL"))
        .when(~F.coalesce(b["success"], F.lit(False)), no("Fallo en extracción de segunda URL"))
        .when((body(a) == "") & (body(b) == ""), no("Sin contenido para comparar"))
        .when((body(a) == "") | (body(b) == ""), no("Solo una URL tiene contenido"))
        .otherwise(say(s >= threshold, s, None))
    )


def by_topic(items: DataFrame) -> DataFrame:
    """items (ord, source, text, relevance_score) that are no repetition of another, with their topic and what was merged into them.

    Pages below RELEVANT, or without a relevance, take no part. An item joins the first one before it that is as similar as TOPICS, by the
    TF-IDF cosine weighed over all items.
    """
    known = items.where(~F.col("source").eqNullSafe("html") | (F.coalesce("relevance_score", F.lit(0.0)) >= RELEVANT))
    clean = known.withColumn("cleaned_text", normalize_for_topics(F.col("text")))
    rows = clean.select("ord", ascii_terms(F.col("cleaned_text"), []).alias("w"))
    near = joins.cosine_pairs(joins.tfidf_units([(rows, "ord", F.col("w"))])[0], None, TOPICS).select(F.col("left_id").alias("u"), F.col("right_id").alias("v"))
    grouped = clean.join(dedup.first_leaders(rows.select(F.col("ord").alias("id")), near).select(F.col("id").alias("ord"), F.col("leader").alias("component")), "ord")
    merged = grouped.groupBy("component").agg(F.sort_array(F.collect_list("source")).alias("merged_from"))
    score = dedup.source_score(F.col("source"), F.col("relevance_score"), F.col("text"))
    best = grouped.withColumn("_s", score).withColumn("_rn", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("_s"), "ord"))).where("_rn = 1").drop("_rn", "_s")
    return best.join(merged, "component").withColumn("topic", questions.topic(F.col("text"))).drop("component")


def table_census(spark: SparkSession) -> DataFrame:
    """name, n of the session's tables and views, the largest first."""
    rows = [(x.name, spark.table(x.name).count()) for x in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, n long").orderBy(F.desc("n"), "name")


def column_census(spark: SparkSession) -> DataFrame:
    """table, column, type of the session's tables and views."""
    return spark.createDataFrame([(x.name, c.name, c.dataType) for x in spark.catalog.listTables() for c in spark.catalog.listColumns(x.name)], "table string, column string, type string")


def store_info(spark: SparkSession, table: str, extension: str = "") -> DataFrame:
    """version, extension, records of a stored table; one that can't be read is 'Error' with 0 records."""
    try:
        row = (spark.version, extension or "No instalado", spark.table(table).count())
    except AnalysisException:
        row = ("Error", "Error", 0)
    return spark.createDataFrame([row], "version string, extension string, records long")

"""From consolidated documents to texts, clean items, points and figures, and back to clean documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.dates import month_key
from tidewire.functions.questions import event_class
from tidewire.functions.text import clean_boilerplate, title_of
from tidewire.operators.chunking import chunk_id, token_windows
from tidewire.sources.schemas import TEXTS


def _has(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def _row(**own) -> list[Column]:
    """The columns of TEXTS, null where not given."""
    out = []
    for field in TEXTS.split(", "):
        name, kind = field.split(" ")
        out.append((own[name] if name in own else F.lit(None)).cast(kind).alias(name))
    return out


def texts_of(docs: DataFrame, described: bool = False) -> DataFrame:
    """file, day and TEXTS, where described also a page's description: the four sections of documents as rows, in a union of narrow branches without a shuffle.

    Texts that are empty and images with an error are left out; an image's name falls back to its file, its URL, its key.
    """
    base = docs.select("file", "day", "extracted_content.*")
    about = lambda c: [c.cast("string").alias("description")] if described else []
    pdf = base.select("file", "day", F.explode("pdf_paragraphs").alias("section", "ps")).select("file", "day", "section", F.explode("ps").alias("p"))
    pdf = pdf.select("file", "day", *_row(source=F.lit("pdf"), source_key=F.col("section"), section=F.col("section"), text=F.col("p.text"), url=F.col("p.metadata.url"), title=F.col("p.metadata.description"), page=F.col("p.page"), relevance_score=F.lit(1.0)), *about(F.lit(None)))
    html = base.select("file", "day", F.explode("html_pages").alias("k", "h"))
    html = html.select("file", "day", *_row(source=F.lit("html"), source_key=F.col("k"), text=F.col("h.text"), url=F.col("k"), title=F.col("h.metadata.title"), page=F.col("h.page"), relevance_score=F.coalesce("h.relevance", F.lit(0.0))), *about(F.col("h.metadata.description")))
    image = base.select("file", "day", F.explode("image_texts").alias("k", "i")).where(~_has(F.col("i.error")))
    name = F.coalesce(F.nullif("i.image_filename", F.lit("")), F.nullif("i.file", F.lit("")), F.nullif("i.url", F.lit("")), F.nullif("k", F.lit("")), F.lit("unknown_image"))
    image = image.select("file", "day", *_row(source=F.lit("image"), source_key=F.col("k"), text=F.coalesce(F.nullif("i.extracted_text", F.lit("")), F.col("i.text")), url=F.col("i.url"), title=name, relevance_score=F.lit(0.5)), *about(F.lit(None)))
    fb = base.select("file", "day", F.explode("facebook_texts").alias("k", "f"))
    fb = fb.select("file", "day", *_row(source=F.lit("facebook"), source_key=F.col("k"), section=F.lit("post"), text=F.col("f.extracted_text"), url=F.col("k"), relevance_score=F.lit(0.4)), *about(F.lit(None)))
    return pdf.unionByName(html).unionByName(image).unionByName(fb).where(_has(F.col("text")))


def clean_items(docs: DataFrame) -> DataFrame:
    """Texts without boilerplate: pages need a title that says something and get their description in front; images and posts
    need over 50 characters."""
    # a row for each text that is left, by explode: a filter on the cleaned text would clean it once more, and so would each use of it
    left = F.filter(F.array(clean_boilerplate(F.col("text"))), lambda x: x != "")
    rows = texts_of(docs, described=True).withColumn("clean", F.explode(left)).drop("text")
    titled = (F.coalesce(F.col("title"), F.lit("")) != "OneDrive") & (F.char_length(F.coalesce(F.col("title"), F.lit(""))) >= 5)
    long_enough = F.when(F.col("source") == "html", titled).when(F.col("source").isin("image", "facebook"), F.char_length("clean") > 50).otherwise(True)
    useful = (F.char_length("description") > 20) & (F.col("description") != F.col("title"))
    return rows.where(long_enough).withColumn("text", F.when(useful, F.concat_ws("\n\n", "description", "clean")).otherwise(F.col("clean"))).drop("clean", "description")


def points_of(docs: DataFrame, section: str | None = "CONTENIDO_INICIAL", size: int = 400, step: int = 350) -> DataFrame:
    """Chunks with their payload; of the bulletin only the given section unless None."""
    rows = texts_of(docs)
    if section is not None:
        rows = rows.where((F.col("source") != "pdf") | (F.col("section") == section))
    kind = F.when(F.col("source") == "pdf", "pdf_paragraph").otherwise(F.col("source"))
    named = F.when(F.col("source").isin("pdf", "html", "image"), F.coalesce(F.when(F.col("source") == "image", F.col("source_key")).otherwise(F.col("title")), F.lit(""))).otherwise("post")
    chunks = token_windows(rows, "text", size, step)
    return chunks.select(
        chunk_id(F.concat_ws("|", "file", "source", "source_key", F.xxhash64("text").cast("string")), F.col("chunk_index"), F.col("chunk")).alias("id"),
        F.col("chunk").alias("text"), F.col("day").alias("date"), F.col("day").alias("date_day"), month_key(F.col("day")).alias("date_month"), "file", kind.alias("source_type"),
        named.alias("section"), "page", "url", event_class(F.col("chunk")).alias("event_type"), "chunk_index", "total_chunks",
    )


def stats_of(docs: DataFrame) -> DataFrame:
    """One row of figures per document, 0 where missing."""
    s = "metadata.stats_summary"
    number = lambda c: F.coalesce(c, F.lit(0))
    at = lambda m, k: number(F.try_element_at(F.col(f"{s}.{m}"), F.lit(k)))
    return docs.select(
        F.lit("resumen_estadistico").alias("type"), "file", F.col("day").alias("date_day"), month_key(F.col("day")).alias("date_month"),
        number(F.col(f"{s}.total_urls_in_pdf")).alias("total_urls"), at("html_processing", "processed").cast("int").alias("html_processed"), at("html_processing", "successful").cast("int").alias("html_successful"),
        at("image_processing", "attempted_download").alias("image_attempted"), at("image_processing", "successful_download").alias("image_downloaded"), at("facebook_processing", "extracted_texts").alias("facebook_extracted"),
        at("timings_seconds", "pdf_extraction").alias("time_pdf_extraction"), at("timings_seconds", "pdf_text_extraction").alias("time_text_extraction_pdf"), at("timings_seconds", "image_download").alias("time_image_download"),
        at("timings_seconds", "image_api").alias("time_image_api"), at("timings_seconds", "html_scraping").alias("time_html_scraping"), at("timings_seconds", "facebook_processing").alias("time_facebook_processing"),
        F.coalesce(F.col(f"{s}.run_timestamp"), F.lit("")).alias("run_timestamp"), number(F.col(f"{s}.semantic_cleaning.representative_texts")).alias("semantic_chunks"),
    )


def only_representatives(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """docs whose sections hold only the texts in reps (file, source, source_key, text)."""
    keep = texts_of(docs).join(reps.select("file", "source", "source_key", F.xxhash64("text").alias("h")).distinct(), ["file", "source", "source_key"]).where(F.col("h") == F.xxhash64("text"))
    keys = keep.groupBy("file").agg(F.collect_set(F.concat_ws("|", "source", "source_key", F.col("h").cast("string"))).alias("keys"))
    joined = docs.join(keys, "file", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    has = lambda source, key, text: F.array_contains("keys", F.concat_ws("|", F.lit(source), key, F.xxhash64(text).cast("string")))
    c = "extracted_content"
    pdf = F.map_filter(F.transform_values(f"{c}.pdf_paragraphs", lambda k, ps: F.filter(ps, lambda p: has("pdf", k, p["text"]))), lambda k, ps: F.size(ps) > 0)
    content = F.struct(
        pdf.alias("pdf_paragraphs"),
        F.map_filter(f"{c}.html_pages", lambda k, v: has("html", k, v["text"])).alias("html_pages"),
        F.map_filter(f"{c}.image_texts", lambda k, v: has("image", k, F.coalesce(F.nullif(v["extracted_text"], F.lit("")), v["text"]))).alias("image_texts"),
        F.map_filter(f"{c}.facebook_texts", lambda k, v: has("facebook", k, v["extracted_text"])).alias("facebook_texts"),
    )
    return joined.withColumn(c, content).drop("keys")


def merge_facebook(docs: DataFrame, posts: DataFrame) -> DataFrame:
    """docs with the posts (file, url, extracted_text, pdf_path, processed_date) as their section; documents without posts keep theirs."""
    entry = F.struct("extracted_text", "pdf_path", "processed_date", F.lit(True).alias("success"))
    first = posts.groupBy("file", "url").agg(F.min(entry).alias("e"))
    sections = first.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("url", "e"))).alias("posts"))
    joined = docs.join(sections, "file", "left")
    return joined.withColumn("extracted_content", F.col("extracted_content").withField("facebook_texts", F.coalesce("posts", "extracted_content.facebook_texts"))).drop("posts")


def post_titles(posts: DataFrame) -> DataFrame:
    """posts with title (first line, 70 characters) and excerpt (1000 characters)."""
    return posts.withColumns({"title": title_of(F.col("extracted_text")), "excerpt": F.left("extracted_text", F.lit(1000))})


def repaired_links(rows: DataFrame, url: Column, context: Column) -> DataFrame:
    """URL, Context as strings; rows without a URL go."""
    return rows.select(url.cast("string").alias("URL"), context.cast("string").alias("Context")).where(_has(F.col("URL")))

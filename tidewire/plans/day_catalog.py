"""Registered queries of ingestion, reports, bulletins, media rules and text forms, over day documents made of whole tables.

A day document is made of each row of documents (a bulletin paragraph), pages (a web page), conversations (a post) and benchmark (an
image's text), so nothing has to be gathered into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions import dates, media, questions, similarity, text, urls
from tidewire.operators import dashboard, dedup, upsert
from tidewire.plans import ingest, reports
from tidewire.sources import readers, schemas, writers

from . import catalog
from .catalog import NETLOC, PATH, URLS, WS, _any, _boilerplate_sql, _collapse, _in, query, t

c = F.col
_DAY = "strftime(DATE '2024-01-01' + ({x} % 31)::INTEGER, '%d%m%Y')"


def _typed(kind: T.DataType, **own: Column) -> Column:
    """A struct of a schema's fields, null where not given."""
    return F.struct(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])


def day_documents(spark: SparkSession, d: str) -> DataFrame:
    """file, day, metadata, extracted_content; see the module's docstring."""
    whole = T.DataType.fromDDL(schemas.DOCUMENT)
    kind, content = whole["metadata"].dataType, whole["extracted_content"].dataType

    def made(rows: DataFrame, letter: str, key: Column, number: Column, stats: Column | None = None, **section: Column) -> DataFrame:
        day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (number % 31).cast("int")), "ddMMyyyy")
        meta = _typed(kind, **({"stats_summary": stats} if stats is not None else {}))
        return rows.select(F.concat(F.lit(letter), key.cast("string")).alias("file"), day.alias("day"), meta.alias("metadata"), _typed(content, **section).alias("extracted_content"))

    entry = lambda name: content[name].dataType.valueType
    n, paragraph = c("doc_id"), entry("pdf_paragraphs").elementType
    part = F.when(n % 3 == 0, "CONTENIDO_INICIAL").otherwise(F.coalesce("source", F.lit("")))
    stats = _typed(
        kind["stats_summary"].dataType,
        run_timestamp=F.when(n % 2 == 0, F.concat(F.lit("2024-01-01T10:00:"), F.lpad((n % 60).cast("string"), 2, "0"))),
        total_urls_in_pdf=c("n_chars") % 50,
        html_processing=F.create_map(F.lit("processed"), (n % 7).cast("double"), F.lit("successful"), (n % 5).cast("double")),
        timings_seconds=F.create_map(F.lit("pdf_extraction"), c("n_chars") / 1000.0),
    )
    docs = made(t(spark, d, "documents"), "d", n, n, stats, pdf_paragraphs=F.create_map(part, F.array(_typed(paragraph, text=c("text"), page=n % 9))))
    p = c("page_id")
    title = F.when(p % 5 == 0, "OneDrive").when(p % 7 == 0, "abc").otherwise(F.concat(F.lit("Page number "), p.cast("string")))
    about = F.when(p % 4 == 0, F.concat(F.lit("What the page "), p.cast("string"), F.lit(" says to those who read it")))
    page = _typed(entry("html_pages"), text=readers.html_text_plain(c("html")), relevance=(p % 10) / 10.0, metadata=F.struct(title.alias("title"), about.alias("description"), F.lit(None).cast("string").alias("url")))
    pages = made(t(spark, d, "pages"), "p", p, p, html_pages=F.create_map(F.coalesce("url", F.lit("")), page))
    conv = t(spark, d, "conversations").withColumn("k", F.concat_ws("-", "conv_id", "turn"))
    posts = made(conv, "c", c("k"), c("turn"), facebook_texts=F.create_map(F.concat(F.lit("https://facebook.com/"), c("k")), _typed(entry("facebook_texts"), extracted_text=c("text"))))
    i = c("item_id")
    image = _typed(entry("image_texts"), image_filename=F.when(i % 2 == 0, F.concat(F.lit("f"), i.cast("string"), F.lit(".png"))), extracted_text=F.when(i % 3 != 0, c("text")), text=c("text"), error=F.when(i % 4 == 0, "Timeout reading"))
    images = made(t(spark, d, "benchmark"), "b", i, i, image_texts=F.create_map(F.concat(F.lit("img"), i.cast("string")), image))
    return docs.unionByName(pages).unionByName(posts).unionByName(images)


_HTML = _collapse("regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')")
_BODY = "regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g')"
for _tag in readers.DROPPED:
    _BODY = f"regexp_replace({_BODY}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'g')"
_BODY = _HTML.replace("{x}", _BODY)
_TITLE = "CASE WHEN page_id % 5 = 0 THEN 'OneDrive' WHEN page_id % 7 = 0 THEN 'abc' ELSE 'Page number ' || page_id END"
#: The texts of the day documents.
TX = f"""tx AS (SELECT 'd' || doc_id AS file, {_DAY.format(x="doc_id")} AS day, 'pdf' AS source, CASE WHEN doc_id % 3 = 0 THEN 'CONTENIDO_INICIAL' ELSE coalesce(source, '') END AS source_key, CASE WHEN doc_id % 3 = 0 THEN 'CONTENIDO_INICIAL' ELSE coalesce(source, '') END AS section, text, NULL AS url, NULL AS title, (doc_id % 9)::INTEGER AS page, 1.0::DOUBLE AS relevance_score FROM documents
UNION ALL SELECT 'p' || page_id, {_DAY.format(x="page_id")}, 'html', coalesce(url, ''), NULL, {_BODY}, coalesce(url, ''), {_TITLE}, NULL, ((page_id % 10) / 10.0)::DOUBLE FROM pages
UNION ALL SELECT 'b' || item_id, {_DAY.format(x="item_id")}, 'image', 'img' || item_id, NULL, text, NULL, CASE WHEN item_id % 2 = 0 THEN 'f' || item_id || '.png' ELSE 'img' || item_id END, NULL, 0.5 FROM benchmark WHERE item_id % 4 <> 0
UNION ALL SELECT 'c' || conv_id || '-' || turn, {_DAY.format(x="turn")}, 'facebook', 'https://facebook.com/' || conv_id || '-' || turn, 'post', text, 'https://facebook.com/' || conv_id || '-' || turn, NULL, NULL, 0.4 FROM conversations),
txt AS (SELECT * FROM tx WHERE trim(coalesce(text, ''), ' ') <> '')"""


# ---- ingestion -----------------------------------------------------------------------------------------------------------------


@query(f"WITH {TX} SELECT file, day, source, source_key, section, url, title, page, relevance_score, md5(text) AS text_md5 FROM txt")
def day_texts(spark: SparkSession, d: str) -> DataFrame:
    return ingest.texts_of(day_documents(spark, d)).select("file", "day", "source", "source_key", "section", "url", "title", "page", "relevance_score", F.md5("text").alias("text_md5"))


def _clean_sql() -> str:
    """The cleaning rule as SQL over rows (file, source, ..., text) of txt."""
    whole = _boilerplate_sql()
    return whole.replace("SELECT doc_id, coalesce(text, '') AS text,", "SELECT *,").replace("FROM documents)", "FROM txt)").replace("SELECT doc_id, CASE", "SELECT *, CASE").replace("WITH a AS", "a AS", 1).replace(") SELECT *, CASE", "), b AS (SELECT *, CASE") + ")"


@query(f"""WITH {TX}, {_clean_sql()}, e AS (SELECT *, CASE WHEN source = 'html' AND regexp_extract(file, '[0-9]+')::BIGINT % 4 = 0 THEN 'What the page ' || substr(file, 2) || ' says to those who read it' END AS about FROM b WHERE cleaned <> '')
SELECT file, source, source_key, md5(CASE WHEN length(about) > 20 AND about <> title THEN about || chr(10) || chr(10) || cleaned ELSE cleaned END) AS text_md5 FROM e
WHERE CASE WHEN source = 'html' THEN coalesce(title, '') <> 'OneDrive' AND length(coalesce(title, '')) >= 5 WHEN source IN ('image', 'facebook') THEN length(cleaned) > 50 ELSE true END""")
def day_clean_items(spark: SparkSession, d: str) -> DataFrame:
    return ingest.clean_items(day_documents(spark, d)).select("file", "source", "source_key", F.md5("text").alias("text_md5"))


_EVENT = "CASE " + " ".join(f"WHEN {_any('lower(chunk)', keys)} THEN '{name}'" for name, keys in questions.EVENTS.items()) + " END"


@query(f"""WITH {TX}, w AS (SELECT *, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS w FROM txt WHERE source <> 'pdf' OR section = 'CONTENIDO_INICIAL'),
s AS (SELECT *, unnest(generate_series(0, len(w) - 1, 350)) AS s FROM w WHERE len(w) > 0), k AS (SELECT *, array_to_string(list_slice(w, s + 1, s + 400), ' ') AS chunk FROM s)
SELECT file, CASE WHEN source = 'pdf' THEN 'pdf_paragraph' ELSE source END AS source_type, CASE source WHEN 'image' THEN source_key WHEN 'facebook' THEN 'post' ELSE coalesce(title, '') END AS section, page, url, day AS date_day, substr(day, 3) AS date_month,
 {_EVENT} AS event_type, (s // 350)::INTEGER AS chunk_index, ceil(len(w) / 350.0)::INTEGER AS total_chunks, md5(chunk) AS text_md5 FROM k""")
def day_points(spark: SparkSession, d: str) -> DataFrame:
    points = ingest.points_of(day_documents(spark, d))
    return points.select("file", "source_type", "section", "page", "url", "date_day", "date_month", "event_type", "chunk_index", "total_chunks", F.md5("text").alias("text_md5"))


@query(f"""SELECT 'd' || doc_id AS file, {_DAY.format(x="doc_id")} AS date_day, (n_chars % 50)::INTEGER AS total_urls, (doc_id % 7)::INTEGER AS html_processed, (doc_id % 5)::INTEGER AS html_successful, 0 AS image_attempted, round(n_chars / 1000.0, 6)::DOUBLE AS pdf_seconds, CASE WHEN doc_id % 2 = 0 THEN '2024-01-01T10:00:' || lpad((doc_id % 60)::VARCHAR, 2, '0') ELSE '' END AS run_timestamp FROM documents""")
def day_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.stats_of(day_documents(spark, d)).where("file like 'd%'")
    return rows.select("file", "date_day", "total_urls", "html_processed", "html_successful", "image_attempted", F.round("time_pdf_extraction", 6).alias("pdf_seconds"), "run_timestamp")


@query(f"WITH {TX} SELECT file, source, source_key, md5(text) AS text_md5 FROM txt WHERE length(text) % 3 <> 0")
def day_representatives(spark: SparkSession, d: str) -> DataFrame:
    docs = day_documents(spark, d)
    only = ingest.only_representatives(docs, ingest.texts_of(docs).where(F.char_length("text") % 3 != 0))
    return ingest.texts_of(only).select("file", "source", "source_key", F.md5("text").alias("text_md5"))


@query("""WITH p AS (SELECT 'd' || conv_id AS file, 'https://fb.com/' || turn AS url, min(coalesce(text, '')) AS text FROM conversations GROUP BY ALL), f AS (SELECT p.* FROM p WHERE file IN (SELECT 'd' || doc_id FROM documents)
UNION ALL SELECT 'c' || conv_id || '-' || turn, 'https://facebook.com/' || conv_id || '-' || turn, text FROM conversations) SELECT file, url, md5(text) AS text_md5 FROM f WHERE trim(coalesce(text, ''), ' ') <> ''""")
def day_posts_merged(spark: SparkSession, d: str) -> DataFrame:
    empty = F.lit(None).cast("string")
    posts = t(spark, d, "conversations").select(F.concat(F.lit("d"), c("conv_id").cast("string")).alias("file"), F.concat(F.lit("https://fb.com/"), c("turn").cast("string")).alias("url"), F.coalesce("text", F.lit("")).alias("extracted_text"), empty.alias("pdf_path"), empty.alias("processed_date"))
    merged = ingest.texts_of(ingest.merge_facebook(day_documents(spark, d), posts)).where("source = 'facebook'")
    return merged.select("file", "url", F.md5("text").alias("text_md5"))


@query(f"SELECT conv_id, turn, left(coalesce(text, ''), 1000) AS excerpt, CASE WHEN length(l) > 70 THEN left(l, 70) || '...' ELSE l END AS title FROM (SELECT *, coalesce(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '')[1], '') AS l FROM conversations)")
def post_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("extracted_text"))
    return ingest.post_titles(rows).select("conv_id", "turn", "title", "excerpt")


@query("SELECT url AS URL, page_id::VARCHAR AS Context FROM pages WHERE trim(coalesce(url, ''), ' ') <> ''")
def repaired_links(spark: SparkSession, d: str) -> DataFrame:
    return ingest.repaired_links(t(spark, d, "pages"), c("url"), c("page_id"))


_PLAIN_UP = "trim(regexp_replace(upper(translate({x}, 'áàâäãåāăąéèêëēĕėęěíìîïĩīĭįóòôöõōŏőúùûüũūŭůűýÿçćĉċčñńňśŝşšžźżďťřľĺğģķ', '" + text.PLAIN + "')), '" + WS + "+', ' ', 'g'), ' ')"
_HEADER = f"({_PLAIN_UP.replace('{x}', 'x')} IN {_in([h.translate(str.maketrans('ÁÉÍÓÚÑ', 'AEIOUN')) for h in text.HEADERS])} OR (regexp_matches(x, '^[A-ZÁÉÍÓÚÑ\\x09-\\x0D\\x1C-\\x20\\x85\\p{{Z}}\\-–/]{{5,}}$') AND length(x) BETWEEN 5 AND 50 AND NOT regexp_matches(x, '[@:?=&%]')))"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("file"), c("doc_id").cast("int").alias("page"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "x"))
    head = F.when((c("i") == 0) & (c("page") % 4 == 0), "Medio  ambiente").when((c("i") == 0) & (c("page") % 4 == 1), "POLÍTICA / ECONOMÍA").when((c("i") == 0) & (c("page") % 4 == 2), F.concat(F.lit("LÍNEA "), F.translate((c("page") % 7).cast("string"), "0123456789", "ABCDEFGHIJ")))
    opening = lines.where(head.isNotNull()).select("file", "page", F.lit(0).alias("block_no"), head.alias("text"))
    return lines.select("file", "page", (c("i") + 1).alias("block_no"), c("x").alias("text")).unionByName(opening)


_BLOCKS = f"""l AS (SELECT coalesce(source, '') AS file, doc_id::INTEGER AS page, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1)::INTEGER AS block_no FROM documents),
o AS (SELECT * FROM l UNION ALL SELECT coalesce(source, ''), doc_id::INTEGER, CASE doc_id % 4 WHEN 0 THEN 'Medio  ambiente' WHEN 1 THEN 'POLÍTICA / ECONOMÍA' ELSE 'LÍNEA ' || translate((doc_id % 7)::VARCHAR, '0123456789', 'ABCDEFGHIJ') END, 0 FROM documents WHERE doc_id % 4 < 3),
n AS (SELECT file, page, block_no, regexp_replace(x, '^{WS}+|{WS}+$', '', 'g') AS x FROM o), h AS (SELECT *, {_HEADER} AS is_head FROM n WHERE x <> ''),
s AS (SELECT *, coalesce(last_value(CASE WHEN is_head THEN x END IGNORE NULLS) OVER (PARTITION BY file ORDER BY page, block_no ROWS UNBOUNDED PRECEDING), 'CONTENIDO_INICIAL') AS section FROM h),
p AS (SELECT *, {_collapse("regexp_replace(x, '[\\x00-\\x1F\\x7F]', ' ', 'g')")} AS text FROM s WHERE NOT is_head),
d AS (SELECT *, regexp_replace(text, '{text.URL_IN_TEXT}', '', 'g') AS bare, regexp_extract(text, '{text.URL_IN_TEXT}') AS url FROM p WHERE text <> '' AND NOT regexp_matches(text, '{text.EMAIL}')), w AS (SELECT *, list_filter(regexp_split_to_array(bare, '{WS}+'), lambda v: v <> '') AS w FROM d)"""


@query(f"WITH {_BLOCKS} SELECT file, section, page, block_no, text, CASE WHEN len(w) <= 5 THEN regexp_replace(bare, '^{WS}+|{WS}+$', '', 'g') ELSE array_to_string(list_slice(w, 1, 5), ' ') || '...' END AS description, url FROM w")
def bulletin_sections(spark: SparkSession, d: str) -> DataFrame:
    return readers.bulletin_sections(_blocks(spark, d))


# ---- reports -------------------------------------------------------------------------------------------------------------------


def _points(spark: SparkSession, d: str) -> DataFrame:
    n = c("doc_id")
    event = F.when(n % 4 == 0, "supervision").when(n % 4 == 1, "interrupcion").when(n % 4 == 2, "denuncia")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 45).cast("int")), "ddMMyyyy")
    kind = F.when(n % 2 == 0, "pdf_paragraph").otherwise("html")
    return t(spark, d, "documents").select(F.lpad(n.cast("string"), 9, "0").alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), day.alias("date_day"), F.concat("lang", F.when(n % 5 == 0, ".JPG").otherwise("")).alias("section"), event.alias("event_type"), kind.alias("source_type"), (n % 3).cast("int").alias("page"), F.concat(F.lit("http://"), c("source")).alias("url"), F.when(n % 6 == 0, 1).otherwise(0).alias("chunk_index"))


_P = "p AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS id, doc_id, coalesce(text, '') AS text, strftime(DATE '2024-01-01' + (doc_id % 45)::INTEGER, '%d%m%Y') AS date_day, (DATE '2024-01-01' + (doc_id % 45)::INTEGER)::DATE AS day, lang || CASE WHEN doc_id % 5 = 0 THEN '.JPG' ELSE '' END AS section, CASE doc_id % 4 WHEN 0 THEN 'supervision' WHEN 1 THEN 'interrupcion' WHEN 2 THEN 'denuncia' END AS event_type, CASE WHEN doc_id % 2 = 0 THEN 'pdf_paragraph' ELSE 'html' END AS source_type, (doc_id % 3)::INTEGER AS page, 'http://' || source AS url, CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS chunk_index FROM documents)"


@query(f"""WITH {_P}, f AS (SELECT * FROM p WHERE chunk_index = 0),
a AS (SELECT * FROM f WHERE event_type = 'supervision' QUALIFY row_number() OVER (PARTITION BY section, event_type ORDER BY date_day, id) = 1), n AS (SELECT * FROM f WHERE source_type = 'pdf_paragraph' QUALIFY row_number() OVER (PARTITION BY section, page ORDER BY date_day, id) = 1), h AS (SELECT * FROM f WHERE source_type = 'html' QUALIFY row_number() OVER (PARTITION BY url ORDER BY date_day, id) = 1)
SELECT 'supervision' AS part, CASE WHEN lower(section) LIKE '%.jpg' THEN 'No se encontró título' ELSE section END AS title, md5(text) AS summary, CASE WHEN page = 0 THEN 1 ELSE page END AS page FROM a
UNION ALL SELECT 'events', section, md5(text), CASE WHEN page = 0 THEN 1 ELSE page END FROM f WHERE event_type IN ('interrupcion', 'denuncia') UNION ALL SELECT 'news', section, md5(text), page FROM n UNION ALL SELECT 'pages', section, md5(text), NULL FROM h""")
def dashboard_sections(spark: SparkSession, d: str) -> DataFrame:
    parts = reports.dashboard_parts(_points(spark, d), ingest.stats_of(day_documents(spark, d)))
    shown = lambda name, page: parts[name].select(F.lit(name).alias("part"), "title", F.md5("summary").alias("summary"), page.alias("page"))
    return shown("supervision", c("page")).unionByName(shown("events", c("page"))).unionByName(shown("news", c("page"))).unionByName(shown("pages", F.lit(None).cast("int")))


@query("SELECT count(*) + (SELECT count(*) FROM pages) + (SELECT count(*) FROM conversations) + (SELECT count(*) FROM benchmark) AS n, sum(n_chars % 50)::BIGINT AS total_total_urls, sum(doc_id % 7)::BIGINT AS total_html_processed, strftime(max(CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-01-01 10:00:00' + to_seconds((doc_id % 60)::INTEGER) END) - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS last_run FROM documents")
def dashboard_run_totals(spark: SparkSession, d: str) -> DataFrame:
    return reports.dashboard_parts(_points(spark, d), ingest.stats_of(day_documents(spark, d)))["totals"].select("n", "total_total_urls", "total_html_processed", "last_run")


_COS = "list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q)))"
_SCORED = f"{_P}, v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT e AS q FROM v ORDER BY vec_id LIMIT 1), s AS (SELECT p.*, round({_COS}, 6) AS similarity FROM p JOIN v ON vec_id = doc_id, q)"
_ONCE = "u AS (SELECT * FROM b WHERE {key} <> '' QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY similarity DESC, id) = 1)".replace("{key}", "lower(regexp_replace(text, '^[ \\t\\n\\x0b\\x0c\\r]+|[ \\t\\n\\x0b\\x0c\\r]+$', '', 'g'))")
_SHOWN = "SELECT doc_id, similarity, row_number() OVER (ORDER BY similarity DESC, id)::INTEGER AS rank, md5('[fecha: ' || date_day || '] [fuente: ' || source_type || '] [sección: ' || section || ']' || chr(10) || text) AS context FROM u"


def _context(spark: SparkSession, d: str, question: str) -> DataFrame:
    vectors = t(spark, d, "embeddings").select(c("vec_id").alias("doc_id"), "embedding")
    probe = list(t(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0])
    return reports.context_for(spark, _points(spark, d).join(vectors, "doc_id"), question, probe)


@query(f"WITH {_SCORED}, b AS (SELECT * FROM s WHERE substr(date_day, 3) = '022024' ORDER BY similarity DESC, id LIMIT 50), {_ONCE} {_SHOWN}")
def context_of_month(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, "qué pasó en febrero 2024").select("doc_id", "similarity", "rank", F.md5("context").alias("context"))


@query(f"WITH {_SCORED}, b AS (SELECT * FROM s WHERE date_day = '03012024' AND event_type = 'denuncia' ORDER BY similarity DESC, id LIMIT 50), {_ONCE} {_SHOWN}")
def context_of_day(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, "qué denuncia hubo el 3 de enero de 2024").select("doc_id", "similarity", "rank", F.md5("context").alias("context"))


_RANGE = f"{_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY date_diff('day', DATE '2024-01-05', day) // 10 ORDER BY similarity DESC, id) AS k FROM s WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-02-03'), b AS (SELECT * FROM r WHERE k <= 30), {_ONCE}"


@query(f"WITH {_RANGE} {_SHOWN}")
def context_of_range(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, "qué pasó del 5 de enero de 2024 al 3 de febrero de 2024").select("doc_id", "similarity", "rank", F.md5("context").alias("context"))


@query(f"WITH {_RANGE}, x AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM u), y AS (SELECT *, row_number() OVER (ORDER BY day, rank) AS n FROM x) SELECT doc_id, ((n - 1) // 3 + 1)::INTEGER AS block, ceil(least((SELECT count(*) FROM y), 21) / 3.0)::INTEGER AS n_blocks FROM y WHERE n <= 21")
def answer_blocks(spark: SparkSession, d: str) -> DataFrame:
    return reports.answer_parts(_context(spark, d, "qué pasó del 5 de enero de 2024 al 3 de febrero de 2024")).select("doc_id", "block", "n_blocks")


_SAID = "coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' hubo un Corte de agua' WHEN 1 THEN ' una denuncia' ELSE '' END"


@query(f"WITH x AS (SELECT doc_id, {_SAID} AS s FROM documents), h AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM x WHERE {_any('lower(s)', questions.EVENTS['interrupcion'])}) SELECT 'interrupcion' AS event, count(*) AS n, 'interrupciones' AS plural, string_agg(trim(left(s, 200), ' ') || '...', '|' ORDER BY r) FILTER (WHERE r <= 5) AS examples FROM h")
def count_answer(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.coalesce("text", F.lit("")), F.when(c("doc_id") % 4 == 0, " hubo un Corte de agua").when(c("doc_id") % 4 == 1, " una denuncia").otherwise(""))
    rows = t(spark, d, "documents").select(c("doc_id").alias("rank"), said.alias("text"))
    return reports.count_answer(rows, "¿cuántas interrupciones hubo?").select("event", "n", "plural", F.array_join("examples", "|").alias("examples"))


@query("SELECT doc_id FROM documents WHERE CASE WHEN doc_id % 3 = 0 THEN 20240100 + doc_id % 28 + 1 ELSE strftime(DATE '2024-01-01' + (doc_id % 45)::INTEGER, '%Y%m%d')::INTEGER END BETWEEN 20240110 AND 20240120")
def nearest_day(spark: SparkSession, d: str) -> DataFrame:
    rows = _points(spark, d).withColumn("day_num", F.when(c("doc_id") % 3 == 0, (c("doc_id") % 28 + 20240101).cast("int")))
    return reports.nearest_day(rows, "day_num", "date_day", F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date")).select("doc_id")


@query(f"WITH {URLS}, k AS (SELECT CASE WHEN url = '' THEN 'invalid' " + " ".join(f"WHEN {_any('lower(url)', v)} THEN '{k}'" for k, v in urls.ONE_LEVEL.items()) + " ELSE 'other' END AS category FROM x) SELECT category, count(*) AS n FROM k GROUP BY category")
def link_categories(spark: SparkSession, d: str) -> DataFrame:
    return reports.link_report(t(spark, d, "pages").select("page_id", "url", F.lit("").alias("body")), "url", "body", "page_id")["categories"]


_SAME = "WITH k AS (SELECT doc_id, source, lower(coalesce(text, '')) AS b FROM documents)"


def _equal_labels(spark: SparkSession, d: str, absorb: bool = False) -> DataFrame:
    rows = t(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.lower(F.coalesce("text", F.lit(""))).alias("b"))
    return dedup.leader_cluster(rows, "source", "doc_id", "b", 1.0, similarity=lambda a, b: 1.0 if a == b else 0.0, absorb=absorb, apart=F.xxhash64)


@query(f"{_SAME} SELECT doc_id AS ord, min(doc_id) OVER (PARTITION BY source, b) AS leader FROM k")
def leader_of_equal(spark: SparkSession, d: str) -> DataFrame:
    """Leader clustering with a similarity of the caller's, which SQL can follow: equality."""
    return _equal_labels(spark, d).select("ord", "leader")


@query(f"{_SAME}, l AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY source, b) AS leader FROM k) SELECT count(*) AS total, count(*) FILTER (WHERE doc_id = leader) AS unique_count, count(*) FILTER (WHERE doc_id <> leader) AS duplicate_count, round(100.0 * count(*) FILTER (WHERE doc_id <> leader) / count(*), 2)::DOUBLE AS duplicate_percentage FROM l")
def leader_stats(spark: SparkSession, d: str) -> DataFrame:
    return dedup.cluster_stats(dedup.with_fallback(t(spark, d, "documents"), lambda step: _equal_labels(spark, d, absorb=step > 0)))


def _hosts(p: str) -> str:
    return f"regexp_extract(coalesce({p}.url, ''), '{NETLOC}', 1)"


def _base(x: str) -> str:
    return f"CASE WHEN len(string_split({x}, '.')) < 2 THEN {x} ELSE array_to_string(list_slice(string_split({x}, '.'), -2, -1), '.') END"


_SOCIAL = " OR ".join(f"contains(ha, '{h}') OR contains(hb, '{h}')" for h in ("facebook.com", "twitter.com", "x.com", "youtube.com", "t.co"))


@query(f"""WITH j AS (SELECT a.page_id, {_hosts('a')} AS ha, {_hosts('b')} AS hb, a.page_id % 5 <> 0 AS oa, b.page_id % 5 <> 0 AS ob, CASE a.page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'b' END AS ta, CASE b.page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'A' ELSE 'b' END AS tb FROM pages a JOIN pages b ON b.page_id = a.page_id + 1),
r AS (SELECT *, ha <> hb AND NOT ({_SOCIAL}) AND contains(ha, '.') AND contains(hb, '.') AND {_base('ha')} <> {_base('hb')} AS foreign_host FROM j)
SELECT page_id, CASE WHEN foreign_host OR NOT oa OR NOT ob OR ta = '' OR tb = '' THEN false ELSE lower(ta) = lower(tb) END AS similar, CASE WHEN NOT (foreign_host OR NOT oa OR NOT ob OR ta = '' OR tb = '') AND lower(ta) = lower(tb) THEN 1.0 ELSE 0.0 END::DOUBLE AS similarity,
 CASE WHEN foreign_host THEN 'Dominios diferentes' WHEN NOT oa THEN 'Fallo en extracción de primera URL' WHEN NOT ob THEN 'Fallo en extracción de segunda URL' WHEN ta = '' AND tb = '' THEN 'Sin contenido para comparar' WHEN ta = '' OR tb = '' THEN 'Solo una URL tiene contenido' END AS reason FROM r""")
def pair_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The decision on each page and the next; texts of a letter each, of which SQL knows the ratio."""
    p, n = t(spark, d, "pages"), c("page_id")
    one = p.select("page_id", urls.netloc(c("url")).alias("ha"), (n % 5 != 0).alias("oa"), F.when(n % 3 == 0, "").when(n % 3 == 1, "a").otherwise("b").alias("ta"))
    two = p.select((n - 1).alias("page_id"), urls.netloc(c("url")).alias("hb"), (n % 5 != 0).alias("ob"), F.when(n % 4 == 0, "").when(n % 4 == 1, "A").otherwise("b").alias("tb"))
    side = lambda k: {"host": c(f"h{k}"), "success": c(f"o{k}"), "text": c(f"t{k}"), "title": F.lit(None).cast("string")}
    return one.join(two, "page_id").select("page_id", reports.pair_decision(side("a"), side("b"), F.lit(0.85)).alias("x")).select("page_id", "x.*")


def _terms(x: str) -> str:
    """The lower-case words of x.text without ASCII punctuation."""
    return f"list_filter(regexp_split_to_array(translate(lower(coalesce({x}.text, '')), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '{WS}+'), lambda v: v <> '')"



@query(f"""WITH j AS (SELECT a.item_id AS id, {_terms('a')} AS wa, {_terms('b')} AS wb FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
u AS (SELECT id, 'a' AS side, unnest(wa) AS term FROM j UNION ALL SELECT id, 'b', unnest(wb) FROM j), f AS (SELECT id, term, count(*) FILTER (WHERE side = 'a') AS x, count(*) FILTER (WHERE side = 'b') AS y FROM u GROUP BY ALL),
w AS (SELECT id, sum(x * y) AS dot, sqrt(sum((x * CASE WHEN x > 0 AND y > 0 THEN 1.0 ELSE ln(1.5) + 1 END) ** 2)) * sqrt(sum((y * CASE WHEN x > 0 AND y > 0 THEN 1.0 ELSE ln(1.5) + 1 END) ** 2)) AS norm FROM f GROUP BY id)
SELECT j.id AS item_id, round(CASE WHEN coalesce(norm, 0) > 0 THEN dot / norm WHEN wa = wb THEN 1.0 ELSE 0.0 END, 6)::DOUBLE AS similarity FROM j LEFT JOIN w USING (id)""")
def pair_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF cosine fitted to two texts: each benchmark item and the next."""
    b = t(spark, d, "benchmark")
    words = text.ascii_terms(c("text"), [])
    pairs = b.select("item_id", words.alias("wa")).join(b.select((c("item_id") - 1).alias("item_id"), words.alias("wb")), "item_id")
    return pairs.select("item_id", F.round(similarity.pair_cosine(c("wa"), c("wb")), 6).alias("similarity"))


@query("SELECT count(*) AS original, count(DISTINCT lower(coalesce(text, ''))) AS groups, round((count(*) - count(DISTINCT lower(coalesce(text, '')))) * 100.0 / count(*), 2)::DOUBLE AS reduction_percentage FROM documents")
def clean_stats(spark: SparkSession, d: str) -> DataFrame:
    figures = t(spark, d, "documents").agg(F.count("*").alias("original"), F.count_distinct(F.lower(F.coalesce("text", F.lit("")))).alias("groups"))
    return figures.withColumn("reduction_percentage", dashboard.reduction(c("original"), c("groups")))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang HAVING count(*) > 1")
def count_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.count_by(t(spark, d, "documents"), c("lang"), "lang", least=1)


# ---- keyed tables and caches ---------------------------------------------------------------------------------------------------


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 <> 0 THEN lang END, 'unknown') AS lang, left(text, 0) || source AS origin, true AS checked FROM documents WHERE text IS NOT NULL")
def backfilled(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "documents").where("text is not null").select("doc_id", F.when(c("doc_id") % 3 != 0, c("lang")).alias("lang"), c("source").alias("origin"))
    return upsert.backfill(upsert.backfill(rows, "lang", F.lit("unknown")), "checked", F.lit(True))


@query("""WITH e AS (SELECT doc_id::VARCHAR AS key, lang AS content, TIMESTAMP '2024-01-01 00:00:00' AS stored_at, 3600 AS ttl FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id::VARCHAR AS key, source AS content, TIMESTAMP '2024-01-01 00:30:00' AS stored_at, 7200 AS ttl FROM documents WHERE doc_id % 3 = 0),
k AS (SELECT * FROM n UNION ALL SELECT * FROM e WHERE key NOT IN (SELECT key FROM n)), f AS (SELECT * FROM k WHERE TIMESTAMP '2024-01-01 01:10:00' < stored_at + to_seconds(ttl)) SELECT doc_id, content AS cached FROM documents LEFT JOIN f ON key = doc_id::VARCHAR""")
def cache_round(spark: SparkSession, d: str) -> DataFrame:
    """Entries put twice, the second with a longer life, then looked up when the first have expired."""
    docs, at = t(spark, d, "documents"), lambda x: F.lit(x).cast("timestamp")
    key = c("doc_id").cast("string").alias("key")
    first = upsert.cache_put(upsert.empty_cache(spark), docs.where("doc_id % 2 = 0").select(key, c("lang").alias("content")), at("2024-01-01 00:00:00"), 3600)
    both = upsert.cache_put(first, docs.where("doc_id % 3 = 0").select(key, c("source").alias("content")), at("2024-01-01 00:30:00"), 7200)
    return upsert.with_cached(docs.select("doc_id"), c("doc_id").cast("string"), both, at("2024-01-01 01:10:00"), "cached")


@query("SELECT doc_id, CASE WHEN text IS NOT NULL THEN [length(text)::DOUBLE, 1.0] END AS embedding FROM documents")
def embedded_once(spark: SparkSession, d: str) -> DataFrame:
    embed = lambda x: F.array(F.char_length(x).cast("double"), F.lit(1.0))
    return upsert.embed_once(t(spark, d, "documents"), "text", embed).select("doc_id", "embedding")


# ---- files and media -----------------------------------------------------------------------------------------------------------

_HEADS = {0: "FFD8FF00", 1: "89504E47", 2: "47494638", 3: "524946460000000057454250", 4: "424D", 5: "25504446"}
_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in _HEADS.items())


def _files(spark: SparkSession, d: str) -> DataFrame:
    p = c("page_id")
    head = F.coalesce(*[F.when(p % 9 == k, F.lit(v)) for k, v in _HEADS.items()], F.lit(""))
    content = F.concat(F.unhex(head), F.encode(F.coalesce("html", F.lit("")), "utf-8"))
    path = F.concat(F.lit("/x/"), p.cast("string"), F.when(p % 9 == 6, ".JPEG").when(p % 9 == 7, ".pdf").otherwise(""))
    return t(spark, d, "pages").select("page_id", "url", content.alias("content"), path.alias("path"))


@query(f"""WITH f AS (SELECT page_id, unhex(CASE page_id % 9 {_CASES} ELSE '' END) || encode(coalesce(html, '')) AS content FROM pages)
SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' WHEN 4 THEN 'image/bmp' WHEN 5 THEN 'application/pdf' WHEN 6 THEN 'image/jpeg' WHEN 7 THEN 'application/pdf' ELSE 'application/octet-stream' END AS kind,
 page_id % 9 IN (0, 1, 2, 3, 4, 6) AND octet_length(content) BETWEEN 1 AND 10485760 AS readable FROM f""")
def file_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = _files(spark, d).withColumn("kind", readers.file_kind(c("content"), c("path")))
    return rows.select("page_id", "kind", media.is_readable(c("kind"), F.octet_length("content")).alias("readable"))


_EXT = f"regexp_extract(lower(regexp_extract(coalesce(url, ''), '{PATH}', 1)), '(\\.(?:jpg|jpeg|png|gif|bmp|webp|svg|tiff|mp3|wav|ogg|m4a|mp4))$', 1)"
_ERR = "CASE page_id % 4 WHEN 0 THEN 'Read Timeout' WHEN 1 THEN 'not found' WHEN 2 THEN '' END"


@query(f"""WITH m AS (SELECT *, {_EXT} AS by_url, CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'audio/mpeg' END AS kind, {_ERR} AS err, (page_id * 37 % 6000 + 1)::INTEGER AS w, (page_id * 53 % 6000 + 1)::INTEGER AS h FROM pages),
x AS (SELECT *, CASE WHEN by_url = '.jpeg' THEN '.jpg' WHEN by_url <> '' THEN by_url WHEN kind = 'image/png' THEN '.png' WHEN kind = 'audio/mpeg' THEN '.mp3' ELSE '.jpg' END AS ext FROM m)
SELECT page_id, ext, 'img_' || (page_id % 11) || '_' || left(md5(coalesce(url, '')), 8) || '_01012024' || ext AS name, CASE WHEN coalesce(err, '') = '' THEN 60 WHEN err = 'Read Timeout' THEN 315360000 ELSE 3600 END AS ttl, coalesce(err, '') = 'Read Timeout' AS permanent, (2 ** (page_id % 6))::BIGINT AS pause,
 CASE WHEN w::BIGINT * h <= 8000000 THEN w WHEN w > h THEN least(2500, w) ELSE floor(least(2500, h) * w / h)::INTEGER END AS fit_width, CASE WHEN w::BIGINT * h <= 8000000 THEN h WHEN w > h THEN floor(least(2500, w) * h / w)::INTEGER ELSE least(2500, h) END AS fit_height,
 CASE WHEN kind = 'image/png' THEN 'describe' ELSE 'other' END AS prompt FROM x""")
def media_rules(spark: SparkSession, d: str) -> DataFrame:
    p = c("page_id")
    kind = F.when(p % 3 == 0, "image/png").when(p % 3 == 1, "audio/mpeg")
    err = F.when(p % 4 == 0, "Read Timeout").when(p % 4 == 1, "not found").when(p % 4 == 2, "")
    rows = t(spark, d, "pages").select("page_id", "url", kind.alias("kind"), err.alias("err"), (p * 37 % 6000 + 1).cast("int").alias("w"), (p * 53 % 6000 + 1).cast("int").alias("h")).withColumn("ext", media.media_extension(c("kind"), c("url")))
    rows = rows.withColumn("fit", media.fitted(c("w"), c("h")))
    return rows.select("page_id", "ext", media.media_name(p % 11, c("url"), F.lit("01012024"), c("ext")).alias("name"), media.error_ttl(c("err"), 60).alias("ttl"), media.is_permanent(c("err")).alias("permanent"), media.backoff_seconds(p % 6).alias("pause"), c("fit.width").alias("fit_width"), c("fit.height").alias("fit_height"), media.prompt_for(c("kind"), {"image/png": "describe"}, "other").alias("prompt"))


@query("WITH m AS (SELECT page_id, page_id * 3701 % 20000 + 1 AS w, page_id * 5303 % 20000 + 1 AS h FROM pages), r AS (SELECT *, least(1.0::DOUBLE, sqrt(25000000.0::DOUBLE / (w::DOUBLE * h))) AS k FROM m) SELECT page_id, floor(w * k)::INTEGER AS width, floor(h * k)::INTEGER AS height FROM r")
def media_within_area(spark: SparkSession, d: str) -> DataFrame:
    p = c("page_id")
    return t(spark, d, "pages").select("page_id", media.within_area(p * 3701 % 20000 + 1, p * 5303 % 20000 + 1).alias("x")).select("page_id", "x.*")


@query("SELECT page_id, row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id)::INTEGER AS image_index FROM pages")
def image_indexes(spark: SparkSession, d: str) -> DataFrame:
    return media.numbered_in_batch(t(spark, d, "pages").withColumn("batch", c("page_id") % 10), "batch", [c("page_id")]).select("page_id", "image_index")


@query(f"SELECT bool_and({_ERR} IS NOT NULL AND {_ERR} <> '') AS only_errors, bool_or({_ERR} IS NOT NULL AND {_ERR} <> '') AS any_error, count(*) AS n FROM pages")
def error_check(spark: SparkSession, d: str) -> DataFrame:
    p = c("page_id")
    return media.only_errors(t(spark, d, "pages").select(F.when(p % 4 == 0, "Read Timeout").when(p % 4 == 1, "not found").when(p % 4 == 2, "").alias("error")), c("error"))


# ---- text forms and questions --------------------------------------------------------------------------------------------------

_FOLD = "translate({x}, '" + text.MARKED + text.MARKED.upper() + "', '" + text.PLAIN + text.PLAIN.upper() + "')"


def _squeezed(x: str, kept: str) -> str:
    """x with runs of three or more of each kept character as two; other characters are blanked afterwards in any case."""
    for ch in kept:
        x = f"regexp_replace({x}, '{ch}{{3,}}', '{ch}{ch}', 'g')"
    return x


_LEET = "translate(" + _FOLD.replace("{x}", "lower(coalesce(text, ''))") + ", '0134@$57¡!?¿', 'oieaasst')"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_PLAIN = _collapse(f"regexp_replace({_squeezed(_LEET, _LETTERS + '0123456789ñ')}, '[^a-z0-9ñ ]+', ' ', 'g')")
_LETTERS_ONLY = _collapse(f"regexp_replace({_squeezed(_LEET, _LETTERS)}, '[^a-z]+', ' ', 'g')")


@query(f"SELECT conv_id, turn, {_FOLD.replace('{x}', 'coalesce(text, chr(0))').replace('chr(0)', chr(39) * 2)} AS folded, {_PLAIN} AS plain, {_LETTERS_ONLY} AS letters, {_collapse('''regexp_replace(coalesce(text, ''), '[\\x00-\\x1F\\x7F]', ' ', 'g')''')} AS paragraph, left(coalesce(text, ''), 40) AS short, upper(left(role, 1)) || lower(substr(replace(role, '_', ' '), 2)) AS label, len(regexp_extract_all(coalesce(text, ''), '{text.URL_IN_TEXT}')) AS n_urls FROM conversations")
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    x = c("text")
    return t(spark, d, "conversations").select("conv_id", "turn", text.fold_marks(x).alias("folded"), text.plain_for_intent(x).alias("plain"), text.letters_only(x).alias("letters"), text.clean_paragraph(x).alias("paragraph"), text.truncate_tokens(x, 10).alias("short"), text.label_of(c("role")).alias("label"), F.size(text.urls_in(x)).cast("long").alias("n_urls"))


def _intent_sql() -> str:
    has = lambda words: "(" + " OR ".join(f"contains(p, '{w}')" for w in words) + ")"
    intro = f"(regexp_matches(p, '{'|'.join(questions.INTRODUCTION)}') OR {has(questions.INTRODUCTION_WORDS)})"
    rules = [(f"p IN {_in(questions.SMALLTALK)} OR (n <= 3 AND {has(questions.SMALLTALK)})", "SMALLTALK", 0, 0), (intro, "PRESENTACION", 0, 0), (has(questions.HELP), "AYUDA", 0, 0), (has(questions.COUNTS), "COUNT_QUERY", 1, 0), (has(questions.DATES), "DATE_QUERY", 1, 0), (has(questions.STATS), "STATS_QUERY", 1, 0), (has(questions.DOMAIN), "DOMAIN_QUERY", 1, 1), ("n <= 3", "OTHER", 0, 0), ("true", "DOMAIN_QUERY", 1, 0)]
    case = lambda k: "CASE " + " ".join(f"WHEN {r[0]} THEN {repr(r[1]) if k == 1 else 'true' if r[k] else 'false'}" for r in rules) + " END"
    near = " OR ".join(f"(starts_with(l, '{w}') AND length(l) <= {len(w) + 5})" for w in questions.SMALLTALK_TERMS)
    small = f"z <> '' AND (l IN {_in(questions.SMALLTALK_TERMS)} OR (l <> '' AND len(list_filter(string_split(l, ' '), lambda v: v NOT IN {_in(questions.SMALLTALK_TERMS)})) = 0) OR {near} OR regexp_matches(f, '^({'|'.join(questions.SMALLTALK_PATTERNS)})$'))"
    return f"WITH a AS (SELECT conv_id, turn, {_PLAIN} AS p, {_LETTERS_ONLY} AS l, {_collapse(_FOLD.replace('{x}', 'lower(coalesce(text, {e}))').replace('{e}', chr(39) * 2))} AS f, {_collapse('coalesce(text, {e})').replace('{e}', chr(39) * 2)} AS z FROM {{table}}), b AS (SELECT *, CASE WHEN p = '' THEN 0 ELSE len(string_split(p, ' ')) END AS n FROM a) SELECT conv_id, turn, {case(1)} AS intent, {case(2)} AS should_retrieve, {case(3)} AS should_partition, {small} AS smalltalk FROM b"


#: Openings that turn the driver's texts into questions of each kind, by the turn's number.
ASKED = ["Hola ", "¿Quién eres? ", "ayuda ", "¿Cuántas interrupciones ", "¿Qué pasó ayer en ", "el promedio de ", "holaaaa", "gracias ", "c0rte de agua en SUNASS ", ""]
_ASKED = "CASE (turn + conv_id) % 10 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(ASKED)) + " END || CASE WHEN conv_id % 3 = 0 THEN coalesce(text, '') ELSE '' END"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    k = (c("turn") + c("conv_id")) % 10
    opening = F.coalesce(*[F.when(k == i, F.lit(v)) for i, v in enumerate(ASKED)])
    return t(spark, d, "conversations").select("conv_id", "turn", F.concat(opening, F.when(c("conv_id") % 3 == 0, F.coalesce("text", F.lit(""))).otherwise("")).alias("text"))


@query(_intent_sql().replace("{table}", f"(SELECT conv_id, turn, {_ASKED} AS text FROM conversations)"))
def intents_of_questions(spark: SparkSession, d: str) -> DataFrame:
    rows = _asked(spark, d)
    return rows.select("conv_id", "turn", questions.intent(c("text")).alias("i"), questions.is_smalltalk(c("text")).alias("smalltalk")).select("conv_id", "turn", "i.*", "smalltalk")


INTENT_SQL = _intent_sql().replace("{table}", "conversations")


@query(f"WITH {URLS} SELECT page_id, ext IN {_in(urls.BINARY)} AS binary, contains(lower(url), 'facebook.com') OR contains(lower(url), 'fb.com') AS facebook, nullif(regexp_extract('consolidated_' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') || '012024.json', '([0-9]{{8}})', 1), '') AS day, page_id % 28 < 27 AS is_day, lpad((page_id % 28 + 1)::VARCHAR, 2, '0') || '/01/2024 10:00:00' AS shown FROM x")
def url_and_day_rules(spark: SparkSession, d: str) -> DataFrame:
    two = F.lpad((c("page_id") % 28 + 1).cast("string"), 2, "0")
    day = dates.date_in_name(F.concat(F.lit("consolidated_"), two, F.lit("012024.json")))
    valid = dates.is_day(F.when(c("page_id") % 28 < 27, day).otherwise("31022024"))
    return t(spark, d, "pages").select("page_id", urls.is_binary(c("url")).alias("binary"), urls.is_facebook(c("url")).alias("facebook"), day.alias("day"), valid.alias("is_day"), dates.shown_time(F.concat(F.lit("2024-01-"), two, F.lit("T10:00:00"))).alias("shown"))


@query("WITH d AS (SELECT text, unnest(generate_series(0, 2)) AS k FROM documents) SELECT k::INTEGER AS k, count(*) AS n, count(DISTINCT text) AS kinds FROM d GROUP BY k")
def texts_by_day(spark: SparkSession, d: str) -> DataFrame:
    days = dates.days_between(F.lit("2024-01-30").cast("date"), F.lit("2024-02-01").cast("date"))
    rows = t(spark, d, "documents").select("text", F.posexplode(days).alias("k", "day"))
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("text").alias("kinds"))


@query("SELECT role, count(*) AS n, string_agg('- **' || role || ':** ' || k, '|') AS listed FROM (SELECT role, count(*) AS k FROM conversations GROUP BY role) GROUP BY role")
def markdown_figures(spark: SparkSession, d: str) -> DataFrame:
    per = t(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("k"))
    listed = F.regexp_replace(writers.markdown_stats(F.create_map(c("role"), c("k"))), r"\*\*([A-Z])", "**$1")
    return per.groupBy("role").agg(F.count("*").alias("n"), F.first(F.concat(F.lit("- **"), c("role"), F.lit(":** "), F.element_at(F.split(listed, ":\\*\\* "), 2))).alias("listed"))


# ---- chunks --------------------------------------------------------------------------------------------------------------------

_SENTENCES = f"string_split(regexp_replace(coalesce(text, ''), '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))"
SENTENCES_SQL = f"""WITH RECURSIVE s AS (SELECT doc_id, coalesce(text, '') AS text, {_SENTENCES} AS ss FROM documents),
r(doc_id, ss, i, now, done) AS (SELECT doc_id, ss, 1, '', NULL::VARCHAR FROM s WHERE length(text) > 512
UNION ALL SELECT doc_id, ss, i + 1, CASE WHEN now <> '' AND length(now) + length(ss[i]) > 512 THEN array_to_string(list_slice(list_filter(regexp_split_to_array(now, '{WS}+'), lambda v: v <> ''), -20, -1), ' ') || ' ' || ss[i] WHEN now <> '' THEN now || ' ' || ss[i] ELSE ss[i] END,
 CASE WHEN now <> '' AND length(now) + length(ss[i]) > 512 THEN now END FROM r WHERE i <= len(ss)),
o AS (SELECT doc_id, i, 0 AS k, done AS chunk FROM r WHERE done IS NOT NULL UNION ALL SELECT doc_id, i, 1, now FROM r WHERE i = len(ss) + 1 AND now <> '' UNION ALL SELECT doc_id, 1, 0, text FROM s WHERE length(text) BETWEEN 1 AND 512)
SELECT o.doc_id, (row_number() OVER (PARTITION BY o.doc_id ORDER BY o.i, o.k) - 1)::INTEGER AS chunk_index, CASE WHEN length(s.text) > 512 THEN regexp_replace(o.chunk, '^{WS}+|{WS}+$', '', 'g') ELSE o.chunk END AS chunk FROM o JOIN s USING (doc_id)"""
catalog.ORACLE["chunk_sentences"] = SENTENCES_SQL
catalog.ORACLE["intent_router"] = INTENT_SQL

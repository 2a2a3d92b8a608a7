"""Readers: consolidated documents by date, link lists, lines, HTML, bulletin blocks, files as bytes; boundaries are pluggable functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, timedelta
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.dates import date_in_name
from tidewire.functions.text import brief_description, clean_paragraph, collapse, holds_email, is_header, strip_all, urls_in

from .schemas import DOCUMENT

#: Elements that hold no text of their own.
DROPPED = ("script", "style", "header", "footer", "nav", "aside", "form")
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's own file systems find the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Documents with file and day (from the file's name). Whole files are one JSON value each."""
    if not paths:
        return spark.createDataFrame([], f"{DOCUMENT}, file string, day string")
    df = spark.read.schema(DOCUMENT).option("multiLine", True).json(paths)
    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return df.withColumn("file", file).withColumn("day", date_in_name(F.col("file")))


def documents_of_days(spark: SparkSession, clean_dir: str, consolidated_dir: str, days: list[date]) -> DataFrame:
    """Of each day the clean document, or the consolidated one; days with neither are left out."""
    paths = []
    for d in days:
        name = d.strftime("%d%m%Y")
        found = next((p for p in (f"{clean_dir}/clean_{name}.json", f"{consolidated_dir}/consolidated_{name}.json") if _exists(spark, p)), None)
        if found:
            paths.append(found)
    return read_documents(spark, paths)


def day_list(first: date, last: date) -> list[date]:
    return [first + timedelta(n) for n in range((last - first).days + 1)]


def yesterday(today: date) -> str:
    """The default day, ddmmyyyy."""
    return (today - timedelta(1)).strftime("%d%m%Y")


def read_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON file that is an array of them or an object with them under content."""
    whole = spark.read.text(path, wholetext=True)
    items = F.coalesce(F.from_json("value", f"struct<content:array<struct<{schema}>>>")["content"], F.from_json("value", f"array<struct<{schema}>>"))
    return whole.select(F.inline(items))


def read_links(spark: SparkSession, path: str, by_position: bool = False) -> DataFrame:
    """A CSV of links by its header, rows without URL left out; by_position: the second column, where it starts with http."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if by_position:
        return df.select(F.col(df.columns[1]).alias("URL")).where(F.col("URL").startswith("http"))
    return df.where(F.coalesce(F.trim("URL"), F.lit("")) != "")


def read_csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The CSV, or an empty frame where there is none."""
    return spark.read.csv(path, header=True, schema=schema) if _exists(spark, path) else spark.createDataFrame([], schema)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank, trimmed."""
    return spark.read.text(path).select(strip_all(F.col("value")).alias("line")).where("line != ''")


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of files below path, with their kind."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return df.withColumn("kind", file_kind(F.col("content"), F.col("path")))


def landed(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """A stream of files that land in a folder, each once: path, modificationTime, length, content. What an upload puts there is read by the next batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)


def file_kind(content: Column, path: Column) -> Column:
    """MIME type by first bytes, else by extension, else octet-stream."""
    head = F.hex(F.substring(content, 1, 12))
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E47"), "image/png")
        .when(head.startswith("47494638"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(head.startswith("424D"), "image/bmp")
        .when(head.startswith("25504446"), "application/pdf")
        .when(ext.isin("jpg", "jpeg"), "image/jpeg")
        .when(ext.isin("png", "gif", "webp", "bmp"), F.concat(F.lit("image/"), ext))
        .when(ext == "pdf", "application/pdf")
        .otherwise("application/octet-stream")
    )


def content_hash(content: Column, edge: int = 65536) -> Column:
    """md5 of head, tail and size: equal for equal files, cheap for large ones."""
    n = F.octet_length(content)
    return F.md5(F.concat(F.substring(content, 1, edge), F.when(n > edge, F.substring(content, -edge, edge)).otherwise(F.lit(b"")), F.encode(n.cast("string"), "utf-8")))


class _Text(HTMLParser):
    """Text outside DROPPED elements, title and description."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title, self.description = [], ""
        self.skip, self.in_title = 0, False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in DROPPED:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "meta" and not self.description:
            a = dict(attrs)
            if "description" in (a.get("name") or "").lower():
                self.description = (a.get("content") or "").strip()

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        if not self.skip and data.strip():
            self.parts.append(data.strip())


def html_fields_of(html: str) -> tuple[str, str, str]:
    """(text, title, description) of a page."""
    p = _Text()
    p.feed(html)
    p.close()
    return " ".join(" ".join(p.parts).split()), "".join(p.title).strip(), p.description


# types as objects: text forms are parsed by the JVM, which a worker that imports this doesn't have
@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("text", "title", "description")]))
def html_fields(s: pd.Series) -> pd.DataFrame:
    """html_fields_of by rows; nulls give empty fields."""
    return pd.DataFrame([html_fields_of(x) for x in s.fillna("")], columns=["text", "title", "description"])


def html_text_plain(c: Column) -> Column:
    """The text of a page by patterns alone: comments, dropped elements and tags go, the rest is collapsed; entities stay."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<!--.*?-->", " ")
    for tag in DROPPED:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return collapse(F.regexp_replace(t, r"(?s)<[^>]*>", " "))


def bulletin_sections(blocks: DataFrame) -> DataFrame:
    """file, section, page, block_no, text, description, url from blocks (file, page, block_no, text) of a bulletin.

    A block that looks like a header opens a section, which carries on over pages until the next; paragraphs with an e-mail
    address are left out. The window is per file, so files are read in parallel.
    """
    t = strip_all(F.col("text"))
    rows = blocks.withColumn("_t", t).where("_t != ''").withColumn("_h", is_header(F.col("_t")))
    w = Window.partitionBy("file").orderBy("page", "block_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("section", F.coalesce(F.last(F.when(F.col("_h"), F.col("_t")), ignorenulls=True).over(w), F.lit("CONTENIDO_INICIAL")))
    body = placed.where(~F.col("_h")).withColumn("text", clean_paragraph(F.col("_t"))).where((F.col("text") != "") & ~holds_email(F.col("text")))
    return body.select("file", "section", "page", "block_no", "text", brief_description(F.col("text")).alias("description"), F.coalesce(F.try_element_at(urls_in(F.col("text")), F.lit(1)), F.lit("")).alias("url"))


def fetched(rows: DataFrame, fetch: Callable[[str], dict], key: str, schema: str, batch: int = 20) -> DataFrame:
    """key and fetch(key)'s fields for each different key; a failure is a row with its error. fetch is the boundary to the outside."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for k in pdf[key]:
                try:
                    out.append({key: k, **fetch(k), "error": None})
                except Exception as e:
                    out.append({key: k, "error": f"{type(e).__name__}: {e}"})
            names = [key, *[x.split()[0] for x in schema.split(", ")], "error"]
            yield pd.DataFrame(out, columns=names)

    kind = rows.schema[key].dataType.simpleString()
    return rows.where(F.col(key).isNotNull()).select(key).distinct().mapInPandas(run, f"{key} {kind}, {schema}, error string")


def config(defaults: dict, own: dict) -> dict:
    """own over defaults, sections merged one level deep."""
    return {k: {**v, **own[k]} if isinstance(v, dict) and isinstance(own.get(k), dict) else own.get(k, v) for k, v in defaults.items()} | {k: v for k, v in own.items() if k not in defaults}


def day_paths(base: str, day: str) -> dict[str, str]:
    """Where a day's files lie."""
    return {"pdf": f"{base}/{day}.pdf", "links": f"{base}/output/links_{day}.csv", "consolidated": f"{base}/output/consolidated_{day}.json", "clean": f"{base}/output/clean/clean_{day}.json", "markdown": f"{base}/output/clean/clean_{day}.md"}

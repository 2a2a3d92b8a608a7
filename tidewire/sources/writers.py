"""Writers: JSON, CSV, JSON lines of frames, Markdown, grouped lists."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.text import label_of, markdown_escape


def write_csv(df: DataFrame, path: str) -> bool:
    """df as CSV with a header; nothing, and False, if it is empty."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").csv(path, header=True)
    return True


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_rag(items: DataFrame, path: str) -> None:
    """Items whole, their texts alone, and a reading copy."""
    write_json(items, f"{path}/full")
    write_json(items.select("text"), f"{path}/texts")
    items.select(F.concat_ws("\n", F.concat(F.lit("SOURCE: "), F.col("source")), F.col("text"), F.lit("---")).alias("value")).write.mode("overwrite").text(f"{path}/inspect")


def grouped_list(df: DataFrame, domain: str, url: str) -> DataFrame:
    """domain, n, block: a heading and the domain's different URLs, the largest first."""
    g = df.select(domain, url).distinct().groupBy(domain).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(url)), "\n").alias("urls"))
    return g.select(domain, "n", F.concat(F.lit("== "), F.col(domain), F.lit(" ("), F.col("n").cast("string"), F.lit(" URLs) ==\n"), F.col("urls")).alias("block")).orderBy(F.desc("n"), domain)


def frames(df: DataFrame, order: list[Column], kind: str = "parcial") -> Iterator[str]:
    """JSON lines in order, one per row, streamed from the executors, and a last one."""
    total = 0
    for row in df.orderBy(*order).toLocalIterator(prefetchPartitions=True):
        total += 1
        yield json.dumps({"rol": "assistant", "tipo": kind, **row.asDict(recursive=True)}, ensure_ascii=False, default=str) + "\n"
    yield json.dumps({"rol": "assistant", "tipo": "final", "total": total}, ensure_ascii=False) + "\n"


#: Headings of the report.
HEADINGS = {"pdf": "## Contenido de PDF", "html": "## Contenido de Páginas Web", "image": "## Contenido de Imágenes", "facebook": "## Contenido de Redes Sociales"}


def markdown_item(source: Column, key: Column, title: Column, text: Column, page: Column, relevance: Column) -> Column:
    """One entry of the report."""
    body = F.when(F.coalesce(text, F.lit("")) != "", F.concat(markdown_escape(text), F.lit("\n\n"))).otherwise("")
    link = F.concat(F.lit("**URL:** ["), key, F.lit("]("), key, F.lit(")\n\n"))
    shown = F.when(F.coalesce(relevance, F.lit(0.0)) != 0, F.concat(F.lit("**Relevancia:** "), relevance.cast("string"), F.lit("\n\n"))).otherwise("")
    on_page = F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit("*Página: "), page.cast("string"), F.lit("*\n\n"))).otherwise("")
    end = F.lit("---\n\n")
    return (
        F.when(source == "pdf", F.when(body != "", F.concat(body, on_page, end)).otherwise(""))
        .when(source == "html", F.concat(F.lit("### "), F.coalesce(title, F.lit("Sin título")), F.lit("\n\n"), link, shown, body, end))
        .when(source == "image", F.concat(F.lit("### Imagen: "), F.coalesce(title, key), F.lit("\n\n"), link, body, end))
        .otherwise(F.concat(F.lit("### Publicación\n\n**Fuente:** "), key, F.lit("\n\n"), body, end))
    )


def markdown_sections(texts: DataFrame, order: str = "ord") -> DataFrame:
    """source, section, n, markdown: each section's entries in order. texts: ord, source, section, source_key, title, text, page, relevance_score."""
    item = markdown_item(F.col("source"), F.col("source_key"), F.col("title"), F.col("text"), F.col("page"), F.col("relevance_score"))
    g = texts.groupBy("source", F.when(F.col("source") == "pdf", F.col("section")).alias("section")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("m")))).alias("ms"))
    head = F.when(F.col("source") == "pdf", F.concat(F.lit("### "), F.col("section"), F.lit("\n\n"))).otherwise("")
    return g.select("source", "section", "n", F.concat(head, F.array_join(F.transform("ms", lambda x: x["m"]), "")).alias("markdown"))


def markdown_stats(stats: Column) -> Column:
    """A map of figures as a list."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(stats)), lambda e: F.concat(F.lit("- **"), label_of(e["key"]), F.lit(":** "), e["value"].cast("string"))), "\n")


def markdown_report(sections: DataFrame) -> DataFrame:
    """One row, markdown: the whole report. sections are a few rows, one per source and bulletin section."""
    order = F.when(F.col("source") == "pdf", 0).when(F.col("source") == "html", 1).when(F.col("source") == "image", 2).otherwise(3)
    head = F.when(F.col("source") == "pdf", HEADINGS["pdf"]).when(F.col("source") == "html", HEADINGS["html"]).when(F.col("source") == "image", HEADINGS["image"]).otherwise(HEADINGS["facebook"])
    per = sections.groupBy(order.alias("o"), head.alias("h")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "markdown"))), lambda x: x["markdown"]), "").alias("m"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h", "m"))), lambda x: F.concat(x["h"], F.lit("\n\n"), x["m"])), "")
    return per.agg(F.concat(F.lit("# Informe de Noticias\n\n"), body).alias("markdown"))


def write_progress(spark: SparkSession, path: str, progress: int, status: str = "processing") -> None:
    """A run's progress as one small JSON file, replaced as a whole, in any file system of Spark's."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(conf).create(at, True)
    try:
        out.write(bytearray(json.dumps({"progress": progress, "status": status}).encode()))
    finally:
        out.close()


def decoded_files(df: DataFrame, name: Column, encoded: Column) -> DataFrame:
    """name, content, size of base64 texts, a page's capture as PDF among them; what is no base64 has null content."""
    return df.select(name.alias("name"), F.try_to_binary(encoded, F.lit("base64")).alias("content")).withColumn("size", F.octet_length("content"))


def converted_files(df: DataFrame, content: str, convert: Callable[[bytes], bytes]) -> DataFrame:
    """df plus converted (bytes) and error: convert(content), the boundary to an image or PDF library, row by row; a failure is a row with its error."""
    kind = T.StructType([T.StructField("converted", T.BinaryType()), T.StructField("error", T.StringType())])

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            try:
                rows.append((None if x is None else convert(x), None))
            except Exception as e:
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["converted", "error"])

    return df.withColumn("_c", run(F.col(content))).select(*df.columns, "_c.*")

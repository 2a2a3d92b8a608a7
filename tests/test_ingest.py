"""From JSON documents to texts, points, reports and back."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidewire.plans import ingest
from tidewire.sources import readers, writers
from tidewire.sources.schemas import BLOCKS, HTML_PAGE

LONG = "La autoridad informó que el servicio de agua potable vuelve mañana a toda la ciudad"
DOC = {
    "metadata": {"source_pdf": "14072025.pdf", "processing_date": "x", "stats_summary": {"run_timestamp": "2025-07-24T10:59:42", "total_urls_in_pdf": 51, "html_processing": {"processed": 2}, "timings_seconds": {"pdf_extraction": 0.77}}},
    "extracted_content": {
        "pdf_paragraphs": {"CONTENIDO_INICIAL": [{"metadata": {"description": "d", "url": "u"}, "text": LONG, "page": 1}, {"text": " "}], "SECTOR": [{"text": LONG + " dos", "page": 2}]},
        "html_pages": {"https://a.pe": {"metadata": {"title": "Un título", "description": "Una descripción que dice bastante"}, "text": LONG + " web", "relevance": 0.7}, "https://b.pe": {"metadata": {"title": "OneDrive"}, "text": LONG}},
        "image_texts": {"i1": {"image_filename": "a.png", "extracted_text": LONG + " imagen"}, "i2": {"error": "x", "extracted_text": LONG}},
        "facebook_texts": {"https://fb.com/1": {"extracted_text": "Interrupción: " + LONG}},
    },
}


def docs(spark, tmp_path):
    (tmp_path / "clean").mkdir(exist_ok=True)
    (tmp_path / "clean/clean_14072025.json").write_text(json.dumps(DOC, indent=1))
    return readers.documents_of_days(spark, str(tmp_path / "clean"), str(tmp_path), readers.day_list(dt.date(2025, 7, 13), dt.date(2025, 7, 15)))


def test_texts_items_points(spark, tmp_path):
    d = docs(spark, tmp_path)
    assert {(r["source"], r["n"]) for r in ingest.texts_of(d).groupBy("source").agg(F.count("*").alias("n")).collect()} == {("pdf", 2), ("html", 2), ("image", 1), ("facebook", 1)}
    items = {r["source_key"]: r["text"] for r in ingest.clean_items(d).collect()}
    assert items["https://a.pe"].startswith("Una descripción que dice bastante\n\n") and "https://b.pe" not in items
    points = ingest.points_of(d).collect()
    assert sorted(p["source_type"] for p in points) == ["facebook", "html", "html", "image", "pdf_paragraph"]
    assert {p["event_type"] for p in points if p["source_type"] == "facebook"} == {"interrupcion"} and {p["date_month"] for p in points} == {"072025"}
    s = ingest.stats_of(d).first()
    assert (s["total_urls"], s["html_processed"], s["time_pdf_extraction"], s["facebook_extracted"]) == (51, 2, 0.77, 0)


def test_representatives_and_posts(spark, tmp_path):
    d = docs(spark, tmp_path)
    only = ingest.only_representatives(d, ingest.texts_of(d).where("source != 'html'"))
    c = only.first()["extracted_content"]
    assert c["html_pages"] == {} and set(c["pdf_paragraphs"]) == {"CONTENIDO_INICIAL", "SECTOR"} and len(c["pdf_paragraphs"]["CONTENIDO_INICIAL"]) == 1
    posts = spark.createDataFrame([("clean_14072025.json", "https://fb.com/2", "Hola\nmundo", None, "x")], "file string, url string, extracted_text string, pdf_path string, processed_date string")
    merged = ingest.merge_facebook(d, posts).first()["extracted_content"]["facebook_texts"]
    assert list(merged) == ["https://fb.com/2"] and ingest.post_titles(posts).first()["title"] == "Hola"


def test_long_post_stays_whole(spark, tmp_path):
    posts = spark.createDataFrame([("clean_14072025.json", "https://fb.com/2", "agua " * 200_001 + "fin", None, "x")], "file string, url string, extracted_text string, pdf_path string, processed_date string")
    text = F.col("extracted_content.facebook_texts")["https://fb.com/2"]["extracted_text"]
    r = ingest.merge_facebook(docs(spark, tmp_path), posts).select(F.length(text).alias("n"), F.right(text, F.lit(3)).alias("end")).first()
    assert (r["n"], r["end"]) == (1_000_008, "fin")
    assert ingest.post_titles(posts).select(F.length("excerpt")).first()[0] == 1000


def test_report(spark, tmp_path):
    rows = ingest.texts_of(docs(spark, tmp_path)).withColumn("ord", F.monotonically_increasing_id())
    md = writers.markdown_report(writers.markdown_sections(rows)).first()["markdown"]
    assert md.index("## Contenido de PDF") < md.index("## Contenido de Páginas Web") < md.index("## Contenido de Imágenes") < md.index("## Contenido de Redes Sociales")
    assert "**Relevancia:** 0.7" in md and "### Imagen: a.png" in md and "*Página: 2*" in md


def test_bulletin_sections(spark):
    blocks = spark.createDataFrame([("f", 1, 0, "Hola mundo"), ("f", 1, 1, "SECTOR"), ("f", 2, 0, "Ver https://a.pe/x más"), ("f", 2, 1, "escriba a x@y.pe"), ("f", 2, 2, None)], BLOCKS)
    got = readers.bulletin_sections(blocks).orderBy("page", "block_no").collect()
    assert [(r["section"], r["text"], r["url"]) for r in got] == [("CONTENIDO_INICIAL", "Hola mundo", ""), ("SECTOR", "Ver https://a.pe/x más", "https://a.pe/x")]


def test_html_fields():
    page = "<html><head><title>T &amp; x</title><meta name='Description' content=' d '><style>s</style></head><body><nav>n</nav><p>Hola <b>mundo</b></p><script>1</script></body></html>"
    assert readers.html_fields_of(page) == ("T & x Hola mundo", "T & x", "d")


def test_link_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Page,URL,Context\n1,http://a.pe,x\n2,,y\n3,ftp://b,z\n")
    assert [r["URL"] for r in readers.read_links(spark, str(tmp_path / "l.csv")).collect()] == ["http://a.pe", "ftp://b"]
    assert [r["URL"] for r in readers.read_links(spark, str(tmp_path / "l.csv"), by_position=True).collect()] == ["http://a.pe"]
    assert readers.read_csv_or_empty(spark, str(tmp_path / "none.csv"), "a int").count() == 0
    (tmp_path / "a.txt").write_text("x\n\n  y \n")
    assert [r["line"] for r in readers.read_lines(spark, str(tmp_path / "a.txt")).collect()] == ["x", "y"]
    (tmp_path / "i.json").write_text('[{"text": "a"}, {"text": "b"}]')
    (tmp_path / "j.json").write_text('{"content": [{"text": "c"}]}')
    assert readers.read_items(spark, str(tmp_path / "i.json"), "text:string").count() == 2
    assert readers.read_items(spark, str(tmp_path / "j.json"), "text:string").first()["text"] == "c"


def test_binary_and_boundary(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.dat").write_bytes(b"\xff\xd8\xff\xe0rest")
    r = readers.read_binary(spark, str(tmp_path / "b")).withColumn("h", readers.content_hash(F.col("content"))).first()
    assert r["kind"] == "image/jpeg" and len(r["h"]) == 32

    def fetch(u):
        if u == "bad":
            raise OSError("gone")
        return {"text": u.upper()}

    got = readers.fetched(spark.createDataFrame([("a",), ("bad",), ("a",), (None,)], "url string"), fetch, "url", "text string").orderBy("url").collect()
    assert [(r["url"], r["text"], r["error"]) for r in got] == [("a", "A", None), ("bad", None, "OSError: gone")]


def test_frames_and_config(spark):
    lines = list(writers.frames(spark.createDataFrame([(2,), (1,)], "i int"), [F.col("i")]))
    assert [json.loads(x).get("i") for x in lines] == [1, 2, None] and json.loads(lines[-1])["total"] == 2
    assert readers.config({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"x": 5}, "c": 3}) == {"a": {"x": 5, "y": 2}, "b": 1, "c": 3}
    assert readers.yesterday(dt.date(2025, 3, 1)) == "28022025"


def test_page_schema_is_valid(spark):
    assert spark.createDataFrame([], f"x {HTML_PAGE}").schema["x"].dataType["relevance"].dataType.simpleString() == "double"


def test_clean_items_clean_once(spark, tmp_path):
    """Each text is cleaned once, at one place of the plan, and no join brings a page's description."""
    plan = ingest.clean_items(docs(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("artículo anterior") <= 4

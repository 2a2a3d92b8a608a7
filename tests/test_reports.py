"""Composite reports on small fixtures."""

import datetime as dt
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_ingest import docs

from tidewire.functions import media, similarity
from tidewire.operators import fitted
from tidewire.plans import ingest, reports
from tidewire.sources import pdf, writers


def pdf_bytes(compressed):
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >>",
        3: b"<< /Type /Page /Parent 2 0 R /Annots [5 0 R 6 0 R] >>",
        4: b"<< /Type /Page /Parent 2 0 R /Annots 8 0 R >>",
        5: b"<< /Type /Annot /Subtype /Link /Rect [1 2 3 4] /A << /S /URI /URI (https://a.pe/x\\(1\\)) >> >>",
        6: b"<< /Type /Annot /Subtype /Link /Rect [1 2 3 4] /A << /S /URI /URI (mailto:x@y.pe) >> >>",
        7: b"<< /Type /Annot /Subtype /Link /Rect [5 6 7.5 8] /A 9 0 R >>",
        8: b"[7 0 R]",
        9: b"<< /S /URI /URI (http://b.pe) >>",
    }
    if not compressed:
        return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items())
    body, heads = b"", b""
    for n, x in objects.items():
        heads += b"%d %d " % (n, len(body))
        body += x + b" "
    data = zlib.compress(heads + body)
    return b"%%PDF-1.5\n20 0 obj\n<< /Type /ObjStm /N 9 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(heads), len(data), data)


@pytest.mark.parametrize("compressed", [False, True])
def test_pdf_links(spark, compressed):
    files = spark.createDataFrame([("a.pdf", bytearray(pdf_bytes(compressed))), ("b.pdf", bytearray(b"broken")), ("c.pdf", None)], "path string, content binary")
    got = pdf.read_links(files).orderBy("Page").collect()
    assert [(r["file"], r["Page"], r["URL"], tuple(r["Rect"])) for r in got] == [("a.pdf", 1, "https://a.pe/x(1)", (1.0, 2.0, 3.0, 4.0)), ("a.pdf", 2, "http://b.pe", (5.0, 6.0, 7.5, 8.0))]
    blocks = pdf.read_blocks(files, lambda raw: [(1, 0, str(len(raw)))])
    assert blocks.count() == 3


def test_run_day(spark, tmp_path):
    links = spark.createDataFrame([(1, "https://facebook.com/a"), (2, "https://facebook.com/a"), (3, "https://rpp.pe/noticias/x"), (4, "https://old.pe")], "Page int, URL string")
    day = reports.run_day(docs(spark, tmp_path), links, spark.createDataFrame([("https://old.pe",)], "URL string"))
    assert sorted((r["URL"], r["category"]) for r in day.links.collect()) == [("https://facebook.com/a", "social"), ("https://rpp.pe/noticias/x", "html")]
    stats = day.stats.first()
    assert stats["original_texts"] == 6 and stats["representative_texts"] == day.texts.count() < 6
    assert day.documents.count() == 1 and day.markdown.first()["markdown"].startswith("# Informe")
    assert {(r["category"], r["n"]) for r in day.categories.where("level = 1").collect()} == {("social", 1), ("html", 1)}


def test_dashboard_and_context(spark, tmp_path):
    d = docs(spark, tmp_path)
    points = ingest.points_of(d)
    parts = reports.dashboard_parts(points, ingest.stats_of(d))
    assert parts["events"].count() == 1 and parts["pages"].count() == 2 and parts["news"].count() == 1 and parts["supervision"].count() == 0
    totals = parts["totals"].first()
    assert (totals["n"], totals["total_total_urls"], totals["avg_time_pdf_extraction"], totals["last_run"]) == (1, 51, 0.77, "2025-07-24 05:59:42")
    vectors = points.withColumn("embedding", F.when(F.col("source_type") == "html", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.6), F.lit(0.8))))
    for asked, n in (("del 1 de julio al 20 de julio de 2025", 4), ("14 de julio de 2025", 4), ("julio 2025", 4), ("13 de julio de 2025", 0), ("hola", 4), ("interrupción del 14-07-2025", 1)):
        context = reports.context_for(spark, vectors, asked, [1.0, 0.0])
        assert context.count() == n, asked
    context = reports.context_for(spark, vectors, "julio 2025", [1.0, 0.0])
    assert context.orderBy("rank").first()["similarity"] == 1.0
    assert reports.answer_parts(context, 4).agg(F.max("block"), F.count("*")).first()[:] == (2, 4)
    answer = reports.count_answer(context, "cuántas interrupciones hubo").first()
    assert (answer["event"], answer["n"], answer["plural"], len(answer["examples"])) == ("interrupcion", 1, "interrupciones", 1)
    numbered = points.withColumn("day_num", F.lit(None).cast("int"))
    assert reports.nearest_day(numbered, "day_num", "date_day", F.lit(dt.date(2025, 7, 14)), F.lit(dt.date(2025, 7, 14))).count() == points.count()


def test_link_report_and_preselection(spark):
    links = spark.createDataFrame([(0, "https://rpp.pe/1", "corte de agua en piura por obras"), (1, "https://rpp.pe/2", "Corte de agua  en piura por obra"), (2, "https://a.pe", "otra cosa")], "ord long, url string, body string")
    report = reports.link_report(links, "url", "body", "ord")
    assert {(r["category"], r["n"]) for r in report["categories"].collect()} == {("news", 2), ("other", 1)}
    assert tuple(report["stats"].first()) == (3, 2, 1, 33.33)
    history = spark.createDataFrame([("https://a.pe", "texto"), ("https://rpp.pe/1", "")], "url string, text string")
    assert sorted((r["ord"], r["preselected"]) for r in reports.preselected(links, history).collect()) == [(0, True), (1, True), (2, False)]


def test_pair_decision(spark):
    rows = spark.createDataFrame([("m.a.pe", "a.pe", True, "hola mundo", "hola mundo"), ("a.com", "b.com", True, "x", "x"), ("a.pe", "a.pe", False, "x", "x"), ("a.pe", "a.pe", True, "", "x"), ("a.pe", "a.pe", True, "", "")], "h1 string, h2 string, ok boolean, t1 string, t2 string")
    side = lambda h, t: {"host": F.col(h), "success": F.col("ok"), "text": F.col(t), "title": F.lit(None).cast("string")}
    got = [tuple(r["d"]) for r in rows.select(reports.pair_decision(side("h1", "t1"), side("h2", "t2"), F.lit(0.85)).alias("d")).collect()]
    assert got == [(True, 1.0, None), (False, 0.0, "Dominios diferentes"), (False, 0.0, "Fallo en extracción de primera URL"), (False, 0.0, "Solo una URL tiene contenido"), (False, 0.0, "Sin contenido para comparar")]


def test_topics(spark):
    items = spark.createDataFrame([(0, "html", "El agua potable y el desagüe de la planta de tratamiento", 0.9), (1, "pdf", "El agua potable y el desagüe de la planta de tratamiento", 1.0), (2, "facebook", "Ministerio de economía y vivienda con presupuesto", 0.4)], "ord long, source string, text string, relevance_score double")
    got = {r["ord"]: (r["topic"], r["merged_from"]) for r in reports.by_topic(items).collect()}
    assert got == {0: ("agua_saneamiento", ["html", "pdf"]), 2: ("politica_economia", ["facebook"])}


def test_topic_threshold(spark):
    def pair(first, a, b, shared, own):
        word = lambda k: f"x{chr(97 + first)}{chr(97 + k // 26)}{chr(97 + k % 26)}palabra"
        both = [word(k) for k in range(shared)]
        return [(first + i, s, " ".join(both + [word(shared + own * i + k) for k in range(own)]), 0.9) for i, s in enumerate((a, b))]

    # each text weighed once: cosines 0.692, 0.692 and 0.627
    items = [*pair(0, "pdf", "html", 10, 3), *pair(2, "facebook", "facebook", 10, 3), *pair(4, "pdf", "html", 20, 8)]
    rows = spark.createDataFrame(items, "ord long, source string, text string, relevance_score double")
    got = sorted((r["merged_from"], r["source"]) for r in reports.by_topic(rows).collect())
    assert got == [(["facebook", "facebook"], "facebook"), (["html"], "html"), (["html", "pdf"], "html"), (["pdf"], "pdf")]
    pages = spark.createDataFrame([(0, "html", "agua potable", 0.29), (1, "html", "corte de luz", 0.3), (2, "html", "otra nota", None), (3, "pdf", "sin relevancia", None)], "ord long, source string, text string, relevance_score double")
    assert sorted(r["ord"] for r in reports.by_topic(pages).collect()) == [1, 3]


def test_census(spark):
    spark.range(3).createOrReplaceTempView("census_three")
    assert ("census_three", 3) in [tuple(r) for r in reports.table_census(spark).collect()]
    assert reports.column_census(spark).where("table = 'census_three' and column = 'id'").count() == 1
    spark.catalog.dropTempView("census_three")


def test_link_context(spark):
    links = spark.createDataFrame([("a", 1, "http://x", (100.0, 100.0, 120.0, 110.0)), ("a", 2, "http://y", (0.0, 0.0, 1.0, 1.0)), ("a", 1, "http://z", (100.0, 300.0, 120.0, 310.0))], "file string, Page int, URL string, Rect struct<x0:double,y0:double,x1:double,y1:double>")
    words = spark.createDataFrame([("a", 1, 2, 105.0, 100.0, 115.0, 110.0, "aquí"), ("a", 1, 1, 72.0, 92.0, 90.0, 99.0, "ver "), ("a", 1, 0, 10.0, 100.0, 69.0, 110.0, "lejos"), ("a", 1, 3, 105.0, 121.0, 115.0, 130.0, "abajo"), ("b", 2, 0, 0.0, 0.0, 1.0, 1.0, "otro")], "file string, page int, no int, x0 double, y0 double, x1 double, y1 double, word string")
    got = {r["URL"]: r["Context"] for r in pdf.link_context(links, words).collect()}
    assert got == {"http://x": "ver aquí", "http://y": "", "http://z": ""}


def test_store_info(spark):
    spark.range(4).createOrReplaceTempView("stored_four")
    assert reports.store_info(spark, "stored_four", "1.0").first()[1:] == ("1.0", 4) and reports.store_info(spark, "no_such_table").first()[:] == ("Error", "Error", 0)
    spark.catalog.dropTempView("stored_four")


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "aGVsbG8="), ("b", "%%"), ("c", None)], "n string, e string")
    files = writers.decoded_files(rows, F.col("n"), F.col("e"))
    assert {r["name"]: (r["content"], r["size"]) for r in files.collect()} == {"a": (b"hello", 5), "b": (None, None), "c": (None, None)}

    def convert(raw):
        if raw == b"hello":
            return b"%PDF" + raw
        raise ValueError("no image")

    more = files.unionByName(spark.createDataFrame([("d", bytearray(b"x"), 1)], "name string, content binary, size int"))
    assert {r["name"]: (r["converted"], r["error"]) for r in writers.converted_files(more, "content", convert).collect()} == {"a": (b"%PDFhello", None), "b": (None, None), "c": (None, None), "d": (None, "ValueError: no image")}
    writers.write_progress(spark, str(tmp_path / "p.json"), 40)
    writers.write_progress(spark, str(tmp_path / "p.json"), 100, "done")
    assert (tmp_path / "p.json").read_text() == '{"progress": 100, "status": "done"}'


def test_media(spark):
    rows = spark.createDataFrame([("image/png", "http://a/x", "Timeout here", 4000, 3000), ("audio/mpeg", "http://a/x.JPEG?q", "bad", 100, 50), (None, None, None, 2000, 5000)], "t string, u string, e string, w int, h int")
    got = rows.select(media.media_extension(F.col("t"), F.col("u")).alias("x"), media.error_ttl(F.col("e"), 60).alias("ttl"), media.fitted(F.col("w"), F.col("h")).alias("f"), media.media_name(F.lit(1), F.col("u"), F.lit("01012025"), F.lit(".jpg")).alias("n"), media.within_area(F.col("w"), F.col("h"), 1_000_000).alias("a")).collect()
    assert [(r["x"], r["ttl"], tuple(r["f"])) for r in got] == [(".png", media.PERMANENT_SECONDS, (2500, 1875)), (".jpg", 3600, (100, 50)), (".jpg", 60, (1000, 2500))]
    assert got[0]["n"].startswith("img_1_") and all(r["a"]["width"] * r["a"]["height"] <= 1_000_000 for r in got)
    assert media.bounded_settings(9, 5) == (5, 10)
    assert rows.select(media.prompt_for(F.col("t"), {"image/png": "a"}, "z").alias("p"), media.backoff_seconds(F.lit(3)).alias("b")).first()[:] == ("a", 8)


def test_link_categories_compare_no_texts(spark, monkeypatch):
    monkeypatch.setattr(reports.dedup, "leader_cluster", lambda *a, **k: pytest.fail("texts are compared"))
    links = spark.createDataFrame([(0, "https://x.pe/a.pdf", ""), (1, "https://x.pe/a", "")], "ord int, url string, body string")
    report = reports.link_report(links, "url", "body", "ord")
    assert sum(r["n"] for r in report["categories"].collect()) == report.classified.count() == 2


@pytest.mark.parametrize("chunk, heavy, ranked", [(8192, 512, 1 << 18), (30, 8, 25), (17, 4, 1 << 18)])
def test_semantic_groups_against_brute_force(spark, monkeypatch, chunk, heavy, ranked):
    """By one chunk, and by many with few terms compared densely or numbered."""
    for name, value in (("CHUNK", chunk), ("HEAVY", heavy), ("ROWS", 16 if chunk < 100 else 512), ("RANKED", ranked)):
        monkeypatch.setattr(fitted, name, value)
    r = random.Random(chunk)
    words = [f"w{i}" for i in range(60)]
    said = [[words[min(59, int(r.expovariate(0.12)))] for _ in range(r.randint(0, 14))] for _ in range(140)]
    said += [list(x) for x in said[:12]] + [["w0"] * 5000 + ["w1"], [], ["w0"] * 5000]
    r.shuffle(said)
    # far from 0 and more than 53 bits, so that neighbours are equal as doubles
    rows = [((1 << 62) + i, r.choice(["facebook", "pdf", None]), " ".join(w)) for i, w in enumerate(said)]
    got = {x["ord"]: x["component"] for x in reports.semantic_groups(spark.createDataFrame(rows, "ord long, source string, text string").repartition(3), terms=lambda c: F.filter(F.split(c, " "), lambda w: w != "")).collect()}
    leaders, want = [], {}
    for i, source, text in rows:
        need = lambda s, source=source: 0.85 if source == s == "facebook" else 0.7
        want[i] = next((j for j, s, t in leaders if round(similarity.pair_cosine_of(text.split(), t.split()), 6) >= need(s)), i)
        if want[i] == i:
            leaders.append((i, source, text))
    assert got == want and 20 < len(leaders) < 120


def test_semantic_groups_keep_no_pairs(spark, tmp_path):
    """Texts of everyday words are all similar; what is kept for them grows with the texts, not with their pairs."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, "pdf", " ".join(r.sample(words, 34))) for i in range(700)]
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    assert {x["component"] for x in reports.semantic_groups(spark.createDataFrame(rows, "ord long, source string, text string")).collect()} == {0}
    assert size() - before < 3 * sum(len(t) for _, _, t in rows)


@pytest.mark.parametrize("few", [1, 10**9])
def test_similar_blocks(monkeypatch, few):
    """Pairs worked out one by one or by the block, as by the formula; texts of other terms than the frequent ones are told apart by their bound."""
    monkeypatch.setattr(fitted, "FEW", few)
    r = random.Random(3)
    said = [[r.randrange(30) if r.random() < 0.7 else 600 + r.randrange(200) for _ in range(r.randint(1, 60))] for _ in range(60)]
    said += [x + [900] for x in said[:20]]

    def part(texts):
        known = [sorted(set(x)) for x in texts]
        own = [float(sum(x.count(k) ** 2 for k in ks)) for x, ks in zip(texts, known, strict=True)]
        columns = [pa.array(range(len(texts))), pa.array([i % 2 == 0 for i in range(len(texts))]), pa.array(own), pa.array(known, pa.list_(pa.int64())), pa.array([[x.count(k) for k in ks] for x, ks in zip(texts, known, strict=True)], pa.list_(pa.int32()))]
        (one,) = fitted._Vectors(pa.table(columns, names=["id", "post", "own", "k", "c"])).parts(np.arange(len(texts)), 1000)
        return one

    x = part(said)
    got = fitted._similar(x, x, 0.85, 0.7)
    want = [[round(similarity.pair_cosine_of(said[i], said[j]), 6) >= (0.85 if i % 2 == j % 2 == 0 else 0.7) for j in x.ids] for i in x.ids]
    assert got.tolist() == want and 80 < got.sum() < 3000
    alone = part([[0, 1, 2, *range(1000 + 40 * i, 1040 + 40 * i)] for i in range(60)])
    monkeypatch.setattr(fitted, "_reached", lambda *a: pytest.fail("worked out"))
    assert not fitted._similar(alone, part([[0, 1, 2, *range(9000 + 40 * i, 9040 + 40 * i)] for i in range(60)]), 0.85, 0.7).any()

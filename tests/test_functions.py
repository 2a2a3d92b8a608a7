"""Micro-fixtures with results derived by hand from the rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates, questions, similarity, text, urls


def values(spark, function, given):
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, x string").select("i", function(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_text_normal_forms(spark):
    assert values(spark, text.normalize_for_similarity, ["Visita https://a.pe/x1 ¡Año 2025!  Agua_potable.", None, ""]) == ["visita año agua_potable", "", ""]
    assert values(spark, text.normalize_for_topics, ["<b>Año</b> 2025, www.a.pe\n\nFin"]) == ["año 2025 fin"]
    assert values(spark, text.clean_boilerplate, ["Iniciar sesión", "OneDrive", None, "Me gusta el agua potable de la ciudad", "corto"]) == ["", "", "", "el agua potable de la ciudad", ""]
    assert values(spark, text.whitespace_lower, ["  Hola \t Mundo ", None]) == ["hola mundo", ""]
    assert values(spark, text.brief_description, ["Jueves, 22 de mayo de 2025 sale", "uno dos", "https://a.pe/x uno"]) == ["Jueves, 22 de mayo de...", "uno dos", "uno"]
    assert values(spark, text.plain_for_intent, ["Holaaaa!", "¿Cuántas?", "h0l4"]) == ["holaa", "cuantas", "hola"]
    assert values(spark, text.markdown_escape, ["a#b *c*  `d` <e>"]) == [r"a\#b \*c\* \`d\` \<e\>"]
    assert values(spark, text.char_ngrams, ["abcd", "ab", None]) == [["abc", "bcd"], [], []]
    assert values(spark, text.title_of, ["\n  \n Primera \nSegunda", "x" * 71, None]) == ["Primera", "x" * 70 + "...", ""]


def test_headers_and_emails(spark):
    assert values(spark, text.is_header, ["NORMAS LEGALES", "politica / economia", "ALERTAS DEL DÍA", "Texto normal", "A@B CDEFG", "ABC", None]) == [True, True, True, False, False, False, False]
    assert values(spark, text.holds_email, ["escriba a x@y.pe", "nada", None]) == [True, False, False]


URLS = ["https://www.facebook.com/watch/?v=1", "https://m.youtube.com/x", "http://x.pe/wp-content/uploads/a.jpg", "https://x.pe/a.PDF", "https://www.gob.pe/sunass/normas", "https://rpp.pe/noticias/x", "https://x.pe/audiolibro", "https://x.pe/media/x", "notaurl", ""]


def test_url_classes(spark):
    two = [(r["category"], r["subcategory"]) for r in values(spark, urls.classify_two_level, URLS)]
    assert two == [("social", "facebook"), ("social", "youtube"), ("images", "jpg"), ("html", "documents"), ("html", "government"), ("html", "news"), ("audio", "other_audio"), ("html", "other_html"), ("invalid", None), ("invalid", None)]
    assert values(spark, urls.classify_one_level, URLS) == ["facebook", "youtube", "image", "document", "document", "news", "other", "other", "other", "invalid"]
    assert values(spark, urls.classify_bucket, URLS) == ["social", "social", "images", "html", "html", "html", "html", "images", None, None]


def test_url_helpers(spark):
    assert values(spark, urls.signature, ["https://a.pe/2025/04/nota-12.html"]) == ["a.pe:N:N:nota-N.html"]
    assert values(spark, urls.base_domain, ["m.a.b.com", "localhost"]) == ["b.com", "localhost"]
    assert values(spark, urls.cache_key, ["https://a.pe/1"]) == ["4f3c77773bc567e5d2d2d0f970522fb3"]
    assert values(spark, urls.short_key, ["https://a.pe/1"]) == ["c636cb69f9220bcc"]
    info = values(spark, urls.domain_info, ["https://www.sunass.gob.pe/x", "http://a.com:80/", "http://localhost/"])
    assert [tuple(r) for r in info] == [("www", "sunass", "gob.pe"), ("", "a", "com"), ("", "localhost", "")]


@pytest.mark.parametrize(
    ("asked", "kind", "first", "last", "value"),
    [
        ("del 1 de enero al 5 de febrero de 2025", "rango", "01012025", "05022025", None),
        ("desde el 3 de marzo de 2024 hasta el 9 de abril", "rango", "03032024", "09042024", None),
        ("desde el mes de enero hasta el mes de febrero", "rango", "01012025", "28022025", None),
        ("enero a marzo de 2024", "rango", "01012025", "31032024", None),
        ("01/2025 al 03/2025", "rango", "01012025", "31032025", None),
        ("01/07/2025 al 15/07/2025", "rango", "01072025", "15072025", None),
        ("12 de mayo", "exacta", None, None, "12052025"),
        ("julio 2024", "mes", None, None, "072024"),
        ("eventos del 12-08-2025", "exacta", None, None, "12082025"),
    ],
)
def test_question_date(spark, asked, kind, first, last, value):
    assert tuple(values(spark, dates.question_date, [asked])[0]) == (kind, first, last, value)


def test_no_question_date(spark):
    assert values(spark, dates.question_date, ["hola", None]) == [None, None]


def test_days(spark):
    assert values(spark, dates.day_number, ["14032025", "31022025", None]) == [20250314, None, None]
    assert values(spark, dates.month_key, ["14032025"]) == ["032025"]
    w = spark.range(1).select(dates.windows(F.lit(dt.date(2025, 1, 1)), F.lit(dt.date(2025, 2, 5)), 10).alias("w")).first()["w"]
    assert [(x["start"].isoformat(), x["end"].isoformat()) for x in w] == [("2025-01-01", "2025-01-10"), ("2025-01-11", "2025-01-20"), ("2025-01-21", "2025-01-30"), ("2025-01-31", "2025-02-05")]
    assert dates.per_window(50, 36, 10) == 30


def test_similarity(spark):
    a, b, c = "corte de agua en piura por obras", "corte de agua en piura por obra", "sunass supervisa calidad del agua"
    assert round(similarity.block_ratio_of(a, b), 6) == 0.984127
    assert round(similarity.block_ratio_of(a, c), 6) == 0.276923
    got = spark.createDataFrame([(a, b), (a, c), ("", "")], "a string, b string").select(F.round(similarity.ngram_jaccard(F.col("a"), F.col("b")), 6), F.round(similarity.block_ratio(F.col("a"), F.col("b")), 6), F.round(similarity.pair_cosine(F.split("a", " "), F.split("b", " ")), 6)).collect()
    assert [tuple(r)[:2] for r in got] == [(0.966667, 0.984127), (0.070175, 0.276923), (1.0, 0.0)]
    assert got[0][2] == round(similarity.pair_cosine_of(a.split(), b.split()), 6)


def test_relevance_events_topics(spark):
    assert [round(x, 6) for x in values(spark, questions.relevance, ["SUNASS regula el agua y saneamiento", "agua alcantarillado saneamiento SUNASS sedapal regulación servicios públicos", ""])] == [0.9, 1.0, 0.0]
    assert values(spark, questions.event_class, ["Corte de agua y denuncia", "reclamo", "monitoreo", "foro", "interrupcion"]) == ["interrupcion", "denuncia", "supervision", None, None]
    assert values(spark, questions.topic, ["sunass y agua", "agua potable", "nada"]) == ["noticias_sunass", "agua_saneamiento", "otros"]
    assert values(spark, questions.plural, ["denuncia", "otro"]) == ["denuncias", "otros"]


def test_intents(spark):
    asked = ["Holaaaa!", "preséntate", "¿Cuántas interrupciones hubo?", "agua hirviendo", "que paso en las mesas de dialogo", None]
    assert [r["intent"] for r in values(spark, questions.intent, asked)][:5] == ["SMALLTALK", "PRESENTACION", "COUNT_QUERY", "SMALLTALK", "DATE_QUERY"]
    assert values(spark, questions.is_smalltalk, ["hola que tal", "muchas gracias", "informe de cortes en piura", None]) == [True, True, False, False]
    assert values(spark, questions.is_count_question, ["Cuántos cortes", "hola"]) == [True, False]


def test_count_char_ngrams(spark):
    given = ["", "ab", "abc", "abcabc", "aaaa", "x😀y😀x😀y", None, "ñandú ñandú"]
    rows = spark.createDataFrame([(t,) for t in given], "t string")
    assert [r[0] for r in rows.select(text.count_char_ngrams(F.col("t"))).collect()] == [len({t[i : i + 3] for i in range(len(t) - 2)}) if t else 0 for t in given]

"""Fields of pages by the kind of site."""

import pytest
from pyspark.sql import functions as F

from tidewire.sources import content

PAGES = {
    "facebook": ('<title>T</title><h3>Ana</h3><abbr title="ayer"></abbr><div class="a userContent">Hola <b>mundo</b></div><a href="/photo.php?x"><img src="i.png"><img src="data:image/x"></a><span data-testid="UFI2CommentsCount/root">12 comentarios</span><div data-testid="UFI2TopReactions/tooltip"><i><span aria-hidden="true">345</span></i></div>', {"title": "T", "author": "Ana", "date": "ayer", "text": "Hola mundo", "images": ["i.png"], "comments": 12, "reactions": 345, "has_images": True, "has_video": False, "login_required": False}),
    "login": ('<head><title>Entrar</title><meta property="og:description" content="Una nota"></head><form action="/login/x"><input name="q"></form><div class="userContent">no</div>', {"title": "Entrar", "text": "Una nota", "login_required": True}),
    "youtube": ('<title>T</title><div id="container"><p><h1>Video</h1></p></div><div id="description">Dice <script>no</script>algo</div><div id="owner-name"><a>Canal</a></div><b class="view-count">7 vistas</b>', {"title": "Video", "text": "Dice algo", "author": "Canal", "views": "7 vistas"}),
    "news": ('<title>T</title><article><h1>Titular</h1><p class="bajada">Resumen</p><div class="content">Cuerpo<img></div><time datetime="2024-01-01"></time><i rel="author">Luz</i></article>', {"title": "Titular", "summary": "Resumen", "text": "Cuerpo", "date": "2024-01-01", "author": "Luz", "has_images": True}),
    "document": ('<body>uno<p>dos</body>', {"text": "uno dos", "pages": 1}),
    "embedded": ('<title>D</title><embed type="application/pdf">', {"text": content.NOT_READABLE, "pages": 0, "title": "D"}),
    "other": ('<main>corto</main><div id="content">el más largo</div><footer>x</footer>', {"text": "el más largo"}),
    "bare": ("<p>sólo <style>p{}</style>esto", {"text": "sólo esto", "title": ""}),
    "image": ("", {"title": "b.png", "author": "a.pe", "text": ""}),
}


@pytest.mark.parametrize("name", PAGES)
def test_fields(name):
    kind = {"login": "facebook", "embedded": "document", "bare": "other"}.get(name, name)
    html, want = PAGES[name]
    got = content.content_of(html, "http://a.pe/x/b.png", kind)
    assert {k: got[k] for k in want} == want and got["error"] is None and set(got) == set(content.FIELDS.names)


def test_selectors():
    p = content.Page('<div class="a b" id="x"><p data-k="one two"><i>1</i></p></div><p>2</p></div>')
    assert [e.text for e in p.find("div.a.b p")] == ["1"] and [e.text for e in p.find('#x [data-k*="two"] i, p')] == ["1", "1", "2"]
    assert not p.has("span, div.c, [data-z]") and p.has('div#x.a, p[data-k="no"]')


def test_contents(spark):
    rows = spark.createDataFrame([("https://facebook.com/1", PAGES["login"][0]), ("https://rpp.pe/a", PAGES["news"][0]), ("http://a.pe", None), (None, "<p>x</p>")], "url string, html string")
    got = {r["url"]: (r["kind"], r["content"]["text"]) for r in content.contents(rows, F.col("url"), F.col("html")).collect()}
    assert got == {"https://facebook.com/1": ("facebook", "Una nota"), "https://rpp.pe/a": ("news", "Cuerpo"), "http://a.pe": ("other", ""), None: ("other", "x")}
    assert content.texts_of_success(content.contents(rows, F.col("url"), F.col("html"))).count() == 3

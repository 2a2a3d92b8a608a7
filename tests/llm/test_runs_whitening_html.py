"""Periodic runs, whitening and main texts against brute force and hand-made cases."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import html_extraction, periodic_runs, queries, whitening


def brute_runs(w, min_length=24, min_exponent=3):
    """(start, length, period) by comparing every pair of places."""
    out = set()
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            if i > s and length >= max(min_length, min_exponent * q) and not any(all(w[x] == w[x + p] for x in range(s, s + length - p)) for p in range(1, q)):
                out.add((s, length, q))
            i += i == s
    return sorted(out, key=lambda x: (x[0], x[2]))


def repetitive(r, size=5):
    """Words of a small vocabulary with stretches that repeat."""
    out = []
    for _ in range(r.randint(0, size)):
        unit = [f"w{r.randrange(r.choice([2, 3, 30]))}" for _ in range(r.randint(1, 14))]
        out += unit * r.randint(1, 6) + unit[: r.randint(0, len(unit))] if r.random() < 0.6 else [f"w{r.randrange(r.choice([1, 2, 5]))}" for _ in range(r.randint(0, 40))]
    return out


@pytest.mark.parametrize("places", [64, 1 << 21])
def test_scan_against_brute_force(monkeypatch, places):
    monkeypatch.setattr(periodic_runs, "PLACES", places)
    r = random.Random(places)
    for _ in range(150):
        least, times = r.choice([8, 24]), r.choice([2, 3])
        texts = [[w.encode() for w in repetitive(r)] for _ in range(3)]
        arrays = [periodic_runs.numbers(t) for t in texts]
        want = [brute_runs(t, least, times) for t in texts]
        assert periodic_runs.scan(arrays, [(1, len(a) + 1) for a in arrays], least, times) == want
        # ranges of lags find the same runs, each by its own range
        for a, w in zip(arrays, want, strict=True):
            lags = len(a) // times
            parts = [periodic_runs.scan([a], [(1 + lags * k // 3, 1 + lags * (k + 1) // 3)], least, times)[0] for k in range(3)]
            assert sorted(sum(parts, []), key=lambda x: (x[0], x[2])) == w


def check_runs(rows, texts):
    for row in rows:
        words = (texts[row["doc_id"]] or "").split()
        runs = brute_runs(words)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        assert row["text"] == " ".join(w for i, w in enumerate(words) if i not in gone)
        got = row["periodic_runs"]
        assert (got["n_words"], got["n_runs"]) == (len(words), len(runs))
        assert [tuple(x) for x in got["runs"]] == runs
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        assert (got["start"], got["length"], got["period"]) == best
        assert got["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    out = {i: " ".join(repetitive(r)) for i in range(60)}
    out |= {100: None, 101: "", 102: " \n\t ", 103: "x " * 3000, 104: "a b " * 12, 105: "é \x0b" * 30, 106: ("p q r " * 9) + ("s t " * 15), 107: "a b c d " * 8 + "e f g h " * 8}
    return out


EXTRA = ["row", "runs", "t", "key", "kept", "best", "periodic_runs", "a b"]


@pytest.mark.parametrize("long_bytes", [1 << 20, 200])
def test_collapse_runs(spark, texts, monkeypatch, long_bytes):
    """Texts scanned where they lie, and in ranges of lags dealt to tasks; rows repeat and columns clash."""
    monkeypatch.setattr(periodic_runs, "LONG_BYTES", long_bytes)
    monkeypatch.setattr(periodic_runs, "BUDGET", 1000)
    rows = [(i, t, *range(8)) for i, t in [*texts.items(), (103, texts[103]), (0, texts[0])]]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in EXTRA)).repartition(3)
    out = periodic_runs.collapse_runs(df)
    assert out.columns == [*[c for c in df.columns if c != "periodic_runs"], "periodic_runs"]
    got = out.collect()
    assert len(got) == len(rows) and all(r["key"] == 3 for r in got)
    check_runs(got, texts)
    assert periodic_runs.collapse_runs(df.where("false")).count() == 0


def test_scan_of_one_word_is_fast():
    """A text of one word repeats at every lag; runs found before explain what larger lags see."""
    begin = time.time()
    assert periodic_runs.scan([np.zeros(100_000, dtype=np.int32)], [(1, 100_000)]) == [[(0, 100_000, 1)]]
    assert time.time() - begin < 30
    with pytest.raises(ValueError, match="two periods"):
        periodic_runs.collapse_runs(None, min_exponent=1)


def test_planted_tails(spark):
    import zlib

    rows = [(i, " ".join(f"w{k}" for k in range(i % 90))) for i in range(400)] + [(401, None), (None, "a b c")]
    got = {r["doc_id"]: r["text"] for r in queries.planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    changed = 0
    for i, t in rows:
        w = (t or "").split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert got[i].split() == [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            changed += 1
        else:
            assert got[i] == t
    assert changed > 20


def brute_whitening(vectors, components=16):
    """Rows and the distinct fit list by numpy's eigenvectors of the covariance matrix."""
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, (x - fit.mean(axis=0)) @ vectors / np.sqrt(values), values / np.trace(np.cov(fit.T, bias=True))


def check_whitening(rows, vectors, n_components):
    n, deviation, white, explained = brute_whitening(list(vectors.values()), n_components)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(got) == len(vectors) * n_components
    for c in range(1, n_components + 1):
        w = np.array([got[i, c]["whitened"] for i in vectors])
        sign = np.sign(w @ white[:, c - 1])
        assert np.abs(w - sign * white[:, c - 1]).max() < 1e-7
        for i, d in zip(vectors, deviation, strict=True):
            r = got[i, c]
            assert (r["n"], r["deviation"]) == (n, d)
            assert abs(r["explained"] / explained[c - 1] - 1) < 1e-6 and r["identity_error"] < 1e-7


def test_whitening_against_eigenvectors(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    vectors = {r["vec_id"]: list(r["embedding"]) for r in table.collect()}
    check_whitening(whitening.whiten(table).collect(), vectors, 16)


def test_whitening_merges_many_factors(spark, monkeypatch):
    """Copies count once; more partitions than FAN_IN and rows than BLOCK; far from zero, where a covariance would lose digits."""
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 8)
    r = np.random.default_rng(1)
    base = (r.normal(size=(150, 5)) @ r.normal(size=(5, 5)) * [1, 5, 0.5, 30, 2]).round(3) + 1e5
    vectors = {i: base[i % 150].tolist() for i in range(220)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(9)
    check_whitening(whitening.whiten(df).collect(), vectors, 5)


def test_whitening_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [3.0, 5.0]), (4, [0.0, -1.0]), (5, None), (6, [1.0, None]), (7, [nan, 1.0]), (8, [1.0, -inf]), (9, []), (10, [1e300, 0.0]), (11, [1.0, 2.0, 3.0]), (12, [7.0, 7.0, 3.0]), (1, [9.0, 9.0])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, row string, component int, x int")
    got = whitening.whiten(df).collect()
    two = [r for r in got if r["n"] == 4]
    assert sorted((str(r["vec_id"]), r["component"]) for r in two) == sorted((str(i), c) for i in (1, 2, None, 4, 1) for c in (1, 2))
    three = [r for r in got if r["n"] == 2]
    # two vectors span one direction: it has variance, the others have none
    assert sorted((r["vec_id"], r["component"]) for r in three) == [(i, c) for i in (11, 12) for c in (1, 2, 3)]
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in three)
    assert {round(r["whitened"], 9) for r in three if r["component"] == 1} == {1.0, -1.0}
    assert len(two) + len(three) == len(got) and all(r["identity_error"] < 1e-9 for r in got)
    same = whitening.whiten(df.where("vec_id = 2")).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in same] == [(None, 0.0, None, 0)] * 2
    assert whitening.whiten(df.where("false")).count() == 0
    kept = whitening.whiten(df.withColumnRenamed("row", "a b"), keep=("a b", "x"))
    assert kept.columns[:3] == ["vec_id", "a b", "x"] and kept.where("`a b` = 'x' and x = 2").count() == len(got)


def test_deviation_of_large_numbers():
    model = whitening.Model(3, [0, 0], np.eye(2), np.ones(2), np.ones(2))
    x = np.array([[1 << 29, 5], [1 << 40, 1], [(1 << 53) - 1, -(1 << 53)]], dtype=np.int64)
    assert model.deviations(x) == [9 * ((1 << 58) + 25), None, None]


PAGES = {
    "article": ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>A</a></ul></nav><!-- ad --><div class='ad'>Buy</div><article><h1>Head</h1><p><b>One &amp; two<br><p>Three.</p></article><footer>&copy; x", "Head\nOne & two\nThree."),
    "no marks": ('<body><ul class="x"><li><a href="/">Home</a></li><li><a href="/b">News today</a></li></ul><h1>My Title</h1><p>One two three.</p><div class="advert">Buy this now</div><p>Four &amp; <a href="/x">link words</a> five.<p>Six</p><div id="comments"><p>Nice article, I love it</p></div><footer>Copy</footer></body>', "My Title\nOne two three.\nFour & link words five.\nSix"),
    "classes": ('<div id="header">Site</div><div class="cookie-notice"><p>We use cookies to help you.</p></div><div id="content"><h2>Head</h2>Loose text<br>more<ul><li>a</li><li>b</li></ul><table><tr><td>x<td>y</table></div><div class="sidebar"><p>Other stories here for you</p></div>', "Head\nLoose text more\na\nb\nx\ny"),
    "nested": ('<main><article class="post"><header><h1>T</h1></header><p>a b c</p><aside>no no no no</aside><p>d</p><form><input><label>mail</label></form><section class="comments"><article class="comment"><p>c c c c c c c</p></article></section></article></main>', "T\na b c\nd"),
    "inside": ("<article><h1>A</h1><nav>x y z</nav><p>b</p><script>if(a<b){'</p>'}</script><p title='a>b'>c&nbsp;&nbsp;d&#10;e</p><ul><li>l</ul></article>", "A\nb\nc d e\nl"),
    "wrapped in a form": ('<form id="f"><div class="menu">m</div><article><p>hello world</p></article></form>', "hello world"),
    "plain": ("just text &amp; <b>m</b>ore 1 < 2", "just text & more 1 < 2"),
    "unclosed": ('<nav><a href="x">a</a><article><p>text "q" here <a href="z>oops</a> more', 'text "q" here oops more'),
    "comment": ("<article><p>a<!-- x --> b<p>c<!-- rest <p>d", "a b\nc"),
    "hidden": ('<article><p hidden>x</p><p style="display: none">y</p><div aria-hidden="true">z</div><p>seen &lt;b&gt; &amp;amp;</p></article>', "seen <b> &amp;"),
    "no text": ("<nav>menu</nav><script>x</script>", ""),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("fitted", [False, True])
def test_main_texts(spark, small, fitted):
    """With weights counted on the table's pages, and with the prior alone."""
    weights = html_extraction.fit(spark.read.parquet(f"{small}/pages.parquet")) if fitted else html_extraction.weights_of({})
    df = spark.createDataFrame([(k, v[0], 1, 2, "x") for k, v in PAGES.items()] * 2, "name string, html string, row int, t int, main_text string")
    out = html_extraction.extract(df, weights=weights)
    assert out.columns == ["name", "html", "row", "t", "main_text"]
    rows = out.collect()
    assert len(rows) == 2 * len(PAGES)
    for r in rows:
        assert r["main_text"] == PAGES[r["name"]][1], r["name"]
    assert html_extraction.extract(df.where("false")).count() == 0


def test_marks_are_not_needed(spark, small):
    """Pages whose articles, menus, adverts and footers are unnamed divisions are told by blocks and links, with the weights of marked ones."""
    table = spark.read.parquet(f"{small}/pages.parquet")
    weights = html_extraction.fit(table)
    bare = F.regexp_replace(F.regexp_replace("html", "<(/?)(?:article|nav|footer)>", "<$1div>"), ' class="ad"', "")
    df = table.withColumn("plain", bare).collect()
    same = [html_extraction.main_text(r["plain"], weights) == html_extraction.main_text(r["html"], weights) for r in df]
    assert np.mean(same) > 0.99


def test_best_region():
    assert html_extraction.best_region([-1, 2, -1, 3, -5, 4]) == (1, 4)
    r = random.Random(2)
    for _ in range(200):
        scores = [r.randint(-5, 5) for _ in range(r.randint(0, 12))]
        s, e = html_extraction.best_region(scores)
        assert sum(scores[s:e]) == max([0, *[sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)]])


def test_long_pages_take_linear_time():
    weights = html_extraction.weights_of({})
    begin = time.time()
    for page in ('<p>"<a ' * 50_000, "<" * 100_000, "<div>" * 50_000 + "x", "<i>" * 50_000 + "</b><p></p>" * 50_000, "<article>" + "<p>word &amp; word</p>" * 50_000):
        html_extraction.main_text(page, weights)
    assert time.time() - begin < 60
    assert html_extraction.main_text(page, weights).count("\n") == 49_999

"""URL filters, archives and vector search against brute force."""

import fnmatch
import hashlib
import random
import zlib

import numpy as np
import pytest

from tidewire.llm import license_scan, mtree_search, quality, queries, url_filter, warc_index
from tidewire.llm.queries import URL_RULES


def test_url_filter(spark):
    given = [(1, "http://A.net/x", ("a.net", "/x", "net/", "block")), (2, "https://b.example.net/en/1", ("b.example.net", "/en/1", "example.net/en/", "allow")), (3, "https://example.com/de/", ("example.com", "/de/", "example.com/de/", "block")), (4, "https://notexample.com/de/", ("notexample.com", "/de/", None, "allow")), (5, "http://x.org/fr/?a", ("x.org", "/fr/", "org/fr/", "allow")), (6, "http://x.net", ("x.net", "", None, "allow")), (7, None, ("", "", None, "allow")), (8, "mailto:a", ("", "", None, "allow")), (9, "http://evil.com/.net/", ("evil.com", "/.net/", None, "allow")), (10, "http://h?://x.net/", ("h", "", None, "allow")), (None, "ftp://É.NET/ü#f", ("É.net", "/ü", "net/", "block"))]
    rows = spark.createDataFrame([(i, u, "x", "y") for i, u, _ in given], "page_id long, url string, host string, page string")
    got = {r["page_id"]: tuple(r["url_filter"]) for r in url_filter.judge_urls(rows, URL_RULES).collect()}
    assert got == {i: w for i, _, w in given}
    assert url_filter.judge_urls(rows.where("false"), URL_RULES).count() == 0


def test_url_filter_long_and_repeated(spark):
    """A URL of two million symbols beside short ones takes memory for its own symbols alone; rows stay as often as they come."""
    rows = [(1, "http://a.net/" + "x/" * 1_000_000), *[(i, f"http://h{i}.org/fr/") for i in range(2, 2000)], (5, "http://h5.org/fr/"), (2001, "http://" + "a." * 70_000 + "net/")]
    df = spark.createDataFrame(rows, "page_id long, url string").coalesce(1)
    got = url_filter.judge_urls(df, URL_RULES).groupBy("url_filter.rule", "url_filter.verdict").count().collect()
    assert sorted(tuple(r) for r in got) == [("net/", "block", 2), ("org/fr/", "allow", 1999)]


def test_automaton_against_fnmatch():
    r = random.Random(3)
    glob = lambda n: "".join(r.choice("ab.*?") for _ in range(n))
    rules = [url_filter.Rule("block", glob(r.randint(1, 5)), "/" + glob(r.randint(0, 4))) for _ in range(60)]
    machine = url_filter.compile_rules(rules)
    hosts = ["".join(r.choice("ab.") for _ in range(r.randint(0, 7))) for _ in range(300)]
    paths = ["/" * r.randint(0, 1) + "".join(r.choice("ab.") for _ in range(r.randint(0, 5))) for _ in range(300)]
    end = chr(0x10FFFF)
    inner = url_filter.Automaton(**{**machine.__dict__, "classes": {**machine.classes, ord(end): machine.classes[url_filter.END]}})
    won = inner.step_all([f".{h}{end}{p}" for h, p in zip(hosts, paths, strict=True)])
    for h, p, k in zip(hosts, paths, won.tolist(), strict=True):
        fits = [i for i, x in enumerate(rules) if fnmatch.fnmatchcase("." + h, "*." + x.host) and fnmatch.fnmatchcase(p, x.path + "*")]
        size = lambda i: sum(s is not None and s != "*" for s in rules[i].symbols())
        assert k == (min(fits, key=lambda i: (-size(i), i)) if fits else -1)


@pytest.mark.parametrize("words", [1, 4, 256])
def test_machines_against_fnmatch(monkeypatch, words):
    """Rules in many machines, URLs in small slices: the same winners as rule by rule."""
    monkeypatch.setattr(url_filter, "MACHINE_WORDS", words)
    monkeypatch.setattr(url_filter, "STATE_BYTES", 256)
    r = random.Random(words)
    glob = lambda n: "".join(r.choice("ab.*?") for _ in range(n))
    rules = [url_filter.Rule("block", glob(r.randint(0, 5)), "/" + glob(r.randint(0, 4))) for _ in range(150)]
    hosts = ["".join(r.choice("ab.") for _ in range(r.randint(0, 7))) for _ in range(300)]
    paths = ["/" * r.randint(0, 1) + "".join(r.choice("ab.") for _ in range(r.randint(0, 5))) for _ in range(300)]
    machines = url_filter.Machines.of(rules)
    size = lambda i: sum(s is not None and s != "*" for s in rules[i].symbols())
    for h, p, k in zip(hosts, paths, machines.winners(hosts, paths).tolist(), strict=True):
        fits = [i for i, x in enumerate(rules) if fnmatch.fnmatchcase("." + h, "*." + x.host) and fnmatch.fnmatchcase(p, x.path + "*")]
        assert k == (min(fits, key=lambda i: (-size(i), i)) if fits else -1)
    assert url_filter.Machines.of([]).winners(["a.b"], ["/"]).tolist() == [-1]


def test_twenty_thousand_rules_in_bounded_memory():
    import tracemalloc

    rules = [url_filter.Rule("block", f"site{i}.{'com' if i % 2 else 'example'}", f"/p{i % 7}/") for i in range(20_000)]
    tracemalloc.start()
    machines = url_filter.Machines.of(rules)
    hosts = [f"www.site{i}.{'com' if i % 2 else 'example'}" for i in range(0, 2000)]
    won = machines.winners(hosts, [f"/p{i % 7}/x" for i in range(2000)]).tolist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert won == list(range(2000)) and peak < 400 << 20


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc_index, "BLOCK_LINES", 3)
    big, other = "é" * 700, "x" * 1000
    given = [(1, "http://a.com/1", big), (2, "http://www.a.com/2?q=1", big), (3, "http://b.com/", other), (4, None, None), (5, "http://b.com/", "small"), (6, "http://c.com:8080/x", "small"), (7, "http://b.com/", other), (None, "http://d.com", big), (9, "http://www.a.com/2?q=1", "y" * 999), (10, "http://t\tab/\n", big)]
    rows = spark.createDataFrame(given, "page_id long, url string, html string").repartition(3)
    folder, captures = warc_index.write_archives(rows)
    directory = warc_index.build_index(folder, captures)
    got = {r["page_id"]: tuple(r)[1:5] for r in warc_index.read_keys(folder, directory, captures).collect()}
    for page, _, body in given:
        raw = (body or "").encode()
        last = max(p for p, _, b in given if p is not None and (b or "") == (body or "")) if page is not None else None
        revisit = page is not None and len(raw) >= 1000 and last != page
        assert got[page] == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last if revisit else None)
    assert directory.count() >= 4
    asked = spark.createDataFrame([("com,b)/", "x"), ("com,c:8080)/x", "x"), ("net,zz)/", "x"), ("com,b)/", "y")], "key string, page_id string")
    assert sorted(r["page_id"] for r in warc_index.read_keys(folder, directory, asked).collect()) == [3, 5, 6, 7]
    index = warc_index.CaptureIndex(folder, directory)
    found = index.lookup("https://B.com/")
    assert sorted(f["X-Page-ID"] for f, _ in found) == ["3", "5", "7"] and {p for _, p in found} == {other.encode(), b"small"}
    assert index.lookup("http://nowhere.com/") == [] and [p for _, p in index.lookup("http://d.com")] == [big.encode()]


def test_warc_hot_url(spark, monkeypatch):
    """A URL with most captures lies in many blocks and files, all of which are found; rows that share the winning id are responses."""
    monkeypatch.setattr(warc_index, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc_index, "SENT_KEYS", 2)
    given = [(i, "http://hot.com/" if i % 3 else f"http://h{i}.com/", f"body {i % 5} " * 300) for i in range(300)] + [(299, "http://hot.com/", "body 4 " * 300)]
    rows = spark.createDataFrame([(*g, "k", 1) for g in given], "page_id long, url string, html string, key string, start int").repartition(4)
    folder, captures = warc_index.write_archives(rows)
    directory = warc_index.build_index(folder, captures)
    out = warc_index.read_keys(folder, directory, captures).collect()
    assert sorted(r["page_id"] for r in out) == sorted(g[0] for g in given)
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in out} == {(i, "response" if i >= 295 else "revisit", None if i >= 295 else 295 + i % 5) for i, _, _ in given}
    index = warc_index.CaptureIndex(folder, directory)
    assert len(index.lookup("http://hot.com/")) == sum(g[1] == "http://hot.com/" for g in given)


def test_warc_revisit_of_another_url(spark):
    big, other = "é" * 700, "x" * 1000
    given = [(1, "http://a.com/1", big), (10, "http://b.com/", big), (2, "http://a.com/2", other), (10, "http://b.com/", other), (3, "http://a.com/1", "")]
    folder, captures = warc_index.write_archives(spark.createDataFrame(given, "page_id long, url string, html string").repartition(2))
    index = warc_index.CaptureIndex(folder, warc_index.build_index(folder, captures))
    found = {(f["X-Page-ID"], f["WARC-Type"], f["X-Payload-Length"]): p for f, p in index.lookup("http://a.com/1")}
    assert found == {("1", "revisit", "1400"): big.encode(), ("3", "response", "0"): b""}
    assert [(f["WARC-Type"], p) for f, p in index.lookup("http://a.com/2")] == [("revisit", other.encode())]


def test_warc_empty_and_damaged(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    folder, captures = warc_index.write_archives(none)
    assert warc_index.read_keys(folder, warc_index.build_index(folder, captures), captures).count() == 0
    good = warc_index.to_record("1", "u", b"body", hashlib.sha1(b"other").hexdigest(), 4, None)
    with pytest.raises(ValueError, match="damaged"):
        warc_index.from_record(good)
    assert warc_index.reversed_key("http://u@WWW.A.com:443/x?y#z") == "com,a,www)/x?y"


def brute_top(rows, k=5):
    """rows: (id, vector of whole numbers); each is told from the others by its place."""
    want = []
    for at, (q, v) in enumerate(rows):
        if q % 50 == 0:
            scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for j, (i, w) in enumerate(rows) if j != at and len(w) == len(v))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(want)


def test_mtree(spark, monkeypatch):
    monkeypatch.setattr(mtree_search, "BLOCK_ROWS", 64)
    monkeypatch.setattr(mtree_search, "PAGE_ROWS", 8)
    monkeypatch.setattr(mtree_search, "PACK_BLOCKS", 2)
    monkeypatch.setattr(mtree_search, "ROUTER_BLOCKS", 3)
    g = np.random.default_rng(1)
    centers = g.normal(size=(6, 5))
    x = {i: (centers[i % 6] + 0.05 * g.normal(size=5)).tolist() for i in range(400)}
    for i in range(100, 200):
        x[i] = x[100]  # ties by the hundred
    good = [*x.items(), (404, [1.0, 2.0]), (450, [2.0, 1.0]), (50, x[50]), (50, x[51]), (7, x[50])]
    bad = [(400, None), (401, [1.0, float("nan"), 0.0, 0.0, 0.0]), (402, [1.0, None, 0.0, 0.0, 0.0]), (403, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, x[1]), (406, [1e308, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "e", 1) for i, v in good + bad], "vec_id long, embedding array<double>, id string, uid int").repartition(3)
    want = brute_top([(i, [int(np.floor(256 * c)) for c in v]) for i, v in good])
    assert sorted(tuple(r) for r in mtree_search.top_k(df).collect()) == want
    assert mtree_search.top_k(df.where("false")).count() == 0


def test_mtree_large_components(spark, monkeypatch):
    """Scores beyond what floats hold exactly are exact, ties by the smaller id; beyond 64 bits they are the nearest 64-bit integer."""
    monkeypatch.setattr(mtree_search, "BLOCK_ROWS", 64)
    monkeypatch.setattr(mtree_search, "PAGE_ROWS", 8)
    g = np.random.default_rng(3)
    large = [(i, (3e6 + g.integers(0, 3, size=8) / 256).tolist()) for i in range(150)] + [(i, [0.5] * 8) for i in range(150, 160)]
    huge = [(i, [float(g.integers(-9, 9)) * 10.0 ** (i % 30), 1.0, -2.5]) for i in range(200, 260)]
    df = spark.createDataFrame(large + huge, "vec_id long, embedding array<double>").repartition(2)
    want = brute_top([(i, [int(np.floor(256 * c)) for c in v]) for i, v in large + huge])
    assert sorted(tuple(r) for r in mtree_search.top_k(df).collect()) == want


def test_mtree_saves_distances():
    """Clustered rows, pages as large as they are shipped: the bounds leave most distances uncomputed, and nothing is missed."""
    g = np.random.default_rng(2)
    centers = 300 * g.normal(size=(40, 8))
    x = np.floor(centers[np.arange(4000) % 40] + g.normal(size=(4000, 8)))
    x *= (256 / np.linalg.norm(x, axis=1))[:, None]
    x = np.floor(x)
    space = mtree_search.Space.of(8, float((x * x).sum(axis=1).max()), 256.0, 5)
    tree = mtree_search.Tree(np.arange(4000), np.arange(4000), x, space)
    for q in range(0, 200, 7):
        found, _ = tree.best(x[q], q, -np.inf)
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(4000), -s))[:5]
        assert found == [(-int(s[b]), b, b) for b in best.tolist()]
    assert tree.computed < 0.5 * 4000 * 29


LICENSES = [(1, "lib/LICENSE", "Released under the MIT License."), (2, "lib/a/b/c.py", "print(1)"), (3, "lib/a/d.py", "# head\nLicensed under the Apache License, Version 2.0.\ncode"), (4, "other/x.py", "nothing"), (5, None, "Released under the MIT License."), (6, "lib/e.py", None), (7, "lib/a/COPYING", "Some words first.\n\nLicensed under CC BY-NC 4.0."), (8, "f", ""), (9, "lib2/x", "the license of the house")]


def test_license_scan(spark):
    rows = spark.createDataFrame([(i, p, t, "k", "d") for i, p, t in LICENSES], "doc_id long, path string, text string, key string, dir string").repartition(3)
    got = {r["doc_id"]: (r["license_scan"]["license"], r["license_scan"]["origin"], r["license_scan"]["directory"]) for r in license_scan.scan(rows).collect()}
    assert got[1] == ("MIT", "header", None) and got[3] == ("Apache-2.0", "header", None) and got[5] == ("MIT", "header", None)
    assert got[2] == ("CC-BY-NC-4.0", "directory", "lib/a") and got[6] == ("MIT", "directory", "lib")
    assert got[4] == got[8] == got[9] == (None, None, None) and got[7][:2] == ("CC-BY-NC-4.0", "header")
    assert license_scan.scan(rows.where("false")).count() == 0


def test_license_texts_are_told_apart(spark):
    """Each whole licence text is its own, a copyright line before it or not, and what lies beside it inherits it."""
    full = {name: body for name, body in license_scan.TEMPLATES if len(body) > 400}
    rows = [(i, f"{name}/LICENSE", f"Copyright (c) 2020 A. Person\n\n{body}") for i, (name, body) in enumerate(full.items())] + [(100 + i, f"{name}/src/x.py", "print(1)") for i, name in enumerate(full)]
    got = {r["path"]: r["license_scan"]["license"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(2)).collect()}
    assert {"BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "MIT", "Zlib"} <= set(full)
    assert got == {f"{name}/{f}": name for name in full for f in ("LICENSE", "src/x.py")}


_NOTICE = "This {what} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."
CONFUSABLE = [
    ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.0", "GPL-3.0"),
    (_NOTICE.format(what="program", name="GNU General Public License", v="2"), "GPL-2.0"),
    (_NOTICE.format(what="program", name="GNU General Public License", v="3"), "GPL-3.0"),
    (_NOTICE.format(what="library", name="GNU Lesser General Public License", v="2.1"), "LGPL-2.1"),
    (_NOTICE.format(what="library", name="GNU Lesser General Public License", v="3"), "LGPL-3.0"),
    (_NOTICE.format(what="program", name="GNU Affero General Public License", v="3"), "AGPL-3.0"),
    (_NOTICE.format(what="library", name="GNU Library General Public License", v="2"), "LGPL-2.0"),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License", "CC-BY-3.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"),
    ("Licensed under CC BY-NC-SA 3.0", "CC-BY-NC-SA-3.0"),
    ("Licensed under CC BY 2.5", "CC-BY-2.5"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", "EPL-1.0"),
    ("Eclipse Public License v 2.0", "EPL-2.0"),
    ("Apache License Version 1.1", "Apache-1.1"),
    ("Licensed under the Apache License, Version 2.0", "Apache-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", "MPL-1.1"),
    ("Released under the MIT License.", "MIT"),
    ("This code is not released under the MIT License.", None),
    ("This work is not licensed under the GNU General Public License, version 3", None),
    ("This work is licensed under the GNU General Public License, version 9", None),
]


def test_confusable_licenses(spark):
    """Versions and relatives are told apart, denials declare nothing."""
    rows = [(i, None, t) for i, (t, _) in enumerate(CONFUSABLE)]
    got = {r["doc_id"]: r["license_scan"]["license"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(3)).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(CONFUSABLE)] == CONFUSABLE


def test_license_ties_repeats_and_hot_directories(spark, monkeypatch):
    """Equal rows stay as often as they come; of equal files the smaller path speaks for the directory; a salted directory is answered as any other."""
    monkeypatch.setattr(license_scan, "HOT", 3)
    mit, cc = "Released under the MIT License.", "Licensed under CC BY 4.0."
    rows = [(1, "d/b.txt", cc), (2, "d/a.txt", cc), (2, "d/a.txt", cc), (2, "d/a.txt", mit), (3, "e/x", mit), *[(i, "e/y", "code") for i in (5, 5, *range(6, 30))], (None, "e/z", None), (None, None, mit)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["text"], r["license_scan"]["license"]) for r in got if r["path"] and r["path"][0] == "d"} == {(1, cc, "CC-BY-4.0"), (2, cc, "CC-BY-4.0"), (2, mit, "MIT")}
    assert [tuple(r["license_scan"]) for r in got if r["path"] in ("e/y", "e/z")] == [("MIT", 1.0, "directory", "e")] * 27
    assert [r["license_scan"]["license"] for r in got if r["path"] is None] == ["MIT"]


def test_license_markers_lose_nothing():
    """Any segment at the threshold holds a marker: the rest of a template's terms can't reach it."""
    weights = license_scan._weights(license_scan.TEMPLATES, {"the": 900, "this": 700, "of": 950, "is": 800}, 1000)
    marks = set(license_scan.markers(weights, 0.7))
    for k in {w[1] for w in weights}:
        rest = sum(w[3] ** 2 for w in weights if w[1] == k and w[2] not in marks)
        assert rest < 0.49


def test_label_model():
    """Accuracies known by construction come back, and posteriors tell the classes apart."""
    g = np.random.default_rng(5)
    n, m = 20000, len(quality.LABELLERS)
    good = g.random(n) < 0.85
    right = np.stack([np.full(m, 0.998), np.linspace(0.2, 0.9, m)])
    votes = np.where(g.random((n, m)) < right[(~good).astype(int)], 1, -1) * np.where(good, 1, -1)[:, None]
    votes[g.random((n, m)) < 0.1] = 0
    codes, counts = np.unique(((votes + 1) * 3 ** np.arange(m - 1, -1, -1)).sum(axis=1), return_counts=True)
    model = quality.LabelModel(codes, counts.astype(float))
    assert abs(model.good - 0.85) < 0.02 and np.abs(model.right[1] - right[1]).max() < 0.05
    sure = model.posterior(((votes + 1) * 3 ** np.arange(m - 1, -1, -1)).sum(axis=1)) >= 0.5
    assert (sure == good).mean() > 0.98
    assert quality.LabelModel(np.empty(0, np.int64), np.empty(0)).good == 0.8


def test_label_model_estimates_false_alarms():
    """A labeller that often calls good documents bad is told from the precise ones, which a bound on accuracies would hide."""
    g = np.random.default_rng(6)
    n, m = 20000, len(quality.LABELLERS)
    good = g.random(n) < 0.85
    right = np.stack([np.array([0.9] + [0.998] * (m - 1)), np.full(m, 0.7)])
    votes = np.where(g.random((n, m)) < right[(~good).astype(int)], 1, -1) * np.where(good, 1, -1)[:, None]
    codes, counts = np.unique(((votes + 1) * 3 ** np.arange(m - 1, -1, -1)).sum(axis=1), return_counts=True)
    model = quality.LabelModel(codes, counts.astype(float))
    assert model.right[0, 0] < 0.98 < 0.995 < model.right[0, 1:].min() and abs(model.right[1] - 0.7).max() < 0.05


def brute_quality(texts, rounds=200):
    """Scores of texts: expectation-maximisation document by document, logistic regression in double precision over sparse features."""
    shapes = [quality.Shape.of(t) for t in texts]
    votes = [[f(s) for f in quality.LABELLERS.values()] for s in shapes]
    n, m = len(texts), len(quality.LABELLERS)
    right, good = [[quality.PRECISE] * m, [0.3] * m], 0.8
    p = [0.1 if -1 in v else 0.98 for v in votes]
    for step in range(rounds):
        if step:
            p = []
            for v in votes:
                a, b = good, 1 - good
                for j, x in enumerate(v):
                    a *= right[0][j] if x == 1 else 1 - right[0][j] if x == -1 else 1
                    b *= right[1][j] if x == -1 else 1 - right[1][j] if x == 1 else 1
                p.append(a / (a + b))
        before = [x[:] for x in right]
        for j in range(m):
            for k, (share, sign, mean, weight) in enumerate(((p, 1, quality.PRECISE, quality.WEIGHT * n), ([1 - x for x in p], -1, 0.3, 10.0))):
                hits = sum(q for q, v in zip(share, votes, strict=True) if v[j] == sign)
                spoken = sum(q for q, v in zip(share, votes, strict=True) if v[j])
                right[k][j] = min(max((hits + weight * mean) / (spoken + weight), 0.01), 0.9999)
        good = min(max(sum(p) / n, 0.02), 0.98)
        if max(abs(x - y) for a, b in zip(right, before, strict=True) for x, y in zip(a, b, strict=True)) < 1e-7:
            break
    # as the model gives its posterior after its last round
    last = []
    for v in votes:
        a, b = good, 1 - good
        for j, x in enumerate(v):
            a *= right[0][j] if x == 1 else 1 - right[0][j] if x == -1 else 1
            b *= right[1][j] if x == -1 else 1 - right[1][j] if x == 1 else 1
        last.append(a / (a + b))
    x = np.zeros((n, quality.TRIGRAMS + quality.MARKS))
    for row, (t, s) in enumerate(zip(texts, shapes, strict=True)):
        grams = [(((t[i] << 16 | t[i + 1] << 8 | t[i + 2]) * 2654435761) % (1 << 32)) >> (32 - quality.TRIGRAM_BITS) for i in range(len(t) - 2)]
        for g in grams:
            x[row, g] += 10.0 / len(grams)
        for name in s.marks():
            x[row, quality.TRIGRAMS + zlib.crc32(name.encode()) % quality.MARKS] += 1
    w, b, y = np.zeros(x.shape[1]), 2.0, np.array(last)
    m1, m2, b1, b2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, 151):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        g, gb = x.T @ e / n + 1e-3 * w, e.mean()
        m1, m2, b1, b2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g, 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
        c, d = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.05 * (m1 / c) / (np.sqrt(m2 / d) + 1e-8)
        b -= 0.05 * (b1 / c) / (np.sqrt(b2 / d) + 1e-8)
    return 1 / (1 + np.exp(-(x @ w + b))), right, good


def test_quality_against_brute_force(spark, small):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    scores, right, good = brute_quality([t for _, t in rows])
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model, _ = quality.fit(docs)
    assert abs(model.good - good) < 1e-6 and np.abs(model.right - np.array(right)).max() < 1e-5
    got = {r["doc_id"]: (r["score"], r["keep"]) for r in queries.op3_quality(spark, small).collect()}
    for (d, _), s in zip(rows, scores.tolist(), strict=True):
        assert abs(got[d][0] - s) < 5e-3 and (got[d][1] == (s >= quality.KEEP) or abs(s - quality.KEEP) < 5e-3), d


def test_quality_repeats_and_ties(spark, docs):
    """Equal rows are judged alike, as often as they come; a null id or text is judged."""
    rows = docs.select("doc_id", "text")
    more = rows.unionByName(rows).unionByName(spark.createDataFrame([(None, None), (None, ""), (7, None)], "doc_id long, text string"))
    out = quality.classify(more, quality.fit(more)[1]).select("doc_id", "text", "quality_model.score").collect()
    scores = {}
    for r in out:
        scores.setdefault((r["doc_id"], r["text"]), set()).add(r["score"])
    assert len(out) == 2 * rows.count() + 3 and all(len(x) == 1 for x in scores.values())


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.classify(docs, quality.fit(docs)[1]).join(labels, "doc_id").select("quality", "quality_model.keep").collect()
    clean, junk = [r["keep"] for r in out if r["quality"]], [r["keep"] for r in out if not r["quality"]]
    assert sum(clean) / len(clean) > 0.99 and sum(junk) / len(junk) < 0.15


def test_quality_cases(spark, docs, none):
    model, scorer = quality.fit(none)
    assert quality.classify(none, scorer).count() == 0 and quality.classify(docs, scorer).where("quality_model.keep").count() == docs.count()
    out = quality.classify(docs.withColumn("quality_model", docs["doc_id"]), quality.fit(docs)[1])
    assert out.columns == [*docs.columns, "quality_model"] and out.where("quality_model.score is null").count() == 0


def test_vectors_without_components(spark):
    """Empty vectors hold no null and no infinite component, so they take part: each meets the others with score 0."""
    rows = [(0, [1.0, 2.0]), (50, []), (3, []), (7, []), (100, [0.5, 1.0]), (150, [])]
    got = sorted(tuple(r) for r in mtree_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    score = lambda a, b: sum(int(256 * x // 1) * int(256 * y // 1) for x, y in zip(a, b, strict=True))
    want = [(0, 1, 100, score([1, 2], [0.5, 1])), (50, 1, 3, 0), (50, 2, 7, 0), (50, 3, 150, 0), (100, 1, 0, score([1, 2], [0.5, 1])), (150, 1, 3, 0), (150, 2, 7, 0), (150, 3, 50, 0)]
    assert got == want

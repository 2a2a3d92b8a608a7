"""Operators on small fixtures."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewire.operators import chunking, dashboard, dedup, joins, retrieval, upsert


def test_token_windows(spark):
    rows = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in (0, 350, 400, 1000)], "n int, text string")
    got = chunking.token_windows(rows, "text").select("n", "chunk_index", "total_chunks", F.size(F.split("chunk", " ")).alias("k")).orderBy("n", "chunk_index").collect()
    assert [tuple(r) for r in got] == [(350, 0, 1, 350), (400, 0, 2, 400), (400, 1, 2, 50), (1000, 0, 3, 400), (1000, 1, 3, 400), (1000, 2, 3, 300)]


def test_sentences_and_recursive():
    one = "El agua llega hoy a todos los barrios de la ciudad. " * 20
    packed = chunking.pack_sentences(one.strip())
    assert all(len(x) <= 512 + 130 for x in packed) and packed[1].startswith("barrios de la ciudad.") is False
    assert chunking.pack_sentences("corto") == ["corto"] and chunking.pack_sentences("") == []
    pieces = chunking.split_recursively("a" * 4500 + " b " * 900, 2000, 500)
    assert max(map(len, pieces)) <= 2000 and pieces[0] == "a" * 2000
    assert chunking.split_recursively("", 10, 2) == []


def test_leader_cluster(spark):
    a, b, c = "corte de agua en piura por obras", "corte de agua en piura por obra", "sunass supervisa calidad del agua"
    rows = spark.createDataFrame([("x", 0, a), ("x", 1, b), ("x", 2, c), ("y", 3, a), ("y", 4, None)], "block string, ord int, text string")
    labels = dedup.leader_cluster(rows, "block", "ord", "text", 0.85)
    assert [(r["ord"], r["leader"]) for r in labels.orderBy("ord").collect()] == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 4)]
    assert tuple(dedup.cluster_stats(labels.where("block = 'x'")).first()) == (3, 2, 1, 33.33)
    runs = []
    dedup.with_fallback(rows, lambda more: runs.append(more) or labels)
    assert runs == [0.0]


def test_leader_cluster_of_large_blocks(spark):
    words = ["corte de agua en piura por obras", "corte de agua en piura por obra", "sunass supervisa calidad", "corte de agua en lima por obras", "otra nota", ""]
    given = [("x", i, words[i * i % 7 % 6] + " abc"[: i % 3]) for i in range(40)] + [("y", i, words[i % 6]) for i in range(5)] + [(None, i, words[i % 4]) for i in range(9)] + [("x", 40, None)]
    rows = spark.createDataFrame(given, "block string, ord int, text string").repartition(5)
    for options in ({}, {"absorb": True}, {"similarity": lambda a, b: float(a[:12] == b[:12])}):
        whole = sorted(map(str, dedup.leader_cluster(rows, "block", "ord", "text", 0.85, **options).collect()))
        cut = sorted(map(str, dedup.leader_cluster(rows, "block", "ord", "text", 0.85, max_block=7, **options).collect()))
        assert cut == whole and len(cut) == len(given)
    plain = lambda a, b: dedup.block_ratio_of(a, b) if a and b else 0.0
    assert sorted(map(str, dedup.leader_cluster(rows, "block", "ord", "text", 0.85).collect())) == sorted(map(str, dedup.leader_cluster(rows, "block", "ord", "text", 0.85, similarity=plain).collect()))


def test_keep_first_and_last(spark):
    rows = spark.createDataFrame([(0, " Agua "), (1, "agua"), (2, "luz"), (3, " "), (4, None)], "i int, text string")
    assert [r["i"] for r in dedup.exact_dedup(rows, "text", [F.col("i")]).orderBy("i").collect()] == [0, 2]
    ids = spark.createDataFrame([(0, "x", "v1"), (1, "y", "v"), (2, "x", "v2")], "i int, id string, v string")
    assert [(r["id"], r["v"]) for r in dedup.keep_last_in_place(ids, "id", "i").orderBy("first_at").collect()] == [("x", "v2"), ("y", "v")]
    reps = spark.createDataFrame([(0, 0.4, "a" * 90), (1, 0.5, "a" * 10), (2, 0.5, "a" * 20)], "i int, s double, t string").withColumn("g", F.lit(1))
    assert dedup.representatives(reps, [F.col("g")], F.col("s"), F.col("t"), [F.col("i")]).first()["i"] == 2


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (5, 5), (None, 4)], "u long, v long")
    assert sorted(tuple(r) for r in dedup.components(edges).collect()) == [(1, 1), (2, 1), (3, 1), (5, 5), (10, 10), (11, 10)]


def test_hybrid(spark):
    v = spark.createDataFrame([("A", 0.8), ("B", 0.4)], "id string, similarity double")
    k = spark.createDataFrame([("B", 0.2), ("C", 0.1)], "id string, rank_score double")
    assert [(r["id"], r["score"]) for r in retrieval.hybrid(v, k, "id", 3).collect()] == [("B", 0.7), ("A", 0.6), ("C", 0.2)]


def test_balanced_and_windows(spark):
    days = spark.createDataFrame([(i, dt.date(2025, 1, 1 + i // 3)) for i in range(6)], "i int, day date")
    assert [r["i"] for r in retrieval.balanced(days, "day", [F.col("i")], 4).collect()] == [0, 1, 2, 3]
    w = retrieval.windowed_top_k(days.withColumn("s", F.lit(1.0)), "day", F.lit(dt.date(2025, 1, 1)), F.lit(dt.date(2025, 1, 2)), 1, 2, F.col("s"), "i", days=1, stop_at=2)
    assert {r["window_idx"] for r in w.collect()} == {0}
    assert [(r["i"], r["block"], r["n_blocks"]) for r in retrieval.blocks(days.limit(4), [F.col("i")]).orderBy("i").collect()] == [(0, 1, 2), (1, 1, 2), (2, 1, 2), (3, 2, 2)]


def test_dashboard(spark):
    points = spark.createDataFrame([(10.0, 3), (5.5, None)], "time_image_api double, total_urls int")
    r = dashboard.totals(points, ["total_urls"], ["time_image_api"]).first()
    assert (r["n"], r["total_total_urls"], r["avg_time_image_api"]) == (2, 3, 7.75)
    none = dashboard.totals(points.where("false"), ["total_urls"], ["time_image_api"]).first()
    assert (none["n"], none["total_total_urls"], none["avg_time_image_api"]) == (0, 0, 0.0)
    bounds = dashboard.date_bounds(spark.createDataFrame([("31122024",), ("01022025",), ("31022025",), (None,)], "d string"), F.col("d")).first()
    assert (bounds["first"], bounds["last"]) == (dt.date(2024, 12, 31), dt.date(2025, 2, 1))


def test_keyed_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 0), (2, "d", 1), (3, "e", 2)], "k int, v string, o int")
    assert sorted((r["k"], r["v"]) for r in upsert.upsert(old, new, "k", "o").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted((r["k"], r["v"]) for r in upsert.insert_ignore(old, new.drop("o").where("v != 'd'"), "k").collect()) == [(1, "a"), (2, "b"), (3, "e")]
    cache = upsert.cache_put(upsert.empty_cache(spark), spark.createDataFrame([("x", "1")], "key string, content string"), F.lit("2025-01-01 00:00:00"), 60)
    assert upsert.cache_fresh(cache, F.lit("2025-01-01 00:00:59")).count() == 1
    assert upsert.cache_fresh(cache, F.lit("2025-01-01 00:01:00")).count() == 0
    links = spark.createDataFrame([("x",), ("z",), (None,)], "url string")
    hit = upsert.with_cached(links, F.col("url"), cache, F.lit("2025-01-01 00:00:01"), "content")
    assert sorted((r["url"] or "", r["content"]) for r in hit.collect()) == [("", None), ("x", "1"), ("z", None)]
    at = upsert.write_table(old, str(tmp_path / "t"))
    assert spark.read.parquet(at).count() == 2
    assert upsert.backfill(old, "n", F.col("k") + 1).orderBy("k").first()["n"] == 2


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("b", 10, 1)], "k string, t int, v int")
    assert sorted((r["k"], r["t"], r["right_v"]) for r in joins.as_of(left, right, "k", "t", ["v"]).collect()) == [("a", 1, None), ("a", 5, 50), ("b", 9, None)]


def test_cache_is_fresh_to_the_microsecond(spark):
    late = spark.createDataFrame([("y", "1", dt.datetime(2025, 1, 1, 0, 0, 0, 170000), 60), ("z", "1", dt.datetime(2025, 1, 1), 60)], "key string, content string, stored_at timestamp, expiry_seconds long")
    assert [r["key"] for r in upsert.cache_fresh(late, F.lit("2025-01-01 00:01:00")).collect()] == ["y"]
    assert upsert.cache_fresh(late, F.lit("2025-01-01 00:01:00.170000")).count() == 0


def test_leaders_by_bounds(spark):
    """The bounds of the ratio leave out no leader that a text joins, in either order, with popular characters and without."""
    r = random.Random(11)
    for size, letters in ((30, "abcde "), (400, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,ñé "), (900, "aaaaabcd efghijklmnop")):
        base = ["".join(r.choice(letters) for _ in range(size)) for _ in range(3)]
        texts = []
        for _ in range(45):
            t = list(r.choice(base))
            for _ in range(r.choice([0, 1, 5, size // 12, size // 8, size // 4])):
                t[r.randrange(len(t))] = r.choice(letters)
            texts.append("".join(t)[: r.choice([size, size, size * 3 // 4])])
        for absorb in (False, True):
            fast, plain = dedup._Leaders(0.85, None, absorb), []
            for i, t in enumerate([*texts, "", texts[0], ""]):
                pairs = ((n, dedup.block_ratio_of(x, t) if absorb else dedup.block_ratio_of(t, x)) for n, x in plain if x and t)
                want = next(((n, s) for n, s in pairs if s >= 0.85), None)
                assert fast.first(t) == want
                if want is None:
                    fast.add(i, t)
                    plain.append((i, t))


def test_leaders_compare_few_texts(spark, monkeypatch):
    """Different texts of like lengths and letters are told apart by their n-grams, without their ratio."""
    r, tried = random.Random(2), []
    monkeypatch.setattr(dedup, "block_ratio_of", lambda a, b: tried.append(1) or 0.0)
    words = ["".join(r.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(r.randint(3, 9))) for _ in range(3000)]
    leaders = dedup._Leaders(0.85, None, False)
    for i in range(60):
        text = " ".join(r.choice(words) for _ in range(300))
        assert leaders.first(text) is None
        leaders.add(i, text)
    assert len(tried) < 20


def test_leader_cluster_apart(spark):
    """By a value that similar texts share the result is the same, and texts of different values are never compared."""
    given = [(x, i, t) for i, (x, t) in enumerate(zip("xxyxx" * 30, ["ab1", "ab2", "cd", "", None, "zz", "ab1"] * 30, strict=False))] + [(None, 200, "ab1"), (None, 201, "ab1"), (None, 202, "ab3")]
    rows = spark.createDataFrame(given, "block string, ord int, text string").repartition(3)
    alike = lambda a, b: 1.0 if a[:2] == b[:2] else 0.0

    def checked(a, b):
        assert a[:2] == b[:2]
        return 1.0

    for absorb in (False, True):
        whole = sorted(map(str, dedup.leader_cluster(rows, "block", "ord", "text", 0.85, similarity=alike, absorb=absorb).collect()))
        for most in (dedup.MAX_BLOCK, 1):
            assert sorted(map(str, dedup.leader_cluster(rows, "block", "ord", "text", 0.85, similarity=checked, absorb=absorb, max_block=most, apart=lambda c: F.left(c, F.lit(2))).collect())) == whole


def test_chunks_leave_as_they_come(spark, monkeypatch):
    """A worker gives chunks in parts of bounded size, with all columns, whatever a batch holds."""
    monkeypatch.setattr(chunking, "TOGETHER", 3000)
    rows = spark.createDataFrame([(i, None if i % 9 == 0 else f"Frase {i}. " * (i * 7 % 200), {"k": i}) for i in range(120)], "i long, text string, m map<string,int>").coalesce(1)
    sizes = []
    given = type(rows).mapInArrow

    def counted(self, run, schema):
        sizes.append(schema)
        return given(self, run, schema)

    monkeypatch.setattr(type(rows), "mapInArrow", counted)
    for chunks, cut in ((chunking.sentence_chunks, chunking.pack_sentences), (chunking.recursive_chunks, chunking.split_recursively)):
        got = sorted((r["i"], r["chunk_index"], r["total_chunks"], r["chunk"], r["m"]["k"]) for r in chunks(rows, "text").collect())
        want = [(r["i"], k, len(x), y, r["i"]) for r in rows.collect() for x in [cut(r["text"] or "")] for k, y in enumerate(x)]
        assert got == want
    assert len(sizes) == 2


def test_leader_cluster_of_whole_texts(spark):
    """What stands behind the first thousands of characters counts, as does its length; and counts of over 15 bits."""
    r = random.Random(8)
    words = lambda n: " ".join("".join(r.choice("aaaeeeiiooubcdfghjklmnpqrstvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,:;!?") for _ in range(r.randint(2, 9))) for _ in range(n))
    head, tail, other = words(1100), words(900), words(900)
    texts = [head + tail, head + other, words(1100) + tail, head[:300] + "x" + head[300:] + tail, head, "ab " * 12_000, "ab " * 11_999]
    labels = dedup.leader_cluster(spark.createDataFrame(list(enumerate(texts)), "ord int, text string").withColumn("block", F.lit(0)), "block", "ord", "text", 0.85)
    got = {x["ord"]: (x["leader"], x["similarity"]) for x in labels.collect()}
    assert {k: v for k, (v, _) in got.items()} == {0: 0, 1: 1, 2: 2, 3: 0, 4: 4, 5: 5, 6: 5}
    assert got[3][1] == dedup.block_ratio_of(texts[3], texts[0])


def test_leaders_by_index(spark, monkeypatch):
    """Runs and bands of lengths leave out no leader, at any threshold, and unrelated texts are not gone through n-gram by n-gram."""
    monkeypatch.setattr(dedup._Postings, "LAST", 3)
    monkeypatch.setattr(dedup._Postings, "FACTOR", 2)
    r = random.Random(5)
    letters = "aaaeeeiiooubcdfghjklmnpqrstvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,:;!? "
    base = ["".join(r.choice(letters) for _ in range(n)) for n in (4, 60, 210, 230, 260, 300, 330, 380)]
    texts = []
    for _ in range(90):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 1, len(t) // 20, len(t) // 12, len(t) // 6])):
            t[r.randrange(len(t))] = r.choice(letters)
        texts.append("".join(t)[: r.choice([len(t), len(t), len(t) * 4 // 5, len(t) * 3 // 4])])
    for need, absorb in ((0.85, False), (0.85, True), (0.6, False), (0.999, True), (1.0, False)):
        fast, plain = dedup._Leaders(need, None, absorb), []
        for i, t in enumerate(texts):
            pairs = ((n, dedup.block_ratio_of(x, t) if absorb else dedup.block_ratio_of(t, x)) for n, x in plain if 2 * min(len(x), len(t)) >= need * (len(x) + len(t)) - 1e-6)
            want = next(((n, s) for n, s in pairs if s >= need), None)
            assert fast.first(t) == want
            if want is None:
                fast.add(i, t)
                plain.append((i, t))
    many = dedup._Leaders(0.85, None, False)
    words = ["".join(r.choice(letters[:30]) for _ in range(r.randint(3, 9))) for _ in range(3000)]
    said = lambda: ". ".join(" ".join(r.choice(words) for _ in range(9)).capitalize() for _ in range(30))
    for i in range(80):
        many.add(i, said())
    looked, given = [], dedup._Postings.shared
    monkeypatch.setattr(dedup._Postings, "shared", lambda *x: looked.append(given(*x)) or looked[-1])
    assert many.first(said()) is None
    assert 0 < sum(x.sum() for x in looked) < 80 * 1900 / 20

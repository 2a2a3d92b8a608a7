"""Operators on documents against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewire.llm import bpe_automaton, decontaminate, line_dedup, ngram_join, substring_dedup
from tidewire.llm.queries import tokenizer_path

SPACE = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_line_dedup(docs, texts):
    lines = {d: (t or "").split("\n") for d, t in texts}
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)
    held = defaultdict(set)
    for d, ls in lines.items():
        for x in ls:
            if len(key(x)) >= 20:
                held[key(x)].add(d)
    bad = {k: max(v) for k, v in held.items() if len(v) >= 3}
    assert bad
    want = {}
    for d, ls in lines.items():
        kept = [x for x in ls if key(x) not in bad or bad[key(x)] == d]
        want[d] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "line_dedup"]
    got = {r["doc_id"]: (*r["line_dedup"], r["text"] or "") for r in out.collect()}
    assert got == want


def test_line_dedup_texts_of_one_id(spark):
    again, clean = "this line is found again and again", "this line is found only once, in {}"
    rows = spark.createDataFrame([(1, f"{again}\n{clean.format('a')}"), (1, f"{clean.format('b')}\n{again}"), (1, None), (2, again), (3, again)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"] or "", *r["line_dedup"]) for r in line_dedup.drop_repeated_lines(rows).collect())
    assert got == [(1, "", 1, 0), (1, clean.format("a"), 2, 1), (1, clean.format("b"), 2, 1), (2, "", 1, 1), (3, again, 1, 0)]


def test_line_dedup_long_text(spark):
    """A text that loses most of sixty thousand lines is rebuilt in one pass over them."""
    lines = [f"this is the repeated line {i % 100}" if i % 4 else f"line {i} of its own, kept" for i in range(60_000)]
    rows = spark.createDataFrame([(1, "\n".join(lines)), *[(k, "\n".join(f"this is the repeated line {i}" for i in range(100))) for k in (2, 3)]], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(rows).collect()}
    assert got[1]["text"] == "\n".join(x for x in lines if "repeated" not in x) and tuple(got[1]["line_dedup"]) == (60_000, 45_000)
    assert got[3]["line_dedup"]["n_dropped"] == 0


def test_line_dedup_repeated_and_null_ids(spark):
    line = "a line of over twenty characters"
    rows = spark.createDataFrame([(1, line), (1, line), (2, line), (None, line), (None, line)], "doc_id long, text string")
    assert [r["line_dedup"]["n_dropped"] for r in line_dedup.drop_repeated_lines(rows).collect()] == [0] * 5
    more = rows.unionByName(spark.createDataFrame([(3, line + "\n" + line)], "doc_id long, text string"))
    got = sorted(((r["doc_id"] or 0), r["line_dedup"]["n_dropped"]) for r in line_dedup.drop_repeated_lines(more).collect())
    assert got == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1), (3, 0)]


def brute_groups(texts, k, percent):
    sets = {}
    for d, t in texts:
        w = [x.translate(LOWER) for x in SPACE.findall(t or "")]
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_groups(docs, texts, k, percent):
    got = {r["d"]: (r["n_shingles"], r["component"]) for r in ngram_join.jaccard_groups(docs, k=k, percent=percent).collect()}
    assert got == brute_groups(texts, k, percent)


def test_jaccard_chunks_and_chains(spark, monkeypatch):
    """Chains of near copies over several chunks of a band, and a group far larger than a chunk."""
    monkeypatch.setattr(ngram_join, "CHUNK_ROWS", 64)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i // 3 : i // 3 + 100])) for i in range(600)] + [(1000 + i, " ".join(words[:99] + [f"z{i}"])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["d"]: (r["n_shingles"], r["component"]) for r in ngram_join.jaccard_groups(df, k=3, percent=90).collect()}
    assert got == brute_groups(rows, 3, 90)


@pytest.mark.parametrize(("rows_per_chunk", "percent"), [(16, 70), (32, 85)])
def test_jaccard_groups_over_chunks(spark, monkeypatch, rows_per_chunk, percent):
    """Groups of near copies over many chunks and two bands, close to others that don't link; memory steps smaller than a chunk."""
    monkeypatch.setattr(ngram_join, "CHUNK_ROWS", rows_per_chunk)
    monkeypatch.setattr(ngram_join, "STEP", 5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(4):
        base = words[60 * g : 60 * g + 60]
        rows += [(1000 * g + i, " ".join([*base[: i % 50], f"v{g}", *base[i % 50 + 1 :], *words[: i % 5]])) for i in range(60)]
        rows += [(1000 * g + 500 + i, " ".join([*base[:30], *(f"u{g}{i}{j}" for j in range(25 + i % 4))])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["d"]: (r["n_shingles"], r["component"]) for r in ngram_join.jaccard_groups(df, k=2, percent=percent).collect()}
    assert got == brute_groups(rows, 2, percent)


def test_tile_links_without_pairs_left():
    """A step all of whose pairs are joined already is passed over; links are the forest that is missing."""
    import numpy as np

    sets = [np.arange(100 + i % 2, dtype=np.uint64) for i in range(6)]
    assert ngram_join.tile_links(list(range(6)), sets, np.zeros(6, np.int64), 3, 90, False) == []
    assert len(ngram_join.tile_links(list(range(6)), sets, np.array([0, 0, 0, 1, 1, 1]), 3, 90, False)) == 1
    assert ngram_join.tile_links([7, 5, 6], sets[:3], np.array([7, 5, 6]), 3, 90, True) == [(7, 5), (7, 6)]


def test_jaccard_ids(spark):
    rows = spark.createDataFrame([(7, "a b c d"), (7, "x y z w"), (3, "x y z w"), (9, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    got = sorted((r["d"] or 0, r["component"] or 0) for r in ngram_join.jaccard_groups(rows, k=3, percent=90).collect())
    assert got == [(0, 0), (3, 3), (7, 3), (7, 3), (9, 3)]


def test_jaccard_ids_with_several_texts_of_one_size(spark):
    rows = spark.createDataFrame([(7, "a b c d e f"), (7, "m n o p q r"), (3, "a b c d e g"), (9, "m n o p q s"), (11, "x y z")], "doc_id long, text string")
    got = sorted((r["d"], r["component"]) for r in ngram_join.jaccard_groups(rows, k=1, percent=60).collect())
    assert got == [(3, 3), (7, 3), (7, 3), (9, 3), (11, 11)]


def brute_windows(texts, window):
    words = [(d, SPACE.findall(t or "")) for d, t in texts]
    counts = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("window", [35, 8, 3])
def test_substring_dedup(docs, texts, window):
    out = substring_dedup.drop_repeated_passages(docs, window=window)
    assert out.columns == [*docs.columns, "substring_dedup"]
    assert sorted((r["doc_id"], *r["substring_dedup"][:2], r["text"]) for r in out.collect()) == brute_windows(texts, window)


def test_substring_spans(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = spark.createDataFrame([(1, f"a b {passage} c"), (2, f"{passage} d {passage}"), (3, "e")], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: [tuple(s) for s in r["substring_dedup"]["spans"]] for r in substring_dedup.drop_repeated_passages(rows).collect()}
    assert got == {1: [(2, 51)], 2: [(0, 49), (51, 100)], 3: []}


def test_substring_heavy_anchor(docs, texts, monkeypatch):
    """Anchors over the limit are dealt by whole paths and still meet."""
    heavy = substring_dedup._heavy
    monkeypatch.setattr(substring_dedup, "_heavy", lambda rows, window, prefix, groups, limit: heavy(rows, window, prefix, groups, 20))
    out = substring_dedup.drop_repeated_passages(docs)
    assert sorted((r["doc_id"], *r["substring_dedup"][:2], r["text"]) for r in out.collect()) == brute_windows(texts, 35)


def test_repeated_survives_equal_sums():
    """Leaves that differ but add up to the same number hide no repeat, in whatever order they stand."""
    import numpy as np

    from tidewire.llm.words import mix

    path = np.array([5, 9, 5, 9, 5], dtype=np.uint64)
    anchor = np.array([100, 0, 100, 0, 100], dtype=np.uint64)
    anchor[[1, 3]] = anchor[0] + mix(path[:1])[0] - mix(path[1:2])[0]
    twice, one = substring_dedup.repeated(anchor, path)
    assert sorted(twice.tolist()) == [0, 1, 2, 3, 4] and len(one) == 2


def test_substring_repeated_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = spark.createDataFrame([(1, a), (1, a), (None, b), (None, b), (2, a + " " + b), (3, "c " * 36)], "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"] or 0, *r["substring_dedup"][:2]) for r in substring_dedup.drop_repeated_passages(rows).collect())
    assert got == [(0, 40, 40), (0, 40, 40), (1, 40, 40), (1, 40, 40), (2, 80, 80), (3, 36, 36)]


def brute_contamination(texts, items, window=13):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    grams = defaultdict(set)
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            grams[tuple(w[i : i + window])].add(str(item))
    out = []
    for d, t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if g := grams.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= g
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found)))))
    return sorted(out)


def test_decontamination(spark, docs, texts, monkeypatch):
    plain = dict(texts)
    words = plain[400].split()
    items = [(1, " ".join(words[12:40])), (2, "one"), (3, None), (4, ""), (10, " ".join(words[20:33]).upper() + "!"), (11, "x x x"), (12, " ".join(words[30:60])), (10, "no such words here")]
    bench = spark.createDataFrame([(i, t, "e") for i, t in items], "item_id long, text string, d string")
    index = decontaminate.build_index(docs)
    want = brute_contamination(texts, items)
    get = lambda: sorted((r["d"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.search(index, bench).collect())
    assert get() == want
    spans = {r["d"]: r["spans"] for r in decontaminate.search(index, bench).collect()}
    assert sum(s["last"] - s["first"] + 1 for s in spans[400]) == next(x[2] for x in want if x[0] == 400)
    monkeypatch.setattr(decontaminate, "QUERY_BYTES", 200)  # several parts
    monkeypatch.setattr(decontaminate, "HELD_MB", 0)
    assert get() == want


def test_decontamination_equal_segments(spark, monkeypatch):
    """Rows that are equal, in segments that are equal, stay as often as they come, however many parts the test set has."""
    monkeypatch.setattr(decontaminate, "QUERY_BYTES", 10)
    rows = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "a b c d")], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, "a b c d"), (2, "b c d"), (3, "c d e f g")], "item_id long, text string")
    got = [(r["d"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) for r in decontaminate.search(decontaminate.build_index(rows), items).collect()]
    assert got == [(1, 4, ["1", "2"], [(0, 3)])] * 3


def test_decontamination_slop_stays_in_a_document(spark):
    rows = spark.createDataFrame([(1, "x a"), (2, "b y"), (3, "a x b"), (4, "q a"), (5, "q q b a")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    got = {r["d"]: (r["n_items"], [tuple(s) for s in r["spans"]]) for r in decontaminate.search(decontaminate.build_index(rows), items, window=2, slop=1).collect()}
    assert got == {1: (0, []), 2: (0, []), 3: (1, [(1, 2)]), 4: (0, []), 5: (0, [])}


def test_decontamination_segments_and_proximity(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT_MB", 0)  # each document a segment of its own
    rows = spark.createDataFrame([(1, "a b c d"), (2, "a x b c d"), (3, None), (None, "d c b a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    index = decontaminate.build_index(rows)
    exact = {r["d"]: r["n_hit"] for r in decontaminate.search(index, items, window=4).collect()}
    near = {r["d"]: r["n_items"] for r in decontaminate.search(index, items, window=4, slop=1).collect()}
    assert exact == {1: 4, 2: 0, 3: 0, None: 0} and near == {1: 1, 2: 1, 3: 0, None: 0}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_bpe(docs, texts, library):
    out = bpe_automaton.digests(docs, tokenizer_path())
    assert out.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()}
    for d, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert got[d] == (len(ids), hashlib.sha256(raw).hexdigest(), sha(library.decode(ids, skip_special_tokens=False))), d


def test_bpe_hard_words(library):
    codec = bpe_automaton.codec(tokenizer_path())
    hard = ["aaaaaaaaaaaaaaaaaaaaaaa", "hahahahaha", "x" * 3000, "I'M can't WE'LL '’s", "<|startoftext|>Hi<|endoftext|> there", "ΑΣ ΟΔΟΣ Σ", "İ ß ŉ", "日本語 🎉👩‍👩‍👧", "a\x85b\x1cc d", "1234567890 ½²", "   ", "", "\u07fd\u0899\ua7da\U00010d50\U00018f19 x", "\u0558\u0561 \U0001e6c0a"]
    for t in hard:
        want = library.encode(t, add_special_tokens=False).ids
        ids = codec.encode_text(t)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want, t
        assert codec.decode_ids(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_round_trip_columns(docs, library):
    tokens = bpe_automaton.decode(bpe_automaton.encode(docs, tokenizer_path()), tokenizer_path())
    for r in tokens.select("text", "ids", "decoded").collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_automaton_is_bpe():
    """Small merge lists against merging by hand, over all words of three letters up to length six."""
    import itertools

    base = ["a", "b", "c"]
    for merges in ([("a", "a"), ("aa", "a"), ("b", "aa")], [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "ba")], [("a", "a"), ("aa", "aa"), ("b", "b"), ("bb", "aa")]):
        vocab = {s: i for i, s in enumerate([*base, *dict.fromkeys(a + b for a, b in merges)])}
        machine = bpe_automaton.Automaton(vocab, merges, "")
        for n in range(1, 7):
            for word in itertools.product(base, repeat=n):
                parts = list(word)
                while True:
                    pairs = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
                    if not pairs:
                        break
                    rank, _ = min(pairs)
                    i = 0
                    while i < len(parts) - 1:
                        if (parts[i], parts[i + 1]) == merges[rank]:
                            parts[i : i + 2] = [parts[i] + parts[i + 1]]
                        i += 1
                assert machine.encode(list(word)) == [vocab[p] for p in parts], (merges, word)


def test_empty_tables(none, spark):
    assert line_dedup.drop_repeated_lines(none).count() == 0
    assert ngram_join.jaccard_groups(none).count() == 0
    assert substring_dedup.drop_repeated_passages(none).count() == 0
    assert bpe_automaton.digests(none, tokenizer_path()).count() == 0
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.search(decontaminate.build_index(none), items).count() == 0
    one = none.sparkSession.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.search(decontaminate.build_index(one), items.where("false")).first()["n_hit"] == 0


def test_outputs_replace_columns_of_their_name(spark):
    rows = spark.createDataFrame([(1, "a", "old")], "doc_id long, text string, line_dedup string")
    assert line_dedup.drop_repeated_lines(rows).first()["line_dedup"]["n_lines"] == 1
    again = rows.withColumn("substring_dedup", F.lit(1))
    assert substring_dedup.drop_repeated_passages(again).first()["substring_dedup"]["n_words"] == 1

"""Registered corpus queries against SQL or brute force, and the pipeline as a whole."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_documents import brute_contamination, brute_groups

import corpus_pipeline
from tidewire.llm import queries, quality


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    want = con.execute(queries.ORACLE_SQL[name])
    names = sorted(x[0] for x in want.description)
    df = queries.QUERIES[name](spark, small)
    assert sorted(df.columns) == names
    norm = lambda data, cols: sorted((tuple(r[cols.index(n)] for n in names) for r in data), key=str)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(want.fetchall(), [x[0] for x in want.description])


def test_op4_against_brute_force(spark, small):
    texts = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op4_ngram_jaccard"](spark, small).collect()}
    assert got == brute_groups(texts, 3, 90)


def test_pipeline_against_brute_force(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = corpus_pipeline.run(spark, small)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    scorer = quality.fit(docs)[1]
    rows = [(d, t) for d, t in rows if scorer.score((t or "").encode()) >= quality.KEEP]
    held = {}
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(d)
    bad = {k: max(v) for k, v in held.items() if len(v) >= 3}
    rows = [(d, "\n".join(x for x in (t or "").split("\n") if bad.get(key(x), d) == d)) for d, t in rows]
    groups = brute_groups(rows, 5, 80)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {d: n_hit > 0 and 20 * n_hit >= n for d, n, n_hit, _, _ in brute_contamination(rows, items)}
    rows = [(d, t) for d, t in rows if not hit[d]]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in rows}
    assert {r["doc_id"]: r["ids"] for r in out.collect()} == want


def test_stages_keep_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = docs.withColumn("d", docs["doc_id"])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, small).columns == docs.columns
        assert stage(spark, docs.where("false"), small).count() == 0


def test_stages_take_awkward_rows(spark, docs, small):
    """Nulls, empty and long texts, ties and repeated rows go through every stage; a row without an id stays but for the classifier."""
    rows = docs.selectExpr("doc_id", "text", "'en' as lang", "cast(null as string) as source", "cast(null as bigint) as n_chars", "1 as d", "'x' as row", "2 as component", "3 as `a b`")
    rows = rows.unionByName(rows.limit(5)).unionByName(rows.limit(2).selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars", "d", "row", "component", "`a b`"))
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, rows, small)
        assert out.where("doc_id is null").count() == 2, name
        assert name != "line dedup" or out.count() == rows.count()
        again = stage(spark, stage(spark, rows.where("false"), small), small) if name != "BPE encoding and decoding" else out.where("false")
        assert again.count() == 0


def test_run_leaves_only_its_result(spark, small, tmp_path):
    from tidewire.llm import common

    mark = common.made()
    out = corpus_pipeline.run(spark, small)
    assert common.made() == mark + 1 and out.count() > 0
    common.clear(spark, mark)
    assert common.made() == mark

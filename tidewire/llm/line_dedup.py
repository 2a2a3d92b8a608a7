"""Line deduplication: lines are exploded, normalised and hashed, documents are counted per hash, and lines over the threshold go.

Plan: (hash, document) pairs, distinct within a row before they are exploded -> documents per hash (two partial aggregates, so a
line that every document holds is counted on the map side) -> the hashes over the threshold, joined back to the (hash, document,
position) rows by a sort-merge join that AQE can split -> positions to drop per document and text (64-bit hash) -> one join with the
texts. Texts cross the network once; lines themselves never do, only 16-byte hashes.

Cases: an input column named line_dedup is replaced; a null or empty text is one empty line; rows that share a doc_id count as one
document and lose the same keys, each at its own places; a row whose doc_id is null is no document: it isn't counted and stays as it is. Lines under min_chars never go. Further columns pass through,
whatever their names, as all work columns live in structs or are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, written


def _hashes(line):
    """A line's key as two independent 64-bit hashes; null for keys too short to count."""
    return F.struct(F.xxhash64(F.lit(11), line).alias("a"), F.xxhash64(F.lit(77), line).alias("b"))


def _key(line):
    return ascii_lower(F.trim(line, F.lit(SPACE)))


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """a, b (hash), keep (largest id), n_docs: the keys found in at least min_docs documents."""
    keys = F.filter(F.transform(_lines(F.col(text_col)), _key), lambda k: F.char_length(k) >= min_chars)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("d"), F.explode(F.transform(F.array_distinct(keys), _hashes)).alias("h"))
    return rows.groupBy(F.col("h.a").alias("a"), F.col("h.b").alias("b")).agg(F.count_distinct("d").alias("n_docs"), F.max("d").alias("keep")).where(F.col("n_docs") >= min_docs)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with text_col rebuilt from the lines that stay, plus line_dedup: struct<n_lines, n_dropped>.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. A key of at least min_chars code points
    in at least min_docs documents loses all its lines but those of the largest id that holds it.
    """
    bad = written(repeated_lines(docs, id_col, text_col, min_chars, min_docs), "lines")
    numbered = F.filter(F.transform(_lines(F.col(text_col)), lambda x, i: F.struct(i.alias("i"), _key(x).alias("k"))), lambda p: F.char_length(p["k"]) >= min_chars)
    hashed = F.transform(numbered, lambda p: F.struct(p["i"].alias("i"), F.xxhash64(F.lit(11), p["k"]).alias("a"), F.xxhash64(F.lit(77), p["k"]).alias("b")))
    # the text's hash is made once per text, below the rows of its lines
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("t"), hashed.alias("h")).select("d", "t", F.inline("h"))
    drops = (
        rows.join(bad, ["a", "b"])
        .where(F.col("d") != F.col("keep"))
        .groupBy("d", "t")
        .agg(F.collect_set("i").alias("at"))
    )
    left = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("d"), F.xxhash64(text_col).alias("t"))
    both = left.join(drops, ["d", "t"], "left")
    gone = F.coalesce(F.col("at"), F.array().cast("array<int>"))
    lines = _lines(F.col(f"row.`{text_col}`"))
    # places that stay or go, in order of place, beside the lines: linear in the lines but for the sort, however many go
    flag = lambda keep: lambda i: F.struct(i.alias("i"), F.lit(keep).alias("keep"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    flags = F.sort_array(F.concat(F.transform(gone, flag(False)), F.transform(stay, flag(True))))
    beside = F.filter(F.zip_with(lines, flags, lambda x, f: F.struct(x.alias("x"), f["keep"].alias("keep"))), lambda z: z["keep"])
    kept = F.when(F.size(gone) == 0, F.col(f"row.`{text_col}`")).otherwise(F.array_join(F.transform(beside, lambda z: z["x"]), "\n"))
    out = both.select("row", kept.alias("kept"), F.struct(F.size(lines).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped")).alias("line_dedup"))
    cols = [F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "line_dedup"]
    return out.select(*cols, "line_dedup")

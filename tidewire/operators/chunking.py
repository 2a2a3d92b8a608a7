"""Chunkers: fixed token windows in plain expressions, sentence packing and recursive splitting over whole texts in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.text import words


def token_windows(df: DataFrame, text_col: str, size: int = 400, step: int = 350) -> DataFrame:
    """chunk_index, total_chunks, chunk for each window of words; the last may lie inside the one before."""
    # the words are a column of their own: inside the lambda they would be cut anew for each window
    df = df.withColumn("_w", words(F.col(text_col)))
    starts = F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_c", F.transform(starts, lambda s: F.array_join(F.slice(F.col("_w"), s + 1, size), " ")))
    return df.select("*", F.size("_c").alias("total_chunks"), F.posexplode("_c").alias("chunk_index", "chunk")).drop("_c", "_w")


def pack_sentences(text: str, size: int = 512, overlap: int = 100) -> list[str]:
    """Sentences packed to size characters; a new chunk opens with the last overlap // 5 words of the one before."""
    if len(text) <= size:
        return [text] if text else []
    out: list[str] = []
    now = ""
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        if now and len(now) + len(sentence) > size:
            out.append(now.strip())
            tail = now.split()
            now = " ".join(tail[len(tail) - min(len(tail), overlap // 5) :]) + " " + sentence
        else:
            now = f"{now} {sentence}" if now else sentence
    if now:
        out.append(now.strip())
    return out


def _pieces(text: str, mark: str) -> list[str]:
    """text cut before each mark, which stays with what follows it."""
    if not mark:
        return list(text)
    cut = text.split(mark)
    return [x for x in [cut[0], *[mark + c for c in cut[1:]]] if x]


def split_recursively(text: str, size: int = 2000, overlap: int = 500, marks: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most size characters: cut at the coarsest mark there is, finer where a piece is too long, packed with overlap."""
    k = next((i for i, m in enumerate(marks) if m in text), len(marks) - 1)
    finer = marks[k + 1 :]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        joined = "".join(held).strip()
        if joined:
            out.append(joined)

    width = 0
    for piece in _pieces(text, marks[k]):
        if len(piece) >= size and finer:
            flush()
            held, width = [], 0
            out.extend(split_recursively(piece, size, overlap, finer))
            continue
        if held and width + len(piece) > size:
            flush()
            while held and (width > overlap or width + len(piece) > size):
                width -= len(held.pop(0))
        held.append(piece)
        width += len(piece)
    flush()
    return out


#: Characters of chunks that leave a Python worker together, about.
TOGETHER = 1 << 20


def _chunks(df: DataFrame, text_col: str, cut) -> DataFrame:
    """df plus chunk_index, total_chunks, chunk. Chunks leave the worker as they come, so it holds some texts' at a time, not a batch's."""
    kind, at = df.schema, df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            texts, first, held, size = rows.field(at), 0, [], 0
            for i in range(len(rows)):
                held.append(cut(texts[i].as_py() or ""))
                size += sum(map(len, held[-1]))
                if size >= TOGETHER or i + 1 == len(rows):
                    yield pa.record_batch([rows.slice(first, len(held)), pa.array(held, pa.list_(pa.string()))], names=["row", "_c"])
                    first, held, size = i + 1, [], 0

    out = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).mapInArrow(run, T.StructType([T.StructField("row", kind), T.StructField("_c", T.ArrayType(T.StringType()))]))
    return out.select("row.*", F.size("_c").alias("total_chunks"), F.posexplode("_c").alias("chunk_index", "chunk"))


def sentence_chunks(df: DataFrame, text_col: str, size: int = 512, overlap: int = 100) -> DataFrame:
    """pack_sentences() of each text: one pass over its sentences, as a fold in expressions would copy the chunks so far at each step."""
    return _chunks(df, text_col, lambda t: pack_sentences(t, size, overlap))


def recursive_chunks(df: DataFrame, text_col: str, size: int = 2000, overlap: int = 500) -> DataFrame:
    return _chunks(df, text_col, lambda t: split_recursively(t, size, overlap))


def chunk_id(doc: Column, index: Column, text: Column) -> Column:
    """The same for the same input, unlike a clock's."""
    return F.sha2(F.concat_ws("|", doc.cast("string"), index.cast("string"), text), 256)

"""Links of PDF files, read from the file's own objects; page text is a boundary (parse)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import collapse

from .schemas import BLOCKS

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_URI = re.compile(rb"/URI\s*\(((?:\\.|[^\\)])*)\)", re.S)
_RECT = re.compile(rb"/Rect\s*\[([^\]]*)\]")


def _objects(raw: bytes) -> dict[int, bytes]:
    """Object bodies by number, those in compressed object streams included."""
    found = {}
    for m in _OBJECT.finditer(raw):
        body = m[2]
        found[int(m[1])] = body
        if b"/ObjStm" in body and (s := _STREAM.search(body)):
            try:
                data = zlib.decompress(s[1]) if b"FlateDecode" in body else s[1]
            except zlib.error:
                continue
            first = int(re.search(rb"/First\s+(\d+)", body)[1])
            heads = [int(x) for x in data[:first].split()]
            pairs = list(zip(heads[::2], heads[1::2], strict=False))
            for (n, at), nxt in zip(pairs, [*pairs[1:], (0, len(data) - first)], strict=True):
                found.setdefault(n, data[first + at : first + nxt[1]])
    return found


def _pages(objects: dict[int, bytes]) -> list[bytes]:
    """Page objects in reading order."""
    out: list[bytes] = []
    seen: set[int] = set()

    def walk(n: int) -> None:
        body = objects.get(n, b"")
        if n in seen:
            return
        seen.add(n)
        if re.search(rb"/Type\s*/Pages\b", body):
            kids = re.search(rb"/Kids\s*\[([^\]]*)\]", body)
            for r in _REF.finditer(kids[1] if kids else b""):
                walk(int(r[1]))
        elif re.search(rb"/Type\s*/Page\b", body):
            out.append(body)

    children = {int(r[1]) for b in objects.values() if (k := re.search(rb"/Kids\s*\[([^\]]*)\]", b)) for r in _REF.finditer(k[1])}
    for n, body in objects.items():
        if re.search(rb"/Type\s*/Pages?\b", body) and n not in children:
            walk(n)
    return out


def links_of(raw: bytes) -> list[tuple[int, str, tuple[float, float, float, float]]]:
    """(page from 1, URI, rectangle) of each link annotation that isn't a mail address."""
    objects, out = _objects(raw), []
    for number, page in enumerate(_pages(objects), 1):
        if not (m := re.search(rb"/Annots\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page, re.S)):
            continue
        listed = m[1]
        if not listed.startswith(b"["):
            listed = objects.get(int(_REF.match(listed)[1]), b"")
        for r in _REF.finditer(listed):
            note = objects.get(int(r[1]), b"")
            if a := re.search(rb"/A\s+(\d+)\s+\d+\s+R", note):
                note += objects.get(int(a[1]), b"")
            if not (u := _URI.search(note)) or not re.search(rb"/Subtype\s*/Link\b", note):
                continue
            uri = re.sub(rb"\\(.)", rb"\1", u[1]).decode("latin-1")
            if uri.lower().startswith("mailto:"):
                continue
            box = _RECT.search(note)
            sides = [float(x) for x in box[1].split()] if box else [0.0] * 4
            out.append((number, uri, tuple(sides[:4])))
    return out


def read_links(files: DataFrame) -> DataFrame:
    """file, Page, URL, Rect of the links of files (path, content), as read_binary() gives them; a broken file has none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for page, uri, (x0, y0, x1, y1) in links_of(content or b""):
                    rows.append((path, page, uri, {"x0": x0, "y0": y0, "x1": x1, "y1": y1}))
            yield pd.DataFrame(rows, columns=["file", "Page", "URL", "Rect"])

    return files.select("path", "content").mapInPandas(run, "file string, Page int, URL string, Rect struct<x0:double,y0:double,x1:double,y1:double>")


def read_blocks(files: DataFrame, parse: Callable[[bytes], list[tuple[int, int, str]]]) -> DataFrame:
    """BLOCKS of files (path, content) by parse(content) -> [(page, block_no, text)], the boundary to a PDF library."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(path, *block) for path, content in zip(pdf["path"], pdf["content"], strict=True) for block in parse(content or b"")]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in BLOCKS.split(", ")])

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def link_context(links: DataFrame, words: DataFrame, wide: float = 30.0, high: float = 10.0) -> DataFrame:
    """links (file, Page, URL, Rect) plus Context: the words whose box meets the link's rectangle grown by wide and high, in reading order.

    words: file, page, no (reading order), x0, y0, x1, y1, word, in the rectangles' coordinates, from the caller's PDF library. Links
    meet the words of their own page alone; one without any has ''.
    """
    r, w = F.col("l.Rect"), lambda c: F.col(f"w.{c}")
    meets = (w("x1") > r["x0"] - wide) & (w("x0") < r["x1"] + wide) & (w("y1") > r["y0"] - high) & (w("y0") < r["y1"] + high)
    numbered = links.withColumn("_k", F.xxhash64("file", "Page", "URL", "Rect"))
    met = numbered.alias("l").join(words.alias("w"), (F.col("l.file") == w("file")) & (F.col("l.Page") == w("page")) & meets)
    lines = met.select("l._k", w("no").alias("no"), w("word").alias("word")).distinct().groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("no", "word"))).alias("ws"))
    text = F.array_join(F.transform("ws", lambda x: x["word"]), " ")
    return numbered.join(lines, "_k", "left").withColumn("Context", collapse(text)).drop("_k", "ws")

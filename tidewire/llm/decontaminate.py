"""Benchmark decontamination by a distributed positional inverted index of the training tokens.

build_index() turns documents into segments, one row each: the segment's sorted terms and, for each term, the postings of all its
tokens as positions on one axis on which documents lie end to end with a gap between them. A segment holds whole documents of at
most SEGMENT_MB of text (a longer document is a segment of its own), so the index is partitioned by document, needs no shuffle, and
a term that stands everywhere is nowhere a hot key. The index is written to the shared folder, and any number of searches read it.

search() compiles the test windows (bounded, see below) to term numbers, and in each segment

* looks their terms up by binary search and drops, for all windows at once, those with a term that the segment lacks;
* for each other window takes the postings of its rarest term here, shifted back by the term's place in the window, and intersects
  them with the shifted postings of the others, from rare to frequent, until nothing is left or the phrase stands;
* for proximity (slop > 0) lets every further term stand up to slop positions off its place, within the document of the rarest term.

Test sets of any size take one way: executors compile them to parts of about QUERY_BYTES of text in the shared folder. A task holds
HELD_MB of segments, loads one part after another and adds up the parts' hits per segment in place, so the index is scanned once,
nothing is merged by a shuffle and the driver sees only the parts' file names.

Cases: null or empty text: no words; an item with fewer words than the window, but some, is one window; without words, none; rows
that share an id, or are equal, are judged row by row; equal windows of several items count for each of them; null ids stay; a null
item id counts as ''. Item ids are compared as strings. Further columns of either table don't take part.
"""

from __future__ import annotations

import pickle
import uuid
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, shared_folder, ship, written

SEGMENT_MB = 4
#: Bytes of test text that are compiled to one part.
QUERY_BYTES = 2 << 20
#: Megabytes of segments that a task holds while it goes through the parts of the test set.
HELD_MB = 48
#: Maps every ASCII byte that is no word character to a space and A-Z to a-z; words are then [0-9a-z] and all bytes from 0x80 on.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def word_list(text: bytes) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text whose A-Z are lower-cased."""
    return text.translate(_WORD).split()


class Segment:
    """Postings of some documents."""

    def __init__(self, terms: list[bytes], offsets: np.ndarray, postings: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.terms, self.offsets, self.postings, self.starts, self.lengths = terms, offsets, postings, starts, lengths

    @classmethod
    def of(cls, texts: list[list[bytes]]) -> Segment:
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)  # a gap of one between documents
        number: dict[bytes, int] = defaultdict(lambda: len(number))
        total = int(lengths.sum())
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), dtype=np.int32, count=total)
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64), lengths) + np.arange(total)
        names = list(number)
        by_name = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), dtype=np.int32)
        rank[by_name] = np.arange(len(names), dtype=np.int32)
        ids = rank[ids] if total else ids
        order = np.argsort(ids, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(names)))]).astype(np.int32)
        return cls([names[i] for i in by_name], offsets, at[order].astype(np.int32), starts, lengths)

    def to_row(self) -> dict[str, bytes]:
        return {"terms": b" ".join(self.terms), "offsets": self.offsets.tobytes(), "postings": self.postings.tobytes(), "starts": self.starts.tobytes(), "lengths": self.lengths.tobytes()}

    @classmethod
    def from_row(cls, row: dict[str, bytes]) -> Segment:
        return cls(row["terms"].split(b" ") if row["terms"] else [], np.frombuffer(row["offsets"], np.int32), np.frombuffer(row["postings"], np.int32), np.frombuffer(row["starts"], np.int64), np.frombuffer(row["lengths"], np.int64))

    def rank(self, wanted: list[bytes]) -> np.ndarray:
        """The number here of each of the sorted terms wanted, or -1: a merge by binary search."""
        out, at, terms = np.full(len(wanted), -1, dtype=np.int64), 0, self.terms
        for i, w in enumerate(wanted):
            at = bisect_left(terms, w, at)
            if at == len(terms):
                break
            if terms[at] == w:
                out[i] = at
        return out

    def of_term(self, k: int) -> np.ndarray:
        return self.postings[self.offsets[k] : self.offsets[k + 1]]


class Queries:
    """Distinct windows as rows of term numbers, padded with -1, and the items that hold each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        grams: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, words in items:
            for i in range(max(1, len(words) - window + 1)) if words else ():
                grams[tuple(words[i : i + window])].add(item)
        self.items = [sorted(v) for v in grams.values()]
        self.terms = sorted({w for g in grams for w in g})
        number = {w: i for i, w in enumerate(self.terms)}
        self.windows = np.full((len(grams), window), -1, dtype=np.int64)
        for row, g in enumerate(grams):
            self.windows[row, : len(g)] = [number[w] for w in g]
        self.sizes = np.array([len(g) for g in grams], dtype=np.int64)

    def matches(self, segment: Segment, slop: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(window, first positions, positions after the last, documents) of each window that occurs in the segment."""
        if not len(self.windows):
            return
        here = segment.rank(self.terms)
        sizes = np.append(np.diff(segment.offsets), 0).astype(np.int64)  # the last entry stands for terms that are not here
        counts = sizes[here]
        inside = self.windows >= 0
        rows = np.where(inside, counts[self.windows], np.iinfo(np.int64).max)
        for q in np.flatnonzero(rows.min(axis=1) > 0).tolist():
            order = np.argsort(rows[q], kind="stable")[: self.sizes[q]].tolist()
            rare = segment.of_term(here[self.windows[q, order[0]]])
            owner = np.searchsorted(segment.starts, rare, side="right") - 1
            low, high = segment.starts[owner].astype(np.int32), (segment.starts + segment.lengths)[owner].astype(np.int32)
            found = rare - np.int32(order[0])
            for place in order[1:]:
                other = segment.of_term(here[self.windows[q, place]])
                # a phrase has its words next to each other, so the gap between documents keeps it in one; with slop, bounds do
                first = np.maximum(found + place - slop, low)
                k = np.minimum(np.searchsorted(other, first), len(other) - 1)
                keep = (other[k] >= first) & (other[k] <= np.minimum(found + place + slop, high - 1))
                if not keep.all():
                    found, owner, low, high = found[keep], owner[keep], low[keep], high[keep]
                if not len(found):
                    break
            if len(found):
                yield q, np.maximum(found, low), np.minimum(found + int(self.sizes[q]), high), owner


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of the positional index, written to the shared folder."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"ids array<{kind}>, terms binary, offsets binary, postings binary, starts binary, lengths binary"
    names = ["terms", "offsets", "postings", "starts", "lengths"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, texts, size, first = batch.column("d"), [], 0, 0

            def segment(first: int, texts: list[list[bytes]], column: pa.Array = column) -> pa.RecordBatch:
                row = Segment.of(texts).to_row()
                ids = pa.array([column.slice(first, len(texts)).to_pylist()], type=pa.list_(column.type))
                return pa.record_batch([ids, *[pa.array([row[n]], type=pa.binary()) for n in names]], names=["ids", *names])

            for i, text in enumerate(byte_rows(batch.column("t"))):
                if texts and size + len(text) > SEGMENT_MB << 20:
                    yield segment(first, texts)
                    texts, size, first = [], 0, i
                texts.append(word_list(text))
                size += len(text)
            if texts:
                yield segment(first, texts)

    return written(docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).mapInArrow(build, schema), "postings")


def compile_tests(items: DataFrame, id_col: str, text_col: str, window: int) -> tuple[str, list[str]]:
    """(folder, file names): the test set as compiled parts of about QUERY_BYTES of text, made and written by executors."""
    folder = shared_folder(items.sparkSession, "tests")
    text = F.col(f"`{text_col}`")
    size = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bound = max(1, QUERY_BYTES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        part, held, names = [], 0, []

        def close() -> None:
            name = uuid.uuid4().hex
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(pickle.dumps(Queries(part, window), protocol=5))
            names.append(name)

        for batch in batches:
            for item, raw in zip(batch.column("i").to_pylist(), byte_rows(batch.column("t")), strict=True):
                if part and held + len(raw) > bound:
                    close()
                    part, held = [], 0
                part.append((item or "", word_list(raw)))
                held += len(raw)
        if part:
            close()
        # only names of tasks that committed reach the table, so a retry leaves no part twice
        yield pa.record_batch([pa.array(names, pa.string())], names=["name"])

    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("i"), text.alias("t")).repartition(max(1, -(-size // bound)))
    return folder, sorted(r[0] for r in written(rows.mapInArrow(pack, "name string"), "parts").collect())


_LAST: dict[str, Queries] = {}


def _load(folder: str, name: str) -> Queries:
    """A compiled part; a worker keeps the last one."""
    if name not in _LAST:
        fs, base = pafs.FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
            found = pickle.loads(f.read())
        _LAST.clear()
        _LAST[name] = found
    return _LAST[name]


class Hits:
    """What the parts of a test set hit in one segment."""

    def __init__(self, segment: Segment):
        self.segment, self.total = segment, int(segment.starts[-1] + segment.lengths[-1]) + 1
        self.edges = np.zeros(self.total + 1, dtype=np.int32)
        self.items: dict[int, set[str]] = defaultdict(set)

    def add(self, queries: Queries, slop: int) -> None:
        for q, first, after, owner in queries.matches(self.segment, slop):
            np.add.at(self.edges, first, 1)
            np.add.at(self.edges, after, -1)
            for d in np.unique(owner).tolist():
                self.items[d].update(queries.items[q])

    def spans(self) -> dict[int, list[dict[str, int]]]:
        """Runs of hit words per document: hit is what lies where more windows have begun than ended."""
        hit = np.cumsum(self.edges)[: self.total] > 0
        ends = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        first, last = np.flatnonzero(ends == 1), np.flatnonzero(ends == -1) - 1
        owner = np.searchsorted(self.segment.starts, first, side="right") - 1
        out: dict[int, list[dict[str, int]]] = defaultdict(list)
        for o, a, b in zip(owner.tolist(), first.tolist(), last.tolist(), strict=True):
            base = int(self.segment.starts[o])
            out[o].append({"first": a - base, "last": b - base})
        return out


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 13, slop: int = 0) -> DataFrame:
    """d, n_words, n_hit, n_items, items_sha256, items (array), spans (array of struct<first, last>: hit words, from 0) per document."""
    id_kind = index.schema["ids"].dataType.elementType.simpleString()
    out_schema = f"d {id_kind}, n_words long, items array<string>, spans array<struct<first:int,last:int>>"
    span_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    ship(index.sparkSession)
    folder, parts = compile_tests(items, id_col, text_col, window)

    def judged(held: list[tuple[pa.Array, Hits]]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            queries = _load(folder, part)
            for _, hits in held:
                hits.add(queries, slop)
        for ids, hits in held:
            spans, n = hits.spans(), len(hits.segment.lengths)
            found = pa.array([sorted(hits.items.get(k, ())) for k in range(n)], type=pa.list_(pa.string()))
            yield pa.record_batch([ids, pa.array(hits.segment.lengths), found, pa.array([spans.get(k, []) for k in range(n)], type=span_type)], names=["d", "n_words", "items", "spans"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("terms", "offsets", "postings", "starts", "lengths")}
                held.append((batch.column("ids")[i].values, Hits(Segment.from_row(row))))
                size += 2 * len(row["postings"]) + len(row["terms"])
                if size > HELD_MB << 20:
                    yield from judged(held)
                    held, size = [], 0
        yield from judged(held)

    found = index.mapInArrow(look, out_schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return found.select("d", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "items", "spans")


def contaminated(n_hit, n_words):
    """At least a twentieth of the words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)

"""Substring deduplication: windows of words dealt to groups by an anchor, and found equal within a group by sorting their hashes.

The passages sought are windows of `window` words that stand at two places or more. A group stands for a subtree of a suffix tree cut off at
that depth, below which nothing more has to be told apart. Suffix trees are not built (the README says why): a group's leaves, the hashes of
whole windows, are sorted, equal ones are the repeats, and runs of such windows along a document are the maximal repeats.

Suffixes are dealt to subtrees by content. The least of the hashes of all PREFIX-word sequences that start in a window's first
window - PREFIX + 1 places is the window's anchor; equal windows have equal anchors, wherever they stand, and consecutive windows
mostly share theirs. A subtree holds the windows of one anchor: all hold the same PREFIX words somewhere, not as their prefix. So a row of about fifteen
windows is sent once with its anchor instead of each suffix with a path of its own.

Groups fit into memory: anchors are counted over all documents first, and dealt to groups of about GROUP_MB of leaves; an anchor
that alone has more leaves than half a group is dealt by the hash of the whole window, so its leaves spread over all groups while equal windows
still meet. There are at most twice as many such anchors as groups, and never more than MAX_HEAVY, so what comes to the driver and is
broadcast has a bound of 8 bytes times MAX_HEAVY. For that, the limit rises with the text beyond 2.5 TB; at some 25 TB a group of one
anchor may have 12 million leaves, which an executor of 3 GB still sorts.

A leaf is sent as the 48-bit hash of its path of `window` words; with the 64-bit anchor that makes 112 bits. Each task first builds
the subtrees of its own batch: of windows that stand twice in it one leaf goes on, so a passage in a third of all documents sends as
many leaves as there are batches.

Rows are told apart by the hashes of id and text: rows equal in both repeat each other anyhow and share their repeats.

Cases: null or empty text: no words; fewer words than the window: nothing goes; rows that share an id are judged as texts of their
own (a window in both repeats); null ids and further columns pass through; an input column named substring_dedup is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, ship, with_row
from .words import hash_words, mix, run_hashes

PREFIX = 8
GROUP_MB = 16
#: Words whose trees a task builds at once before it sends leaves.
BATCH_WORDS = 800_000
PATH = np.uint64((1 << 48) - 1)
MAX_HEAVY = 1 << 20


def anchors(hashes: np.ndarray, window: int, prefix: int) -> np.ndarray:
    """For each window the least hash of the prefix-word sequences that lie in it."""
    least = run_hashes(hashes, prefix, seed=5)
    span, width = window - prefix + 1, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        width += step
    return least


def repeated(anchor: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subtrees of all anchors at once: (leaves whose full-depth node has another leaf, one leaf of each node)."""
    mixed = anchor + mix(path)
    order = np.argsort(mixed)  # equal leaves come together
    a, p = anchor[order], path[order]
    same = (a[1:] == a[:-1]) & (p[1:] == p[:-1])
    if (~same & (mixed[order][1:] == mixed[order][:-1])).any():  # different leaves of one sum could stand between equal ones
        order = np.lexsort((path, anchor))
        a, p = anchor[order], path[order]
        same = (a[1:] == a[:-1]) & (p[1:] == p[:-1])
    twice = np.zeros(len(a), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    one = np.ones(len(a), dtype=bool)
    one[1:] = ~same
    return order[twice], order[one]


def _pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _runs(sorted_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of consecutive numbers."""
    if not len(sorted_at):
        return sorted_at, sorted_at
    cut = np.flatnonzero(np.diff(sorted_at) != 1) + 1
    starts = sorted_at[np.concatenate([[0], cut])]
    return starts, np.diff(np.concatenate([[0], cut, [len(sorted_at)]]))


_LEAVES = pa.schema([("grp", pa.int32()), ("rows", pa.binary()), ("anchor", pa.binary()), ("path", pa.binary()), ("known", pa.binary()), ("at", pa.binary())])
_LEAVES_SQL = "grp int, rows binary, anchor binary, path binary, known binary, at binary"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[np.ndarray]]]:
    """Row keys and word hashes of about BATCH_WORDS words at a time."""
    keys, words, size = [], [], 0
    for batch in batches:
        names = np.stack([batch.column("k1").to_numpy(), batch.column("k2").to_numpy()], axis=1).astype(">i8").tobytes()
        for i, text in enumerate(byte_rows(batch.column("t"))):
            w = hash_words(text.split())
            keys.append(names[16 * i : 16 * i + 16])
            words.append(w)
            size += len(w)
            if size >= BATCH_WORDS:
                yield keys, words
                keys, words, size = [], [], 0
    yield keys, words


def _windows(words: list[np.ndarray], window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    empty = np.empty(0, np.uint64)
    words = [w for w in words if len(w) >= window]
    return np.concatenate([anchors(w, window, prefix) for w in words] or [empty]), np.concatenate([run_hashes(w, window, seed=9) for w in words] or [empty]) & PATH


def _leaves(keys: list[bytes], words: list[np.ndarray], window: int, prefix: int, groups: int, heavy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for the groups of a batch's leaves; groups below 0 hold the windows that repeat within the batch."""
    per = np.array([max(0, len(w) - window + 1) for w in words], dtype=np.int64)
    anchor, path = _windows(words, window, prefix)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), per)
    at = (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)).astype(np.int32)
    twice, one = repeated(anchor, path)
    known = np.zeros(len(anchor), dtype=bool)
    known[twice] = True
    out: list[tuple] = []
    where = np.flatnonzero(known)
    if len(where):
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner[where])) + 1, [len(where)]])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            o = int(owner[where[s]])
            out.append((-1 - int.from_bytes(keys[o][8:12], "little") % groups, keys[o], None, None, None, _pack(np.stack(_runs(at[where[s:e]])).astype(np.int32))))
    # leaves in order of place, so that windows next to each other share an anchor
    one = np.sort(one)
    deal = mix(anchor[one])
    if len(heavy):
        k = np.minimum(np.searchsorted(heavy, anchor[one]), len(heavy) - 1)
        deal = np.where(heavy[k] == anchor[one], mix(deal + path[one]), deal)
    group = (deal % np.uint64(groups)).astype(np.int32)
    order = np.argsort(group, kind="stable")
    one, group = one[order], group[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]) if len(group) else np.zeros(1, np.int64)
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        leaves = one[s:e]
        new = np.ones(len(leaves), dtype=bool)
        new[1:] = (anchor[leaves[1:]] != anchor[leaves[:-1]]) | (leaves[1:] != leaves[:-1] + 1) | (owner[leaves[1:]] != owner[leaves[:-1]])
        first = np.flatnonzero(new)
        rows, small = np.unique(owner[leaves[first]], return_inverse=True)
        runs = np.stack([small.astype(np.int32), at[leaves[first]], np.diff(np.concatenate([first, [len(leaves)]])).astype(np.int32)])
        raw = path[leaves].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        out.append((int(group[s]), b"".join([keys[r] for r in rows.tolist()]), _pack(anchor[leaves[first]]), _pack(raw), _pack(np.packbits(known[leaves])), _pack(runs)))
    for s in range(0, len(out), 4096):
        yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*out[s : s + 4096], strict=True), _LEAVES, strict=True)], schema=_LEAVES)


def _subtrees(pdf: pd.DataFrame) -> pd.DataFrame:
    """A group's repeats: row key, runs of window starts. Groups below 0 bring theirs with them."""
    if pdf["grp"].iloc[0] < 0:
        return pd.DataFrame({"key": pdf["rows"], "at": pdf["at"]})
    anchor, path, known, row, at, keys, seen = [], [], [], [], [], [], 0
    for r in pdf.itertuples():
        runs = np.frombuffer(r.at, np.int32).reshape(3, -1).astype(np.int64)
        leaves = int(runs[2].sum())
        raw = np.zeros((leaves, 8), dtype=np.uint8)
        raw[:, :6] = np.frombuffer(r.path, np.uint8).reshape(-1, 6)
        path.append(raw.view("<u8").ravel())
        anchor.append(np.repeat(np.frombuffer(r.anchor, np.uint64), runs[2]))
        known.append(np.unpackbits(np.frombuffer(r.known, np.uint8), count=leaves).astype(bool))
        row.append(np.repeat((runs[0] + seen).astype(np.int32), runs[2]))
        at.append((np.repeat(runs[1] - np.cumsum(runs[2]) + runs[2], runs[2]) + np.arange(leaves)).astype(np.int32))
        keys.append(r.rows)
        seen += len(r.rows) // 16
    anchor, path, known, row, at, names = np.concatenate(anchor), np.concatenate(path), np.concatenate(known), np.concatenate(row), np.concatenate(at), b"".join(keys)
    twice, _ = repeated(anchor, path)
    twice = twice[~known[twice]]
    order = np.lexsort((at[twice], row[twice]))
    row, at = row[twice][order], at[twice][order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]]).tolist() if len(row) else [0]
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    return pd.DataFrame({"key": pd.Series([names[16 * row[s] : 16 * row[s] + 16] for s, _ in spans], dtype=object), "at": pd.Series([_pack(np.stack(_runs(at[s:e])).astype(np.int32)) for s, e in spans], dtype=object)})


def _heavy(rows: DataFrame, window: int, prefix: int, groups: int, limit: int) -> np.ndarray:
    """The anchors with more than limit different windows per batch in sum, sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in _batches(batches):
            anchor = np.sort(_windows(words, window, prefix)[0])
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.empty(0, np.int64)
            counts = np.diff(np.concatenate([first, [len(anchor)]])).astype(np.int32)
            group = (mix(anchor[first]) % np.uint64(groups)).astype(np.int32)
            order = np.argsort(group, kind="stable")
            group, a, c = group[order], anchor[first][order], counts[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]).tolist() if len(group) else [0]
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.record_batch([pa.array([int(group[s]) for s, _ in spans], pa.int32()), pa.array([_pack(a[s:e]) for s, e in spans], pa.binary()), pa.array([_pack(c[s:e]) for s, e in spans], pa.binary())], names=["grp", "anchor", "n"])

    def over(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["anchor"]])
        n = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["n"]])
        order = np.argsort(a)
        a, n = a[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        total = np.add.reduceat(n.astype(np.int64), first)
        return pd.DataFrame({"anchor": a[first][total > limit].astype(np.int64)})

    found = rows.mapInArrow(count, "grp int, anchor binary, n binary").groupBy("grp").applyInPandas(over, "anchor long").collect()
    return np.sort(np.array([r[0] for r in found], dtype=np.int64).astype(np.uint64))


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """docs with text_col made of the words that stay, joined by one space, plus substring_dedup: struct<n_words, n_removed, spans>.

    spans are the maximal repeats: runs of words that go, first to last, from 0.

    Words are [^\\x20\\x09-\\x0D]+. A word goes if a window of `window` consecutive words of its document that covers it also starts
    at another place of any document.
    """
    spark = docs.sparkSession
    ship(spark)
    prefix = min(PREFIX, window)
    kept = [c for c in docs.columns if c != "substring_dedup"]
    text = F.col(f"`{text_col}`")
    keyed = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(3), F.col(f"`{id_col}`")).alias("k2"), text.alias("t"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size * 1.2) // (GROUP_MB << 20)))
    # words are at most half the bytes, and an anchor over the limit has more windows than that
    limit = max((GROUP_MB << 20) // 14, size // 2 // MAX_HEAVY)
    heavy = spark.sparkContext.broadcast(_heavy(keyed, window, prefix, groups, limit))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, words in _batches(batches):
            yield from _leaves(keys, words, window, prefix, groups, heavy.value)

    repeats = keyed.mapInArrow(leaves, _LEAVES_SQL).groupBy("grp").applyInPandas(_subtrees, "key binary, at binary")
    per_row = repeats.groupBy("key").agg(F.collect_list("at").alias("at"))
    key = F.unhex(F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(3), F.col(f"`{id_col}`")).alias("k2"))
    joined = rows.select("row", key.alias("key")).join(per_row, "key", "left").select("row", F.col(f"row.`{text_col}`").alias("t"), "at")

    span_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed, spans = [], [], [], []
            for text, runs in zip(byte_rows(batch.column("t")), batch.column("at").to_pylist(), strict=True):
                words = text.split()
                n_words.append(len(words))
                if runs:
                    edge = np.zeros(len(words) + 1, dtype=np.int32)
                    for r in runs:
                        starts, lengths = np.frombuffer(r, np.int32).reshape(2, -1)
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + lengths + window - 1, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    n_removed.append(int(gone.sum()))
                    cuts = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    spans.append([{"first": a, "last": b - 1} for a, b in zip(cuts[::2].tolist(), cuts[1::2].tolist(), strict=True)])
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    n_removed.append(0)
                    spans.append([])
                texts.append(b" ".join(words).decode())
            yield pa.record_batch([batch.column("row"), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span_type)], names=["row", "kept", "n_words", "n_removed", "spans"])

    out = joined.mapInArrow(cut, with_row(rows, "kept string, n_words long, n_removed long, spans array<struct<first:int,last:int>>"))
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in kept], F.struct("n_words", "n_removed", "spans").alias("substring_dedup"))

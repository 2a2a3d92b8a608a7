"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection of sorted arrays.

1. Each text becomes its set of k-word shingles (64-bit hashes). Equal sets meet in one representative, the smallest id (a partial
   aggregate), so a text copied a million times is compared once.
2. Signatures: shingle h toggles bit h mod m of an m-bit map, m a power of two of about the set's size. Two maps differ in at most
   |A ^ B| bits, so |A ∩ B| <= (|A| + |B| - differing bits) / 2: bit counts bound the overlap from above.
3. Bands: sizes a <= b can link only if a >= t b, so with bands of ratio 1 / t partners lie in the same or the next band. A band's
   rows, in order of their least shingle hash (which near copies mostly share), are cut into chunks of at most CHUNK_ROWS rows and
   about CHUNK_MB of arrays, packed to one row each; a tile is a pair of chunks. Only signatures, about an eighth of a byte per word,
   are sent to tiles.
4. Tiles report the ids that have a partner within the bound. Texts of those alone are shingled again and sent, as sorted arrays,
   to the tiles that asked for them, where exact intersections find links; pairs that links already join are not tested, and a
   tile sends at most one link per row. Tiles of one chunk go first, so near copies that lie side by side are joined there. Tiles of
   two chunks know what is joined: of two joined sets, one of several rows, only the closest pair is asked for, and only where that
   leaves sets apart is the tile gone through again for all of their pairs. So a group of near copies of any size sends about a
   row per row, and a few per tile.
5. Connected components of all links and copies.

Tiles within a band grow with the square of its rows over CHUNK_ROWS (in bit counts, some nanoseconds per pair).

Cases: null or empty text: no shingles, linked with nothing; fewer words than k: the whole sequence is one shingle; rows that share
an id are one document for linking, each row keeps its own n_shingles; null ids stay and link with nothing. Ids are integers.
Further columns don't take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_rows, ship, written
from .components import component_ids
from .words import shingles

CHUNK_ROWS = 4096
CHUNK_MB = 16
#: Megabytes of arrays that a task hands over at a time.
SEND_MB = 8
#: Rows of a tile whose bit counts are taken at once.
STEP = 256


def signature(hashes: np.ndarray) -> np.ndarray:
    """Parity bitmap of about a bit per hash, at least one word."""
    words = 1 << max(0, math.ceil(math.log2(max(len(hashes), 64) / 64)))
    bits = (hashes & np.uint64(words * 64 - 1)).astype(np.int64)
    odd = np.bincount(bits, minlength=words * 64).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64)


def folded(sig: np.ndarray, words: int) -> np.ndarray:
    """The signature of the same sets in fewer words: halves xored."""
    while sig.shape[-1] > words:
        half = sig.shape[-1] // 2
        sig = sig[..., :half] ^ sig[..., half:]
    return sig


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), dtype=np.uint32)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w][:, None] ^ b[:, w][None, :])
    return out


def coarse_words(words: int, sizes: int, percent: int) -> int:
    """The narrowest width, of a power of two words, in which unrelated sets of these sizes in sum still differ by more than the
    bound (half the bits, two deviations aside); the full width if none does."""
    limit = sizes * (100 - percent) // (100 + percent)
    few = 1
    while few < words and 32 * few - math.sqrt(64 * few) <= limit:
        few *= 2
    return few


def candidates(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, percent: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) that bit counts allow, block by block; same: a is b and only i < j count."""
    words = min(a.shape[1], b.shape[1])
    a, b = folded(a, words), folded(b, words)
    few = coarse_words(words, int(na.max()) + int(nb.max()), percent)
    ca, cb = folded(a, few), folded(b, few)
    na, nb = na.astype(np.int64), nb.astype(np.int64)
    for i in range(0, len(a), STEP):
        own = na[i : i + STEP, None]
        limit = (own + nb[None, :]) * (100 - percent) // (100 + percent)
        ok = _differing(ca[i : i + STEP], cb) <= limit
        x, y = np.nonzero(ok)
        x += i
        if same:
            x, y = x[keep := x < y], y[keep]
        sizes_x, sizes_y = na[x], nb[y]
        fits = 100 * np.minimum(sizes_x, sizes_y) >= percent * np.maximum(sizes_x, sizes_y)
        x, y = x[fits], y[fits]
        if few < words and len(x):
            keep = np.empty(len(x), dtype=bool)
            for s in range(0, len(x), 1 << 18):
                at = slice(s, s + (1 << 18))
                keep[at] = np.bitwise_count(a[x[at]] ^ b[y[at]]).sum(axis=1, dtype=np.int64) <= (na[x[at]] + nb[y[at]]) * (100 - percent) // (100 + percent)
            x, y = x[keep], y[keep]
        if len(x):
            yield x, y


def overlaps(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of one sorted array with each of many."""
    lengths = np.array([len(m) for m in many])
    values = np.concatenate(many)
    at = np.minimum(np.searchsorted(one, values), len(one) - 1)
    hits = (one[at] == values).astype(np.int64)
    return np.add.reduceat(hits, np.concatenate([[0], np.cumsum(lengths)[:-1]]))


def tile_links(ids: list[int], arrays: list[np.ndarray], labels: np.ndarray, left: int, percent: int, same: bool) -> list[tuple[int, int]]:
    """Links that join what labels keep apart: rows up to left against the others, or among themselves if same. Pairs are gone through
    STEP rows at a time, so memory holds no more than those."""
    n = np.array([len(a) for a in arrays])
    sigs = [signature(a) for a in arrays]
    words = min(len(s) for s in sigs)
    sig = np.stack([folded(s, words) for s in sigs])
    label = np.unique(labels, return_inverse=True)[1]
    if same:
        pairs = candidates(sig, n, sig, n, percent, True)
    else:
        pairs = ((x, y + left) for x, y in candidates(sig[:left], n[:left], sig[left:], n[left:], percent, False))
    links = []
    for xs, ys in pairs:
        apart = label[xs] != label[ys]
        xs, ys = xs[apart], ys[apart]
        if not len(xs):
            continue
        rows, begins = np.unique(xs, return_index=True)
        for u, s, e in zip(rows.tolist(), begins.tolist(), [*begins[1:].tolist(), len(xs)], strict=True):
            near = ys[s:e]
            near = near[label[near] != label[u]]
            if not len(near):
                continue
            both = overlaps(arrays[u], [arrays[v] for v in near.tolist()])
            linked = near[100 * both >= percent * (n[u] + n[near] - both)]
            joined, first = np.unique(label[linked], return_index=True)
            links += [(ids[u], ids[v]) for v in linked[first].tolist()]
            if len(joined):
                label[np.isin(label, joined)] = label[u]
    if same:  # stars, whose centre is the label of what the tile joins
        heads = np.array(ids)[np.unique(label, return_index=True)[1]][np.unique(label, return_inverse=True)[1]]
        links = [(h, d) for h, d in zip(heads.tolist(), ids, strict=True) if h != d]
    return links


def _read(batches, k: int):
    for batch in batches:
        for d, text in zip(batch.column("d").to_pylist(), byte_rows(batch.column("t")), strict=True):
            yield d, shingles(text.lower().split(), k)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """d, n, ha, hb (hash of the set), low (its least hash), sig for each row of docs."""
    schema = pa.schema([("d", pa.int64()), ("n", pa.int64()), ("ha", pa.int64()), ("hb", pa.int64()), ("low", pa.int64()), ("sig", pa.binary())])

    def sets(batches):
        for batch in batches:
            rows = []
            for d, s in _read([batch], k):
                h = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
                low = int(s[:1].view(np.int64)[0]) if len(s) else None
                rows.append((d, len(s), int(h[0]), int(h[1]), low, signature(s).tobytes() if len(s) else b""))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).mapInArrow(sets, "d long, n long, ha long, hb long, low long, sig binary")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """d (the id), n_shingles, component for each row of docs; linked rows have 100 * intersection >= percent * union."""
    sets = written(shingle_sets(docs, id_col, text_col, k), "sets")
    filled = sets.where("n > 0 and d is not null").groupBy("d", "ha", "hb", "n").agg(F.first("sig").alias("sig"), F.first("low").alias("low"))
    # only sets that several ids have need a representative; both sides of the join then have exchanges of their own, which AQE splits
    shared = written(filled.groupBy("ha", "hb").agg(F.min("d").alias("rep"), F.count("*").alias("ids")).where("ids > 1").drop("ids"), "shared")
    with_rep = written(filled.join(shared, ["ha", "hb"], "left").select("d", "n", "low", "sig", F.coalesce("rep", "d").alias("rep")), "reps")
    copies = with_rep.where("d != rep").select(F.col("d").alias("u"), F.col("rep").alias("v"))
    links = _links(docs, with_rep.where("d = rep").select("d", "n", "low", "sig"), id_col, text_col, k, percent)
    labels = component_ids(copies.unionByName(links))
    return sets.select("d", F.col("n").alias("n_shingles")).join(labels, "d", "left").select("d", "n_shingles", F.coalesce("component", "d").alias("component"))


_CHUNK = pa.schema([("band", pa.int32()), ("part", pa.int32()), ("seq", pa.int32()), ("words", pa.int32()), ("ids", pa.binary()), ("ns", pa.binary()), ("sigs", pa.binary())])


def _pack(rows: list[tuple[int, int, int, bytes]], part: int, seq: int) -> pa.RecordBatch:
    """A chunk of rows (band, d, n, sig) of one band."""
    sigs = [np.frombuffer(r[3], dtype=np.uint64) for r in rows]
    words = min(len(x) for x in sigs)
    sig = np.stack([folded(x, words) for x in sigs])
    cols = (rows[0][0], part, seq, words, np.array([r[1] for r in rows], np.int64).tobytes(), np.array([r[2] for r in rows], np.int64).tobytes(), sig.tobytes())
    return pa.record_batch([pa.array([c], type=f.type) for c, f in zip(cols, _CHUNK, strict=True)], schema=_CHUNK)


def _chunks(reps: DataFrame, percent: int) -> DataFrame:
    """Chunks of signatures, numbered per band from 0, written: band, chunk, words, ids, ns, sigs."""
    ratio = math.log(100 / percent)
    banded = reps.select(F.floor(F.log("n") / F.lit(ratio) + F.lit(1e-12)).cast("int").alias("band"), "d", "n", "low", "sig")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, rows, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("band", "d", "n", "sig")], strict=True):
                if rows and (row[0] != rows[0][0] or len(rows) >= CHUNK_ROWS or (len(rows) >= 64 and size + 8 * row[2] > CHUNK_MB << 20)):
                    yield _pack(rows, part, seq)
                    seq, rows, size = seq + 1, [], 0
                rows.append(row)
                size += 8 * row[2]
        if rows:
            yield _pack(rows, part, seq)

    ordered = banded.repartitionByRange("band", "low", "d").sortWithinPartitions("band", "low", "d")
    packed = written(ordered.mapInArrow(pack, "band int, part int, seq int, words int, ids binary, ns binary, sigs binary"), "packed")
    # a row per chunk is numbered, not per document
    numbers = packed.select("band", "part", "seq", (F.row_number().over(Window.partitionBy("band").orderBy("part", "seq")) - 1).alias("chunk"))
    return written(packed.join(numbers, ["band", "part", "seq"]).drop("part", "seq"), "chunks")


def _labelled(chunks: DataFrame, labels: DataFrame | None) -> DataFrame:
    """chunks with linked: what is known to be joined, as (place in the chunk, label)."""
    if labels is None:
        return chunks.withColumn("linked", F.lit(None).cast("array<struct<at:int,label:bigint>>"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, chunk, ids in zip(*[batch.column(c).to_pylist() for c in ("band", "chunk", "ids")], strict=True):
                d = np.frombuffer(ids, np.int64)
                yield pa.record_batch([pa.array(np.full(len(d), band, np.int32)), pa.array(np.full(len(d), chunk, np.int32)), pa.array(np.arange(len(d), dtype=np.int32)), pa.array(d)], names=["band", "chunk", "at", "d"])

    held = chunks.select("band", "chunk", "ids").mapInArrow(members, "band int, chunk int, at int, d long").join(labels.withColumnRenamed("component", "label"), "d")
    return chunks.join(held.groupBy("band", "chunk").agg(F.collect_list(F.struct("at", "label")).alias("linked")), ["band", "chunk"], "left")


def _ask(key: tuple, pdf: pd.DataFrame, percent: int, once: bool) -> pd.DataFrame:
    """d, ask (tile/side), label of the rows whose arrays a tile needs. once: of two joined sets, one of several rows, only the closest
    pair is asked for, and a row without d says that the tile has more."""
    rows = []
    for r in pdf.sort_values("side").itertuples():
        ids, label = np.frombuffer(r.ids, np.int64), np.frombuffer(r.ids, np.int64).copy()
        if r.linked is not None:
            for x in r.linked:
                label[x["at"]] = x["label"]
        rows.append((ids, np.frombuffer(r.ns, np.int64), np.frombuffer(r.sigs, np.uint64).reshape(-1, r.words), label))
    t = str(key[0]).split(":")
    same = t[:2] == t[2:]
    none = pd.DataFrame({"d": pd.Series(dtype="Int64"), "ask": pd.Series(dtype="object"), "label": pd.Series(dtype="Int64")})
    if len(rows) < 2 and not same:
        return none
    (ia, na, sa, la), (ib, nb, sb, lb) = (rows * 2)[:2]
    hit_a, hit_b, more = np.zeros(len(ia), dtype=bool), np.zeros(len(ib), dtype=bool), False
    if once:
        sets, place = np.unique(np.concatenate([la, lb]), return_inverse=True)
        xa, xb = place[: len(la)], place[len(la) :]
        large = np.maximum(np.bincount(xa, minlength=len(sets)), np.bincount(xb, minlength=len(sets))) > 1
        words = min(sa.shape[1], sb.shape[1])
        fa, fb = folded(sa, words), folded(sb, words)
        best: dict[int, tuple[int, int, int]] = {}
    for x, y in candidates(sa, na, sb, nb, percent, same):
        apart = la[x] != lb[y]
        x, y = x[apart], y[apart]
        if once:
            whole = large[xa[x]] | large[xb[y]]
            for s in range(0, len(gx := x[whole]), 1 << 18):
                px, py = gx[s : s + (1 << 18)], y[whole][s : s + (1 << 18)]
                differ = np.bitwise_count(fa[px] ^ fb[py]).sum(axis=1, dtype=np.int64)
                pair = xa[px] * len(sets) + xb[py]
                order = np.lexsort((differ, pair))
                kinds, first, counts = np.unique(pair[order], return_index=True, return_counts=True)
                for kind, at, n in zip(kinds.tolist(), order[first].tolist(), counts.tolist(), strict=True):
                    had = best.get(kind)
                    more |= had is not None or n > 1
                    if had is None or int(differ[at]) < had[0]:
                        best[kind] = (int(differ[at]), int(px[at]), int(py[at]))
            x, y = x[~whole], y[~whole]
        hit_a[x] = True
        hit_b[y] = True
    if once:
        for _, x, y in best.values():
            hit_a[x] = hit_b[y] = True
    if same:
        hit_a |= hit_b
        hit_b[:] = False
    d, label = np.concatenate([ia[hit_a], ib[hit_b]]), np.concatenate([la[hit_a], lb[hit_b]])
    asks = [f"{key[0]}/0"] * int(hit_a.sum()) + [f"{key[0]}/1"] * int(hit_b.sum())
    out = pd.DataFrame({"d": pd.array(d, dtype="Int64"), "ask": np.array(asks, dtype=object), "label": pd.array(label, dtype="Int64")})
    return pd.concat([out, pd.DataFrame({"d": pd.array([None], dtype="Int64"), "ask": [str(key[0])], "label": pd.array([None], dtype="Int64")})]) if more else out


def _links(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    chunks = _chunks(reps, percent)
    # a row for each band: as many as the logarithm of the largest set
    count = {r["band"]: r["count"] for r in chunks.groupBy("band").count().collect()}
    if not count:
        return spark.createDataFrame([], "u long, v long")
    shape = F.broadcast(spark.createDataFrame([(b, c, count.get(b - 1, 0), count.get(b + 1, 0)) for b, c in count.items()], "band int, own int, below int, above int"))
    tile = lambda a, i, b, j, side: F.struct(F.concat_ws(":", a, i, b, j).alias("tile"), F.lit(side).alias("side"))
    span = lambda low, high: F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    b, c, zero = F.col("band"), F.col("chunk"), F.lit(0)
    crossed = F.concat(
        F.transform(span(c + 1, F.col("own") - 1), lambda j: tile(b, c, b, j, 0)),
        F.transform(span(zero, c - 1), lambda i: tile(b, i, b, c, 1)),
        F.transform(span(zero, F.col("above") - 1), lambda j: tile(b, c, b + 1, j, 0)),
        F.transform(span(zero, F.col("below") - 1), lambda i: tile(b - 1, i, b, c, 1)),
    )
    sent_schema = pa.schema([("tile", pa.string()), ("side", pa.int32()), ("d", pa.int64()), ("label", pa.int64()), ("a", pa.binary())])

    def asked(tiles, labels: DataFrame | None, once: bool, only: DataFrame | None = None) -> DataFrame:
        sides = _labelled(chunks, labels).join(shape, "band").withColumn("t", F.explode(tiles)).select("t.tile", "t.side", "words", "ids", "ns", "sigs", "linked")
        if only is not None:
            sides = sides.join(only, "tile", "left_semi")
        return written(sides.groupBy("tile").applyInPandas(lambda key, pdf: _ask(key, pdf, percent, once), "d long, ask string, label long"), "asks")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = lambda: [[] for _ in sent_schema]
        for batch in batches:
            rows, size = empty(), 0
            for (d, s), asks in zip(_read([batch], k), batch.column("asks").to_pylist(), strict=True):
                raw = s.tobytes()
                for ask in asks if len(s) else ():
                    at, side = ask["ask"].rsplit("/", 1)
                    for column, value in zip(rows, (at, int(side), d, ask["label"], raw), strict=True):
                        column.append(value)
                    size += len(raw)
                    if size > SEND_MB << 20:
                        yield pa.record_batch([pa.array(r, type=f.type) for r, f in zip(rows, sent_schema, strict=True)], schema=sent_schema)
                        rows, size = empty(), 0
            yield pa.record_batch([pa.array(r, type=f.type) for r, f in zip(rows, sent_schema, strict=True)], schema=sent_schema)

    def verify(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "d"])
        arrays = [np.frombuffer(a, dtype=np.uint64) for a in pdf["a"]]
        t = str(key[0]).split(":")
        links = tile_links(pdf["d"].tolist(), arrays, pdf["label"].to_numpy(np.int64), int((pdf["side"] == 0).sum()), percent, t[:2] == t[2:])
        return pd.DataFrame(links, columns=["u", "v"]).astype("int64")

    def found(asks: DataFrame) -> DataFrame:
        per_row = asks.where("d is not null").groupBy("d").agg(F.collect_set(F.struct("ask", "label")).alias("asks"))
        wanted = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).join(per_row, "d")
        return written(wanted.mapInArrow(send, "tile string, side int, d long, label long, a binary").groupBy("tile").applyInPandas(verify, "u long, v long"), "links")

    links = found(asked(F.array(tile(b, c, b, c, 0)), None, False))
    if sum(count.values()) == len(count) and not any(x + 1 in count for x in count):
        return links  # no tile of two chunks
    # a row is in one tile of one chunk, whose stars say what is joined so far
    joined = links.select(F.inline(F.array(F.struct(F.col("v").alias("d"), F.col("u").alias("component")), F.struct(F.col("u").alias("d"), F.col("u").alias("component"))))).distinct()
    asks = asked(crossed, joined, True)
    links = links.unionByName(found(asks))
    more = asks.where("d is null").select(F.col("ask").alias("tile"))
    if more.isEmpty():
        return links
    return links.unionByName(found(asked(crossed, component_ids(links), False, more)))

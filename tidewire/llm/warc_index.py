"""WARC archives with a two-level capture index.

write_archives() writes a gzip member per record, response or revisit, into archive files in the shared folder. build_index() sorts
the captures by reversed-host URL key (range partitions, so files follow each other in key order), compresses runs of BLOCK_LINES
lines to blocks and ends each index file with its part of the sparse directory: per block the first and last key and where it lies.
A revisit's line also has the place of its response, wherever that was captured.

read_keys() looks any table of keys up, in two steps. Sorted keys are dealt by range; a task finds the index files of its run of keys
by binary search in their key ranges (a row per index file), range-reads those files' directories and binary-searches them for the
blocks that can hold a key. Then (block, keys) are dealt to tasks by block; each range-reads the block, binary-searches its lines for
the keys and range-reads the records those point to. So a URL with very many captures is as many blocks' work, not one task's.
lookup() does the same for one URL on the driver.

Duplicates: of records with equal payloads of at least min_bytes, the one with the largest id is the response and the others revisit it;
the digest decides (SHA-1, from the JVM), counted by a partial aggregate. Payloads cross the network once, dealt by record id, so
a payload that a third of all records share is no hot key. An archive file carries its attempt's own name and only files of tasks
that committed are ever named in the written catalogue, so retries and lost executors leave no half-read files.

Files are written and range-read through pyarrow's file systems, which open the same URIs (file, hdfs, s3, gs) as the session's shared folder.

Cases: null payload: empty; null URL: key ''; null id: always a response, nobody revisits it, the header is left out; rows that
share the winning id are all responses. Further columns don't take part.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, shared_folder, ship, written

BLOCK_LINES = 1000
#: Blocks that a reading task gets on average, and keys that are sent for a block at a time.
TASK_BLOCKS, SENT_KEYS = 16, 4096
#: An archive file is closed beyond so many bytes.
ARCHIVE_MB = 256
#: One capture date for all records: a crawl's own date where the caller has none.
CAPTURED = "2024-01-01T00:00:00Z"
_LINE = "\t"


def reversed_key(url: str | None) -> str:
    """com,example,www)/path?query: the host's labels from the right, lower case, then the rest; userinfo and scheme go."""
    rest = (url or "").split("://", 1)[-1].split("#", 1)[0]
    cut = min([i for i in (rest.find(c) for c in "/?") if i >= 0], default=len(rest))
    host, tail = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:]
    name, _, port = host.partition(":")
    key = ",".join(reversed(name.split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + (tail or "/")
    return key.replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D") if url else ""


def _header(fields: list[tuple[str, str]]) -> bytes:
    clean = lambda s: s.replace("\r", "%0D").replace("\n", "%0A")
    return ("WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields) + "\r\n").encode()


def to_record(page: str | None, url: str | None, payload: bytes, digest: str, size: int, refers: str | None) -> bytes:
    """A record as one gzip member. A revisit has no payload, but the full payload's digest and length."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page}|{url}|{digest}")
    fields = [("WARC-Type", "revisit" if refers is not None else "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", CAPTURED), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
    if page is not None:
        fields.append(("X-Page-ID", page))
    if refers is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", refers)]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if refers is not None else payload)
    raw = _header([*fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]) + body + b"\r\n\r\n"
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


def from_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a gzip member; a ValueError if a response's payload isn't the one its header names."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record starts here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != fields["WARC-Payload-Digest"][5:]:
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    return fields, payload


class Files:
    """Range reads, with the last few files kept open."""

    def __init__(self, folder: str):
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.open: dict[str, pa.NativeFile] = {}

    def read(self, file: str, start: int, size: int) -> bytes:
        f = self.open.get(file)
        if f is None:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            f = self.open[file] = self.fs.open_input_file(f"{self.base}/{file}")
        return f.read_at(size, start)

    def close(self) -> None:
        for f in self.open.values():
            f.close()


class _Writer:
    """Appends pieces to files of at most ARCHIVE_MB under names of this attempt."""

    def __init__(self, folder: str, suffix: str):
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.suffix, self.out, self.name, self.at = suffix, None, "", 0

    def full(self) -> bool:
        return self.out is None or self.at > ARCHIVE_MB << 20

    def put(self, piece: bytes) -> tuple[str, int, int]:
        """(file, start, size) of the piece, in a new file if this one is full."""
        if self.full():
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.{self.suffix}", 0
            self.out = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None)
        return self.append(piece)

    def append(self, piece: bytes) -> tuple[str, int, int]:
        start = self.at
        self.out.write(piece)
        self.at += len(piece)
        return self.name, start, len(piece)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000) -> tuple[str, DataFrame]:
    """(folder, captures): the archives' folder and the written catalogue key, page, file, start, size, digest, refers of their records."""
    spark = pages.sparkSession
    ship(spark)
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary")
    facts = written(pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes")), "digests")
    winners = written(facts.where((F.col("bytes") >= min_bytes) & F.col("id").isNotNull()).groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n"), "winners")
    refers = facts.where((F.col("bytes") >= min_bytes)).join(winners, "digest").where("id != last").select("id", "digest", "last").distinct()
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("p")).withColumn("digest", F.sha1("p"))
    marked = rows.join(refers, ["id", "digest"], "left").select("id", "url", "digest", F.octet_length("p").cast("long").alias("bytes"), F.when(F.col("last").isNull(), F.col("p")).alias("p"), "last")
    folder = shared_folder(spark, "archives")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder, "warc.gz")
        try:
            for batch in batches:
                made = []
                columns = [batch.column(c).to_pylist() for c in ("id", "url", "digest", "bytes", "last")]
                for page, url, digest, size, last, body in zip(*columns, byte_rows(batch.column("p")), strict=True):
                    where = out.put(to_record(None if page is None else str(page), url, body, digest, size, None if last is None else str(last)))
                    made.append((reversed_key(url), page, *where, digest, last))
                cols = list(zip(*made, strict=True)) if made else [()] * 7
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["key", "page", "file", "start", "size", "digest", "refers"])
        finally:
            out.close()

    return folder, written(marked.mapInArrow(put, "key string, page long, file string, start long, size long, digest string, refers long"), "captures")


def build_index(folder: str, captures: DataFrame) -> DataFrame:
    """The sparse directory, written: first, last (keys), n, file, start, size of each block in key order, and where in its file the
    directory of that file lies (dir_start, dir_size)."""
    schema = pa.schema([("first", pa.string()), ("last", pa.string()), ("n", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("dir_start", pa.int64()), ("dir_size", pa.int64())])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, lines, blocks, rows = _Writer(folder, "cdx.z"), [], [], []

        def close_file() -> None:
            """Ends the file with its directory."""
            if blocks:
                table = zlib.compress("\n".join(_LINE.join(map(str, b)) for b in blocks).encode(), 6)
                _, start, size = out.append(table)
                rows.extend((first, last, n, out.name, at, length, start, size) for first, last, at, length, n in blocks)
                blocks.clear()
                out.close()

        def close_block() -> None:
            if lines:
                if out.full():
                    close_file()
                _, start, size = out.put(zlib.compress("\n".join(lines).encode(), 6))
                blocks.append((lines[0].split(_LINE, 1)[0], lines[-1].split(_LINE, 1)[0], start, size, len(lines)))
                lines.clear()

        try:
            for batch in batches:
                for key, page, file, start, size, there in zip(*[batch.column(c).to_pylist() for c in ("key", "page", "file", "start", "size", "there")], strict=True):
                    of = () if there is None else (there["file"], str(there["start"]), str(there["size"]))
                    lines.append(_LINE.join((key, "" if page is None else str(page), file, str(start), str(size), *of)))
                    if len(lines) >= BLOCK_LINES:
                        close_block()
            close_block()
            close_file()
        finally:
            out.close()
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    # an id may come with several payloads, so a response is met by id and digest; those that nobody revisits stay out of the join
    wanted = captures.where("refers is not null").select("refers", "digest").distinct()
    responses = captures.where("refers is null").select(F.col("page").alias("refers"), "digest", F.struct("file", "start", "size").alias("there"))
    places = responses.join(wanted, ["refers", "digest"]).groupBy("refers", "digest").agg(F.min("there").alias("there"))
    captures = captures.join(places, ["refers", "digest"], "left").select("key", "page", "file", "start", "size", "there")
    # a URL with very many captures is spread over ranges by the place of its records
    ordered = captures.repartitionByRange("key", "file", "start").sortWithinPartitions(F.encode("key", "utf-8"), "file", "start")
    return written(ordered.mapInArrow(block, "first string, last string, n long, file string, start long, size long, dir_start long, dir_size long"), "directory")


def _captures(files: Files, file: str, start: int, size: int) -> list[list[str]]:
    return [x.split(_LINE) for x in zlib.decompress(files.read(file, start, size)).decode().split("\n")]


def _found(keys: list[bytes], first: list[bytes], key: bytes) -> range:
    """The places in sorted spans (first, last) that can hold key, last kept as its running maximum in keys."""
    at = end = bisect_left(keys, key)
    while end < len(first) and first[end] <= key:
        end += 1
    return range(at, end)


def _lasts(lasts: Iterable[bytes]) -> list[bytes]:
    return list(accumulate(lasts, max))


def index_files(directory: DataFrame) -> list[tuple[bytes, bytes, str, int, int]]:
    """(first key, last key, file, place of its directory) in key order: a row per index file, which holds up to ARCHIVE_MB."""
    files = directory.groupBy("file").agg(F.min(F.encode("first", "utf-8")).alias("a"), F.max(F.encode("last", "utf-8")).alias("z"), F.first("dir_start").alias("s"), F.first("dir_size").alias("n"))
    return sorted((bytes(r["a"]), bytes(r["z"]), r["file"], r["s"], r["n"]) for r in files.collect())


def read_keys(folder: str, directory: DataFrame, keys: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record captured under a key of keys (column key)."""
    spark = directory.sparkSession
    ship(spark)
    top = index_files(directory)
    tops, firsts = _lasts(t[1] for t in top), [t[0] for t in top]
    n_blocks = directory.count()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, open_dir = Files(folder), {}, (None, [], [], [])
        rows: list[tuple[str, int, int, list[str]]] = []
        for batch in batches:
            for key in batch.column("key").to_pylist():
                raw = (key or "").encode()
                for f in _found(tops, firsts, raw):
                    _, _, file, start, size = top[f]
                    if open_dir[0] != file:
                        lines = [x.split(_LINE) for x in zlib.decompress(files.read(file, start, size)).decode().split("\n")]
                        open_dir = (file, _lasts(x[1].encode() for x in lines), [x[0].encode() for x in lines], lines)
                    for b in _found(open_dir[1], open_dir[2], raw):
                        place = (file, int(open_dir[3][b][2]), int(open_dir[3][b][3]))
                        held.setdefault(place, []).append(key or "")
                        if len(held[place]) >= SENT_KEYS:
                            rows.append((*place, held.pop(place)))
                # keys come in order, so all but the last few blocks are done with
                while len(held) > 64:
                    place = next(iter(held))
                    rows.append((*place, held.pop(place)))
        rows += [(*place, k) for place, k in held.items()]
        files.close()
        for s in range(0, max(1, len(rows)), 256):
            cols = list(zip(*rows[s : s + 256], strict=True)) if rows else [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["file", "start", "size", "keys"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        try:
            for batch in batches:
                for file, start, size, wanted in zip(*[batch.column(c).to_pylist() for c in ("file", "start", "size", "keys")], strict=True):
                    lines, rows = _captures(files, file, start, size), []
                    sorted_keys = [x[0].encode() for x in lines]
                    for key in wanted:
                        raw = key.encode()
                        for x in lines[bisect_left(sorted_keys, raw) : bisect_right(sorted_keys, raw)]:
                            fields, payload = from_record(files.read(x[2], int(x[3]), int(x[4])))
                            full = len(payload) if fields["WARC-Type"] == "response" else int(fields["X-Payload-Length"])
                            page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                            rows.append((None if page is None else int(page), full, fields["WARC-Payload-Digest"][5:], fields["WARC-Type"], None if refers is None else int(refers), fields["WARC-Target-URI"]))
                    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
        finally:
            files.close()

    asked = keys.select("key").distinct().repartitionByRange("key").sortWithinPartitions(F.encode("key", "utf-8"))
    # a number of its own, as rows are tiny and each stands for up to BLOCK_LINES range reads, which AQE can't know
    blocks = asked.mapInArrow(resolve, "file string, start long, size long, keys array<string>").repartition(max(1, min(n_blocks, max(spark.sparkContext.defaultParallelism, -(-n_blocks // TASK_BLOCKS)))), "file", "start")
    return blocks.mapInArrow(look, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


class CaptureIndex:
    """Look-ups of single URLs on the driver."""

    def __init__(self, folder: str, directory: DataFrame):
        """A row per index file is held; an index file's directory is read when a key falls into it."""
        self.files = Files(folder)
        self.top = index_files(directory)
        self.lasts = _lasts(t[1] for t in self.top)

    def _blocks(self, key: bytes) -> Iterator[tuple[str, int, int]]:
        for f in _found(self.lasts, [t[0] for t in self.top], key):
            _, _, file, start, size = self.top[f]
            lines = [x.split(_LINE) for x in zlib.decompress(self.files.read(file, start, size)).decode().split("\n")]
            for b in _found(_lasts(x[1].encode() for x in lines), [x[0].encode() for x in lines], key):
                yield file, int(lines[b][2]), int(lines[b][3])

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """Header fields and payload of each capture of url, a revisit's payload taken from the record that it refers to, under whatever URL."""
        key = reversed_key(url).encode()
        found: list[tuple[dict[str, str], bytes]] = []
        shared: dict[tuple[str, int, int], bytes] = {}
        for file, start, size in self._blocks(key):
            lines = _captures(self.files, file, start, size)
            keys = [x[0].encode() for x in lines]
            for x in lines[bisect_left(keys, key) :]:
                if x[0].encode() != key:
                    break
                fields, payload = from_record(self.files.read(x[2], int(x[3]), int(x[4])))
                if fields["WARC-Type"] == "revisit":
                    place = (x[5], int(x[6]), int(x[7]))
                    if place not in shared:
                        shared[place] = from_record(self.files.read(*place))[1]
                    payload = shared[place]
                found.append((fields, payload))
        return found

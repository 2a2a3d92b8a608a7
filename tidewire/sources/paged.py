"""Stores that give pages by cursor and take batches, as Spark data sources: reads in ranges of the cursor, writes that count once.

A caller gives a Store, a small client of a service or database; register() makes it a format:

    paged.register(spark, "points", lambda options: SqliteStore(options["path"], "points", "id", COLUMNS), "id long, text string")
    spark.read.format("points").option("path", p).load()
    df.write.format("points").option("path", p).mode("append").save()

Reading: the cursor's range is split into partitions, each of which asks for page after page; a task that is run again asks again. As a
stream, an offset is the greatest cursor seen, and each batch reads the ranges between two. Writing: a task stages its rows in batches
under its own attempt; commit publishes, in one step, what the attempts that Spark counts have staged, and a stream's batch is published
once under its number; what failed or repeated attempts staged is discarded, or stays aside, unseen, if a task staged it after its
write was given up. So a retry leaves no row twice.

Cases: an empty store has no partitions; nulls are kept in any column but the key; of rows that share a key in one write the last of the
greatest partition stays; an empty write publishes nothing. Stores should order keys as the cursor does.
"""

from __future__ import annotations

import json
import sqlite3
import uuid
from collections.abc import Callable, Iterator
from contextlib import closing
from dataclasses import dataclass
from typing import Protocol

from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

#: Rows of a page and of a batch, unless options say otherwise; ranges that a read is split into.
PAGE, SPLITS = 100, 8


class Store(Protocol):
    """What a client offers. Cursors are whole numbers; a range is (after, until]."""

    def bounds(self) -> tuple[int, int] | None:
        """The least and greatest cursor; None if empty."""

    def page(self, after: int, until: int, limit: int) -> list[tuple[int, tuple]]:
        """(cursor, row) of the first rows of a range, in order."""

    def stage(self, write: str, attempt: str, batch: int, rows: list[tuple]) -> None:
        """Puts rows aside. The same batch again replaces what was there."""

    def publish(self, write: str, attempts: list[str], number: int | None = None) -> None:
        """In one step: what these attempts staged becomes visible, by key, unless this write (of a stream: its batch of this number) has been
        published before; the rest of what it staged goes."""

    def discard(self, write: str) -> None:
        """Forgets what a write has staged."""


@dataclass
class Range(InputPartition):
    after: int
    until: int


@dataclass
class Staged(WriterCommitMessage):
    attempt: str
    rows: int


def ranges(first: int, last: int, parts: int) -> list[Range]:
    """The cursors from first to last in so many ranges of like width."""
    cuts = sorted({first - 1 + (last - first + 1) * k // parts for k in range(parts + 1)})
    return [Range(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def pages(store: Store, part: Range, limit: int) -> Iterator[tuple]:
    """The rows of a range, asked for page by page."""
    after = part.after
    while found := store.page(after, part.until, limit):
        for _, row in found:
            yield row
        after = found[-1][0]


def _stage(store: Store, write: str, rows: Iterator, limit: int) -> Staged:
    """Stages a task's rows in batches, under the task's partition and attempt."""
    context = TaskContext.get()
    attempt = f"{context.partitionId():06d}-{context.taskAttemptId():012d}"
    held, batch, total = [], 0, 0
    for row in rows:
        held.append(tuple(row))
        if len(held) == limit:
            store.stage(write, attempt, batch, held)
            held, batch, total = [], batch + 1, total + limit
    if held:
        store.stage(write, attempt, batch, held)
    return Staged(attempt, total + len(held))


def register(spark: SparkSession, name: str, open_store: Callable[[dict], Store], schema: str) -> None:
    """Makes the stores that open_store(options) gives a format of this session."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self) -> list[Range]:
            bounds = open_store(self.options).bounds()
            return ranges(*bounds, int(self.options.get("splits", SPLITS))) if bounds else [Range(0, -1)]

        def read(self, partition: Range) -> Iterator[tuple]:
            return pages(open_store(self.options), partition, int(self.options.get("page", PAGE)))

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.options = options

        def initialOffset(self) -> dict:
            return {"cursor": -1}

        def latestOffset(self) -> dict:
            bounds = open_store(self.options).bounds()
            return {"cursor": bounds[1] if bounds else -1}

        def partitions(self, start: dict, end: dict) -> list[Range]:
            return ranges(start["cursor"] + 1, end["cursor"], int(self.options.get("splits", SPLITS)))

        def read(self, partition: Range) -> Iterator[tuple]:
            return pages(open_store(self.options), partition, int(self.options.get("page", PAGE)))

        def commit(self, end: dict) -> None:
            pass

    class Writer(DataSourceWriter):
        def __init__(self, options: dict):
            self.options, self.id = options, uuid.uuid4().hex

        def write(self, iterator: Iterator) -> Staged:
            return _stage(open_store(self.options), self.id, iterator, int(self.options.get("page", PAGE)))

        def commit(self, messages: list[Staged | None]) -> None:
            open_store(self.options).publish(self.id, sorted(m.attempt for m in messages if m))

        def abort(self, messages: list[Staged | None]) -> None:
            open_store(self.options).discard(self.id)

    class StreamWriter(DataSourceStreamWriter):
        def __init__(self, options: dict):
            # the checkpoint names the stream, so a batch that is run again has its old name
            self.options, self.id = options, options.get("stream", "stream")

        def write(self, iterator: Iterator) -> Staged:
            return _stage(open_store(self.options), self.id, iterator, int(self.options.get("page", PAGE)))

        def commit(self, messages: list[Staged | None], batch_id: int) -> None:
            open_store(self.options).publish(self.id, sorted(m.attempt for m in messages if m), batch_id)

        def abort(self, messages: list[Staged | None], batch_id: int) -> None:
            open_store(self.options).discard(self.id)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(dict(self.options))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return StreamReader(dict(self.options))

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            if overwrite:
                raise ValueError("a store takes rows by key: use mode append")
            return Writer(dict(self.options))

        def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
            return StreamWriter(dict(self.options))

    spark.dataSource.register(Source)


class SqliteStore:
    """A table of a SQLite file as a store; its cursor is the key column, a whole number."""

    def __init__(self, path: str, table: str, key: str, columns: dict[str, str]):
        """columns: name -> SQL type, in the order of rows, the key among them."""
        self.path, self.table, self.key, self.columns = path, table, key, columns
        names = ", ".join(f'"{c}" {kind}{" PRIMARY KEY" if c == key else ""}' for c, kind in columns.items())
        with closing(self._open()) as db, db:
            db.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({names})')
            db.execute(f'CREATE TABLE IF NOT EXISTS "{table}_staged" ("_write" TEXT, "_attempt" TEXT, "_batch" INTEGER, "_rows" TEXT, PRIMARY KEY ("_write", "_attempt", "_batch"))')
            db.execute(f'CREATE TABLE IF NOT EXISTS "{table}_published" ("_write" TEXT PRIMARY KEY)')

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(self.path, timeout=120)

    def bounds(self) -> tuple[int, int] | None:
        with closing(self._open()) as db:
            least, most = db.execute(f'SELECT min("{self.key}"), max("{self.key}") FROM "{self.table}"').fetchone()
        return None if least is None else (least, most)

    def page(self, after: int, until: int, limit: int) -> list[tuple[int, tuple]]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with closing(self._open()) as db:
            return [(r[0], r[1:]) for r in db.execute(f'SELECT "{self.key}", {names} FROM "{self.table}" WHERE "{self.key}" > ? AND "{self.key}" <= ? ORDER BY "{self.key}" LIMIT ?', (after, until, limit))]

    def stage(self, write: str, attempt: str, batch: int, rows: list[tuple]) -> None:
        with closing(self._open()) as db, db:
            db.execute(f'INSERT OR REPLACE INTO "{self.table}_staged" VALUES (?, ?, ?, ?)', (write, attempt, batch, json.dumps(rows)))

    def publish(self, write: str, attempts: list[str], number: int | None = None) -> None:
        marks = ", ".join("?" * len(self.columns))
        name = write if number is None else f"{write}/{number}"
        with closing(self._open()) as db, db:
            db.execute("BEGIN IMMEDIATE")
            if db.execute(f'SELECT 1 FROM "{self.table}_published" WHERE "_write" = ?', (name,)).fetchone() is None:
                for attempt in attempts:
                    for (rows,) in db.execute(f'SELECT "_rows" FROM "{self.table}_staged" WHERE "_write" = ? AND "_attempt" = ? ORDER BY "_batch"', (write, attempt)).fetchall():
                        db.executemany(f'INSERT OR REPLACE INTO "{self.table}" VALUES ({marks})', json.loads(rows))
                db.execute(f'INSERT INTO "{self.table}_published" VALUES (?)', (name,))
            db.execute(f'DELETE FROM "{self.table}_staged" WHERE "_write" = ?', (write,))

    def discard(self, write: str) -> None:
        with closing(self._open()) as db, db:
            db.execute(f'DELETE FROM "{self.table}_staged" WHERE "_write" = ?', (write,))

"""What the corpus operators share: the cluster's common folder, shipping of this package to executors, byte access to Arrow columns."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII letters, for lower-casing that leaves every other character as it is.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The ASCII white space [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where that is unset and all run on one machine (tests)."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder and sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc._jsc.sc().getCheckpointDir().get()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = Path(tempfile.mkdtemp(prefix="tidewire-")).as_uri()
        sc.setCheckpointDir(folder)
    # as Spark itself would resolve it, so that pyarrow opens the same folder
    at = sc._jvm.org.apache.hadoop.fs.Path(folder)
    whole = at.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    return f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


#: Folders made by this process in the shared folder, in order.
_made: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, for files written through pyarrow."""
    uri = shared_path(spark, name)
    fs, base = pafs.FileSystem.from_uri(uri)
    fs.create_dir(base, recursive=True)
    return uri


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends there, so a lost executor costs a read."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many paths this process has made so far: a mark for clear()."""
    return len(_made)


def clear(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Deletes what was made in the shared folder since a mark, but keep. To be called once results that read it are themselves written."""
    sc = spark.sparkContext
    gone = [path for path in _made[since:] if path != keep]
    for path in gone:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    _made[since:] = [keep] if keep in _made[since:] else []


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    if top.is_dir():
        fd, at = tempfile.mkstemp(prefix="tidewire-", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(at)
    _shipped.add(sc.applicationId)


def byte_rows(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 of each row of a string column; nulls come as b''."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        wide = pa.types.is_large_string(part.type) or pa.types.is_large_binary(part.type)
        for x in part.cast(pa.large_binary() if wide else pa.binary()).to_pylist():
            yield x or b""


def ascii_lower(column):
    """A-Z lower-cased, all else unchanged; lower() alone would also change letters beyond ASCII."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def with_row(rows: DataFrame, more: str) -> T.StructType:
    """The schema of a column row, as rows has it, and of the columns that more names: its fields may have any names."""
    return T.StructType([T.StructField("row", rows.schema["row"].dataType), *T._parse_datatype_string(more).fields])

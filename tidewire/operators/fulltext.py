"""Full-text search in Spanish over a written inverted index: stems with their positions, ranked by cover density.

A text's words are runs of letters and digits in lower case, numbered from 0; stop words keep their number but are not indexed, others are
as their stems. The index is a Parquet table of postings (bucket, stem, doc, at) in segments, one of each task's documents: a folder for each
bucket of a stem's CRC-32, its files sorted by stem (a row of the empty stem marks each indexed row), so a search reads the row groups of its own stems alone, and a stem that stands in every
document lies in as many files as there are segments.
Days are appended as they come.

A document matches if it holds all stems of the query. Its rank is the sum over its covers, the shortest stretches that hold all stems, of
WEIGHT / (1 + words of a cover that are not occurrences of the query's stems): stems that stand close together, and often, count more.
Covers come from one sweep over the occurrences in order.

Cases: a null or empty text, or one of stop words, has no postings; rows of one id count as one document, their texts laid
over each other word by word; a row without an id is not indexed. A query without stems, or an empty index, finds nothing. Ties go to the smaller id.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.stemming import STOP_WORDS, Stems

from .joins import kept, spread

#: Fixed value: what an occurrence counts.
WEIGHT = 0.1
#: Folders of an index. More make a search read less and each segment have more files.
BUCKETS = 8

#: Postings that leave a Python worker together.
ROWS = 50_000

_WORD = re.compile(r"[^\W_]+")


def postings(df: DataFrame, id_col: str, text_col: str, stop: Iterable[str] = STOP_WORDS, mark: bool = False) -> DataFrame:
    """doc, stem, at (array<int>, rising) of each row's text, in one pass without a shuffle; mark: and a row of the empty stem for each row that has stems."""
    own = frozenset(stop)
    rows = spread(df.where(F.col(id_col).isNotNull())).select(F.col(id_col).alias("doc"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Stems(own)
        for batch in batches:
            docs: list[int] = []
            stems: list[str] = []
            at: list[list[int]] = []

            def full(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                out = pa.record_batch([batch.column("doc").take(pa.array(docs, pa.int32())), pa.array(stems, pa.string()), pa.array(at, pa.list_(pa.int32()))], names=["doc", "stem", "at"])
                for held in (docs, stems, at):
                    held.clear()
                return out

            for k, text in enumerate(batch.column("t").to_pylist()):
                places: dict[str, list[int]] = {}
                for i, word in enumerate(_WORD.findall((text or "").lower())):
                    if s := known[word]:
                        places.setdefault(s, []).append(i)
                if mark and places:
                    places[""] = []
                docs.extend([k] * len(places))
                stems.extend(places)
                at.extend(places.values())
                if len(docs) >= ROWS:
                    yield full()
            if docs:
                yield full()

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, stem string, at array<int>")


def bucket_of(stem: str, buckets: int) -> int:
    return zlib.crc32(stem.encode()) % buckets


def write_index(df: DataFrame, id_col: str, text_col: str, path: str, stop: Iterable[str] = STOP_WORDS, buckets: int = BUCKETS, append: bool = False) -> str:
    """Writes, or appends to, the index of df's texts; gives its path."""
    rows = postings(df, id_col, text_col, stop, mark=True).withColumn("bucket", (F.crc32("stem") % buckets).cast("int"))
    # each task writes a segment of its own documents, so postings are sorted where they are made and never shuffled
    rows.sortWithinPartitions("bucket", "stem", "doc").write.mode("append" if append else "overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)
    return path


def query_stems(query: str, stop: Iterable[str] = STOP_WORDS) -> list[str]:
    """The distinct stems of a query, without stop words."""
    known = Stems(stop)
    return sorted({s for w in _WORD.findall(query.lower()) if (s := known[w])})


def read_postings(spark: SparkSession, path: str, stems: list[str], buckets: int = BUCKETS) -> DataFrame:
    """doc, stem, at of the stems given: of their buckets' folders the row groups that may hold them."""
    hit = F.col("bucket").isin(sorted({bucket_of(s, buckets) for s in stems})) & F.col("stem").isin(stems)
    return spark.read.parquet(path).where(hit if stems else F.lit(False)).select("doc", "stem", "at")


def cover_density(found: Column, n_stems: int) -> Column:
    """The rank of a document from found: array<struct<stem, at>>, its postings of all n_stems stems of a query.

    One sweep over the occurrences by position: behind each, the last place of every stem bounds the shortest stretch that ends here
    and holds all; it is a cover unless an earlier one began at the same place.
    """
    events = F.array_sort(F.flatten(F.transform(found, lambda f, k: F.transform(f["at"], lambda p: F.struct(p.alias("p"), k.alias("k"))))))
    numbered = F.transform(events, lambda e, i: F.struct(e["p"].alias("p"), e["k"].alias("k"), i.alias("i")))
    nowhere = F.struct(F.lit(-1).alias("p"), F.lit(-1).alias("i"))
    start = F.struct(F.array_repeat(nowhere, n_stems).alias("last"), F.lit(-1).alias("begun"), F.lit(0.0).alias("rank"))

    def step(acc: Column, e: Column) -> Column:
        last = F.transform(acc["last"], lambda x, k: F.when(k == e["k"], F.struct(e["p"].alias("p"), e["i"].alias("i"))).otherwise(x))
        first = F.array_min(last)
        noise = F.greatest((e["p"] - first["p"]) - (e["i"] - first["i"]), F.lit(0))
        fresh = (first["p"] >= 0) & (first["p"] > acc["begun"])
        return F.struct(last.alias("last"), F.when(fresh, first["p"]).otherwise(acc["begun"]).alias("begun"), F.when(fresh, acc["rank"] + WEIGHT / (1.0 + noise)).otherwise(acc["rank"]).alias("rank"))

    return F.aggregate(numbered, start, step, lambda acc: acc["rank"])


def search(spark: SparkSession, path: str, query: str, k: int, stop: Iterable[str] = STOP_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """doc, rank_score of the k best documents that hold all stems of query; only its own stems' postings are read and shuffled."""
    stems = query_stems(query, stop)
    rows = read_postings(spark, path, stems, buckets)
    # rows of one document and stem are put together; a group is a document's occurrences of the query's stems
    merged = rows.groupBy("doc", "stem").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    docs = merged.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("stem", "at"))).alias("found")).where(F.size("found") == len(stems))
    return docs.select("doc", F.round(cover_density(F.col("found"), len(stems)), 6).alias("rank_score")).orderBy(F.desc("rank_score"), "doc").limit(k)


def stem_figures(spark: SparkSession, path: str) -> DataFrame:
    """stem, n_docs, n_occurrences of an index.

    A document of one row has one posting a stem, so these are summed per stem where they are read; only those of documents of several
    rows, which their marks tell, are first put together.
    """
    rows = spark.read.parquet(path)
    repeated = kept(rows.where("stem = ''").groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"))
    said = rows.where("stem != ''").select("stem", "doc", F.size("at").cast("long").alias("n"))
    once = said.join(repeated, "doc", "left_anti").groupBy("stem").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"))
    again = said.join(repeated, "doc", "left_semi").groupBy("stem", "doc").agg(F.sum("n").alias("n")).groupBy("stem").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"))
    return once.unionByName(again).groupBy("stem").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n_occurrences"))

"""The corpus pipeline: five stages from raw documents to tokens, each over all that its predecessor kept.

Cases, for all stages: further columns of docs go, whatever their names; an empty table gives an empty one; null and empty texts are
texts without words, which no stage drops but for the classifier's verdict. Rows that share an id are judged one by one by the
classifier, lose repeated lines each for itself, are one document for near duplicates, and go together if one of them is
contaminated. A row without an id is judged by the classifier and encoded; the other stages, which tell documents by their ids,
leave it as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import bpe_automaton
from tidewire.llm.common import clear, made, shared_path
from tidewire.llm.decontaminate import build_index, contaminated, search
from tidewire.llm.line_dedup import drop_repeated_lines
from tidewire.llm.ngram_join import jaccard_groups
from tidewire.llm.quality import classify, fit
from tidewire.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, fitted to the weak labels of docs, rejects."""
    judged = classify(docs.select(*COLUMNS), fit(docs)[1])
    return judged.where("quality_model.keep").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; a text that loses lines gets its new length."""
    out = drop_repeated_lines(docs.select(*COLUMNS))
    changed = F.col("line_dedup.n_dropped") > 0
    return out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document of smallest id stays."""
    groups = jaccard_groups(docs)
    others = groups.where("d != component").select(F.col("d").alias("doc_id"))
    return docs.select(*COLUMNS).join(others, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which at least a twentieth of the words are hit by 13-word windows of the benchmark."""
    found = search(build_index(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("d").alias("doc_id")).distinct()
    return docs.select(*COLUMNS).join(bad, "doc_id", "left_anti").select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document, with the digests of its ids and of what they decode to."""
    return bpe_automaton.tokens(docs.select("doc_id", "text"), tokenizer_path()).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

#: The classifier's fitted weights have no form in SQL; tests/llm checks the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again. What a stage made on its way, and what it read of the
    stage before, is deleted once its own rows are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for k, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        path = shared_path(spark, f"pipeline-{k}")
        kept.write.parquet(path)
        docs = spark.read.parquet(path)
        clear(spark, before, keep=path)
    return docs

"""A corpus pipeline of five stages: toxicity, line dedup, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written as Parquet
and read again. All but the last return the columns of documents:

* toxicity: documents with a score of 0.5 or more go;
* line_dedup: lines in ten or more documents go, and documents that are left without text;
* near_dedup: of each group of near copies (five words, similarity 0.8) the document with the smallest id stays;
  of rows with one id, one stays; rows without id stay;
* mixing: documents come as often as the mix takes them, 0 to 2 times, rounded to whole documents;
* encoding: doc_id, source, n_tokens and ids of each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bpe, line_dedup, minhash, mixing, toxicity
from granary.llm.common import cut, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.not_toxic(spark, docs, sf_dir)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_lengths(line_dedup.without_lines(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = minhash.near_duplicates(docs).where("kept and id is not null").select(F.col("id").alias("doc_id")).distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id").select(docs.columns)
    return named.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = docs.select(F.struct("doc_id", "source").alias("row"), "text")
    return bpe.encode_documents(row, "row").select("id.doc_id", "id.source", "n_tokens", "ids")


def with_lengths(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]
#: Models, components and BPE are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs

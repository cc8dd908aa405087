"""A training corpus from raw documents: five stages over whole tables.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
kept; :func:`run` writes every stage as Parquet to the shared folder and reads
it back for the next one.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_file
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoscan.llm.common import materialize
from lithoscan.llm.decontaminate import drop_leaks
from lithoscan.llm.exact_dedup import drop_exact_copies
from lithoscan.llm.near_dedup import drop_near_copies
from lithoscan.llm.packing import pack_documents
from lithoscan.llm.toxicity import drop_toxic, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the labelled documents; documents that score as toxic go.  Null
    texts count as empty, rows that repeat are scored alike; without toxic labels
    nothing goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, train_toxicity(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the row with the largest doc_id stays;
    of rows that repeat that doc_id too, one."""
    return drop_exact_copies(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id.

    Five words a shingle, not two as in the query: in a filter that drops text,
    documents must agree in wording, not only in their pairs of words.  Documents
    without words are no copies of one another; a null doc_id is the lowest."""
    return drop_near_copies(docs, width=5, share=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts stay, rows that
    repeat are judged alike, and without items nothing goes."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed documents; a null or empty text is its end token
    alone, rows that repeat are documents of their own, no document gives no rows."""
    pieces = pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))
    crc = F.crc32("token_ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: The learned and tokenizing stages have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

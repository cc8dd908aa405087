"""Token counts through a digest cache.

A cache row is ``(tokenizer digest, content digest) -> count``.  Counting joins
the documents' digests to the cache, encodes one text per digest that is not
there, appends the new counts, and joins the documents to the grown cache.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, scratch_path, text_or_empty
from .tokens import ByteBPE, PieceCounter, file_digest, loaded

CACHE = "tokenizer string, content string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Changes with the vocabulary file and with the library's version."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    version = importlib.metadata.version(library)
    return hashlib.sha256(f"{library} {version} {file_digest(path)}".encode()).hexdigest()


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """``(content, n_tokens)`` of one tokenizer; no rows if there is no cache.

    Jobs that ran at once may have appended the same digest: one row stays."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "content string, n_tokens long")
    rows = spark.read.schema(CACHE).parquet(path).where(F.col("tokenizer") == tokenizer)
    return rows.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path.endswith(".model"):
            count = loaded(PieceCounter, path).count
        else:
            encode = loaded(ByteBPE, path).encode
            count = lambda text: len(encode(text)) // 4
        for batch in batches:
            counts = [count(text.as_py()) for text in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array(counts, pa.int64())], names=["content", "n_tokens"]
            )

    return run


def count_tokens(
    df: DataFrame,
    tokenizer_path: str,
    cache_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row.

    Content is normalised only as far as no count can change: null becomes the
    empty text.  Copies are encoded once, and never again while the cache at
    ``cache_path`` holds their digest; without a path a fresh cache is made in
    the shared folder.  Misses are reduced to one text per digest before and
    after the shuffle, so many copies do not meet in one task.  Repeated rows
    and null ids are counted like any other; an empty table gives an empty
    result; other columns are not carried."""
    spark = df.sparkSession
    prepare(spark)
    cache_path = cache_path or scratch_path(spark, "token_cache")
    version = tokenizer_digest(tokenizer_path)
    text = text_or_empty(text_col)
    digests = df.select(
        F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("content")
    )
    known = read_cache(spark, cache_path, version)
    misses = (
        df.select(F.sha2(text, 256).alias("content"), text.alias("_text"))
        .join(known, "content", "left_anti")
        .dropDuplicates(["content"])
    )
    counted = misses.mapInArrow(_encode(tokenizer_path), "content string, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache_path)
    return digests.join(read_cache(spark, cache_path, version), "content").select(
        id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

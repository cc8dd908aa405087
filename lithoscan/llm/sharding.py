"""Sharding by rendezvous (highest random weight) hashing.

Each record key draws one pseudo-random score per shard; the highest wins.
A further shard only adds one more score, so a record either stays where it
is or moves to the new shard.  Everything is a column expression: no UDF, and
the only shuffle carries identifiers, never texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty


def _score(key: Column, shard: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
    uniform = (bits + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.lit(-float(weight)) / F.ln(uniform)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that wins ``key``, among ``len(weights)`` shards.

    A shard of weight w gets a share of about w / sum(weights) of the keys;
    changing one weight only moves records into or out of that shard.  A null
    key hashes as a key of its own.  Equal scores go to the higher number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive and there must be one at least")
    scored = [F.struct(_score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return best["shard"]


def shard_records(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_shards: int = 24,
    weights: Sequence[float] | None = None,
    overhead_bytes: int = 8,
    slot_buckets: int = 256,
) -> DataFrame:
    """Place every row: ``(id, size, text_crc32, shard, slot, grown_shard)``.

    ``slot`` numbers the rows of a shard from 0 without gaps.  A shard may
    hold a large part of all rows, so it is not numbered in one task: rows are
    ranked inside ``slot_buckets`` hash buckets of a shard, and the buckets'
    counts (``n_shards * slot_buckets`` rows at most, hence the broadcast) say
    where each bucket starts.  ``grown_shard`` is the shard if there were one
    more of weight 1.

    The law is that of keys: id and shard count decide, so rows of equal texts
    are not kept together, and null ids, which share one key, share a shard
    (their slot buckets differ with their texts).  A null text has no bytes;
    repeated rows get the same shard and a slot each; an empty table gives an
    empty result; other columns are ignored."""
    weights = list(weights) if weights is not None else [1.0] * n_shards
    if len(weights) != n_shards:
        raise ValueError("one weight per shard is needed")
    text, key = text_or_empty(text_col), F.col(id_col)
    placed = df.select(
        key.alias("_id"),
        (F.octet_length(text) + F.lit(overhead_bytes)).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        rendezvous_shard(key, weights).alias("_shard"),
        F.pmod(F.xxhash64(key, F.crc32(text.cast("binary")), F.lit("slot")), F.lit(slot_buckets)).cast("int").alias("_bucket"),
        rendezvous_shard(key, [*weights, 1.0]).alias("_grown"),
    )
    order = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_shard", "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_shard", "_bucket", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_start"))
    )
    rank = F.row_number().over(Window.partitionBy("_shard", "_bucket").orderBy("_id", "_crc", "_size"))
    return (
        placed.withColumn("_rank", rank)
        .join(F.broadcast(starts), ["_shard", "_bucket"])
        .select(
            F.col("_id").alias(id_col),
            F.col("_size").alias("size"),
            F.col("_crc").alias("text_crc32"),
            F.col("_shard").alias("shard"),
            (F.col("_start") + F.col("_rank") - 1).cast("long").alias("slot"),
            F.col("_grown").alias("grown_shard"),
        )
    )

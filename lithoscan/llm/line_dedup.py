"""Line deduplication over range-partitioned line hashes.

Lines become (128-bit key hash, document, position) rows, range-partitioned and
sorted by hash, then document (largest first), then position.  One streaming
pass over each partition meets, for every hash, the document that keeps the
line first, and counts the documents behind it.  The sort key holds the
document too, so a very frequent line is split over many partitions; a run
that touches a partition's edge is reported in part and put together later.

The outcome is a compressed bitmap per document that says which lines stay;
texts are only touched when the bitmaps are applied.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, id_or_lowest, materialize, null_id, prepare, text_or_empty

RUNS = "_h1 long, _h2 long, _first long, _last long, _inner long"
BITMAPS = "_id long, _th long, keep_bitmap binary, n_dropped long"


def line_hashes(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``(_h1, _h2, _id, _th, _pos)`` of every line whose key is long enough."""
    text = text_or_empty(text_col)
    lines = df.select(
        id_or_lowest(id_col).alias("_id"),
        F.xxhash64(text).alias("_th"),
        F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"),
    )
    keys = lines.where(F.length("_line") >= min_chars).select(
        "_id", "_th", "_pos", ascii_lower(F.btrim(F.col("_line"), F.lit(ASCII_SPACE))).alias("_key")
    )
    return keys.where(F.length("_key") >= min_chars).select(
        F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), F.col("_key")).alias("_h2"), "_id", "_th", "_pos"
    )


def _stream_runs(min_docs: int):
    """Runs of equal hashes in sorted order: the first (largest) document, the
    last, and how many others.  Runs inside the partition are passed on if they
    are frequent enough, the first and the last run always."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_start, held = True, None  # held: h1, h2, first, last, number of documents

        def emit(runs: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*[(a, b, f, x, n - (1 if f == x else 2)) for a, b, f, x, n in runs], strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in cols], names=["_h1", "_h2", "_first", "_last", "_inner"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc = (batch.column(c).to_numpy() for c in ("_h1", "_h2", "_id"))
            new_run = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            new_doc = new_run | np.r_[True, doc[1:] != doc[:-1]]
            begin = np.flatnonzero(new_run)
            end = np.r_[begin[1:], len(doc)] - 1
            n = np.add.reduceat(new_doc.astype(np.int64), begin)
            out = []
            if held is not None and (h1[0], h2[0]) == held[:2]:
                more = int(n[0]) - int(doc[0] == held[3])
                held = (*held[:3], int(doc[end[0]]), held[4] + more)
                begin, end, n = begin[1:], end[1:], n[1:]
            if len(begin):
                if held is not None and (at_start or held[4] >= min_docs):
                    out.append(held)
                if held is not None:
                    at_start = False
                wanted = n[:-1] >= min_docs
                if at_start and len(begin) > 1:
                    wanted[0], at_start = True, False
                out += [
                    (int(h1[b]), int(h2[b]), int(doc[b]), int(doc[e]), int(c))
                    for b, e, c in zip(begin[:-1][wanted], end[:-1][wanted], n[:-1][wanted], strict=True)
                ]
                b, e = begin[-1], end[-1]
                held = (int(h1[b]), int(h2[b]), int(doc[b]), int(doc[e]), int(n[-1]))
            if out:
                yield emit(out)
        if held is not None:
            yield emit([held])

    return run


def shared_lines(hashes: DataFrame, min_docs: int) -> DataFrame:
    """``(_h1, _h2, _keeper)`` of every line key found in enough documents."""
    prepare(hashes.sparkSession)
    order = [F.col("_h1"), F.col("_h2"), F.col("_id").desc(), F.col("_pos")]
    runs = (
        hashes.select("_h1", "_h2", "_id", "_pos")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_stream_runs(min_docs), RUNS)
    )
    edges = F.size(F.array_distinct(F.concat(F.collect_set("_first"), F.collect_set("_last"))))
    return (
        runs.groupBy("_h1", "_h2")
        .agg(F.max("_first").alias("_keeper"), (F.sum("_inner") + edges).alias("_docs"))
        .where(F.col("_docs") >= min_docs)
        .drop("_docs")
    )


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for positions in batch.column("_dropped"):
            at = np.asarray(positions.values.to_numpy(), dtype=np.int64)
            keep = np.ones((int(at.max()) // 8 + 1) * 8, dtype=bool)  # whole bytes: padding stays
            keep[at] = False
            maps.append((zlib.compress(np.packbits(keep).tobytes(), 1), int((~keep).sum())))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_id"),
                batch.column("_th"),
                pa.array([m for m, _ in maps], pa.binary()),
                pa.array([n for _, n in maps], pa.int64()),
            ],
            names=["_id", "_th", "keep_bitmap", "n_dropped"],
        )


def keep_bitmaps(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """``(_id, _th, keep_bitmap, n_dropped)`` of every document that loses lines.

    The bitmap (zlib over packed bits, most significant first) has a 1 for each
    line that stays; lines behind its end stay too.  A document is known by its
    id (null: the lowest) and the 64-bit hash of its text; rows with one id are
    one document in all counts."""
    hashes = materialize(line_hashes(df, id_col, text_col, min_chars), "line_hashes")
    shared = materialize(shared_lines(hashes, min_docs), "shared_lines")
    lost = hashes.join(shared, ["_h1", "_h2"]).where(F.col("_id") != F.col("_keeper"))
    per_doc = lost.groupBy("_id", "_th").agg(F.collect_set("_pos").alias("_dropped"))
    return per_doc.mapInArrow(_bitmaps, BITMAPS)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lines, dropped = [], [], []
        for text, bitmap, lost in zip(*(batch.column(c) for c in ("_text", "keep_bitmap", "n_dropped")), strict=True):
            text = text.as_py()
            parts = text.split("\n")
            lines.append(len(parts))
            dropped.append(lost.as_py() or 0)
            if dropped[-1]:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap.as_py()), np.uint8))[: len(parts)]
                text = "\n".join(p for i, p in enumerate(parts) if i >= len(bits) or bits[i])
            texts.append(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())],
            names=["_id", "n_lines", "n_dropped", "kept_text"],
        )


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """``(id, n_lines, n_dropped, kept_text)`` of every row.

    A line's key is the line without white space at its ends, A-Z lower-cased.
    Keys of ``min_chars`` code points or more that ``min_docs`` documents hold
    lose their lines in all of these but the one with the largest id, which
    keeps every occurrence.  A null or empty text is one empty line; a document
    may lose all its lines and then has an empty text.  Repeated rows lose the
    same lines.  An empty table gives an empty result; other columns are not
    carried."""
    prepare(df.sparkSession)
    maps = keep_bitmaps(df, id_col, text_col, min_chars, min_docs)
    text = text_or_empty(text_col)
    rows = df.select(id_or_lowest(id_col).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    told = rows.join(maps, ["_id", "_th"], "left").select("_id", "_text", "keep_bitmap", "n_dropped")
    done = told.mapInArrow(_apply, "_id long, n_lines long, n_dropped long, kept_text string")
    return done.select(null_id("_id").alias(id_col), "n_lines", "n_dropped", "kept_text")

"""Sum-of-squares packing of documents into windows of fixed length.

Every partition packs its own documents in one pass, without a shuffle.  A
document longer than a window is cut into full windows and a rest.  Rests are
placed online: of all fill levels that a rest can go to (an empty window
included), the one is taken that makes the sum of squared numbers of partly
filled windows per level smallest.  Only the level array, and the windows that
are still open, are held.  What is open at the end of a partition is poured
together by cutting, so that a partition leaves one window with padding at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_or_empty
from .tokens import ByteBPE, loaded

PIECES = "_id long, start long, length long, doc_tokens long, sequence_id long, offset long, token_ids binary"

#: A window's pieces: (identifier, start, ids as bytes, tokens of the document).
Piece = tuple[int | None, int, bytes, int]


class SumOfSquares:
    """The level array: how many, and which, open windows are filled how far."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]

    def level_for(self, size: int) -> int:
        """The fill level to put ``size`` tokens on; 0 opens a window.

        Moving a window from level h to h + size changes the sum of squares by
        2 (count[h + size] - count[h]) + 2, filling it by 1 - 2 count[h], and
        opening one by 2 count[size] + 1.  Ties go to the fullest window."""
        top = self.window - size
        from_level = self.count[1 : top + 1]
        change = 2 * (self.count[1 + size : self.window + 1] - from_level) + 2
        if top:
            change[-1] = 1 - 2 * from_level[-1]
        change = np.where(from_level > 0, change, np.iinfo(np.int64).max)
        best = top - 1 - int(change[::-1].argmin()) if top else 0
        if not top or change[best] > 2 * self.count[size] + 1:
            return 0
        return best + 1

    def place(self, piece: Piece) -> list[Piece] | None:
        """Place a rest; gives the window back if that fills it."""
        size = len(piece[2]) // 4
        level = self.level_for(size)
        window: list[Piece] = []
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
        window.append(piece)
        if level + size == self.window:
            return window
        self.open[level + size].append(window)
        self.count[level + size] += 1
        return None

    def pour(self) -> Iterator[list[Piece]]:
        """Empty the open windows: the fullest are filled up from the emptiest,
        whose pieces are cut where needed."""
        left = [(h, w) for h in range(self.window) for w in self.open[h]]
        room, loose = self.window, []
        full: list[Piece] = []
        while left or loose:
            if not full and left:
                fill, full = left.pop()
                room = self.window - fill
                if not left and not loose:
                    break
            if not loose:
                loose = left.pop(0)[1] if left else []
                if not loose:
                    break
            name, start, ids, total = loose.pop()
            full.append((name, start, ids[: 4 * room], total))
            if len(ids) > 4 * room:
                loose.append((name, start + room, ids[4 * room :], total))
            room -= min(room, len(ids) // 4)
            if not room:
                yield full
                full, room = [], self.window
        if full:
            yield full


def _pack(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = loaded(ByteBPE, path).encode
        end = np.array([end_id], "<u4").tobytes()
        levels, sequence = SumOfSquares(window), TaskContext.get().partitionId() << 32

        def rows(windows: list[list[Piece]], first: int) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(7)]
            for i, pieces in enumerate(windows):
                offset = 0
                for name, start, ids, total in pieces:
                    row = (name, start, len(ids) // 4, total, first + i, offset, ids)
                    for col, value in zip(cols, row, strict=True):
                        col.append(value)
                    offset += len(ids) // 4
            kinds = [pa.int64()] * 6 + [pa.binary()]
            names = ["_id", "start", "length", "doc_tokens", "sequence_id", "offset", "token_ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, done = batch.slice(at, 512), []
                for name, text in zip(part.column("_id").to_pylist(), part.column("_text"), strict=True):
                    ids = encode(text.as_py()) + end
                    total = len(ids) // 4
                    whole = total - total % window
                    done += [[(name, s, ids[4 * s : 4 * (s + window)], total)] for s in range(0, whole, window)]
                    if whole < total and (filled := levels.place((name, whole, ids[4 * whole :], total))):
                        done.append(filled)
                if done:
                    yield rows(done, sequence)
                    sequence += len(done)
        if done := list(levels.pour()):
            yield rows(done, sequence)

    return run


def pack_documents(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    end_id: int = 1,
) -> DataFrame:
    """One row per piece: ``(id, start, length, doc_tokens, sequence_id,
    offset, token_ids)``, ids as little-endian uint32.

    A document is its tokens and ``end_id``; each token lies in one piece.
    Windows are numbered by partition, so numbers have gaps between
    partitions.  A null or empty text is one ``end_id``; null ids are kept;
    repeated rows are documents of their own; an empty table gives an empty
    result; other columns are not carried."""
    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    return rows.mapInArrow(_pack(tokenizer_path, window, end_id), PIECES).withColumnRenamed("_id", id_col)

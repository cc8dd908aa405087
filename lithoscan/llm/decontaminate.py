"""Benchmark decontamination by q-gram lemma filtering.

A region of a document that matches an item of m characters with at most k
edits shares at least m - q + 1 - k q of the item's q-grams, all on diagonals
at most k apart.  Shared q-grams are counted in overlapping diagonal bands,
bands below that bound are dropped, and the others are verified by a banded
alignment.  A long item is looked for in overlapping regions, so that a document
which quotes a part of it is found too.  Items come to the documents in blocks
of bounded size, one pass over the documents for each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_or_empty

Q, EDIT_RATE = 8, 0.08
#: Words of a region; an item of more words is cut into regions half as far apart.
REGION_WORDS = 50
#: Shared q-grams of a document that are counted at a time.
_HITS = 1 << 20
#: Characters of items that tasks get at once.
BLOCK_CHARS = 2_000_000
_FILTER_BITS = 22


def normalised(text: str) -> str:
    """Lower case, white space of any kind and number as one blank, trimmed."""
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def regions(text: str, words: int) -> list[str]:
    """The normalised text in regions of ``words`` words, each half as many after
    the one before; the last one ends where the text ends."""
    parts = text.split(" ")
    if len(parts) <= words:
        return [text]
    step = max(1, words // 2)
    starts = [*range(0, len(parts) - words, step), len(parts) - words]
    return [" ".join(parts[at : at + words]) for at in starts]


def qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams, by doubling windows; q is a power of two."""
    if len(codes) < q:
        return np.empty(0, dtype=np.uint64)
    h, span, factor = codes.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    while span < q:
        h = h[:-span] * np.uint64(factor) + h[span:]
        span, factor = 2 * span, factor * factor % (1 << 64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def banded_alignment(item: np.ndarray, text: np.ndarray, low: int, high: int, anchored: bool = False):
    """``(edits, end)``: the fewest edits between the whole item and a part of
    the text, over alignments on diagonals ``low .. high`` (text minus item
    position).  ``anchored`` fixes the part's start at diagonal 0."""
    diagonals = np.arange(low, high + 1)
    far = len(item) + len(text) + 1
    row = np.abs(diagonals) + np.where(diagonals < 0, far, 0) if anchored else np.zeros(len(diagonals), dtype=np.int64)
    row = np.where((diagonals < 0) | (diagonals > len(text)), far, row)
    # Cell (i, d) is text position d + i; positions outside the text cost too much.
    at = diagonals + np.arange(len(item))[:, None]
    inside = (at >= 0) & (at < len(text))
    padded = np.append(text, np.uint32(0xFFFFFFFF))
    change = (~inside | (padded[np.where(inside, at, -1)] != np.asarray(item)[:, None])).astype(np.int64)
    barred = np.where((at + 1 < 0) | (at + 1 > len(text)), far, 0)
    ladder = np.arange(len(diagonals))
    skip = np.full(len(diagonals), far)
    for i in range(len(item)):
        skip[:-1] = row[1:] + 1  # an item character without a partner
        row = np.minimum(row + change[i], skip) + barred[i]
        row = np.minimum.accumulate(row - ladder) + ladder  # text characters without a partner
    best = int(row.argmin())
    return int(row[best]), int(diagonals[best]) + len(item)


@dataclass
class ItemIndex:
    """The q-grams of a block of items."""

    q: int
    ids: list
    texts: list[str]
    edit_rate: float

    def __post_init__(self):
        self.codes = [_codes(t) for t in self.texts]
        #: Items of several regions.
        self.cut = {n: k > 1 for n, k in Counter(self.ids).items()}
        grams = [qgrams(c, self.q) for c in self.codes]
        hashes = np.concatenate([*grams, np.empty(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.place = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)]).astype(np.int64)[order]
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        length = np.array([len(c) for c in self.codes], dtype=np.int64)
        # The edit budget, as far as the lemma still asks for one shared q-gram.
        self.budget = np.minimum((length * self.edit_rate).astype(np.int64), np.maximum((length - self.q) // self.q, 0))
        self.needed = np.maximum(length - self.q + 1 - self.budget * self.q, 1)
        self.short = [i for i, n in enumerate(length) if 0 < n < self.q]

    def _bands(self, at: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of region and band, and how many q-grams they share with the text:
        those at ``at``, which the index holds ``n`` times from ``first`` on."""
        hit = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        item = self.item[hit]
        band = np.floor_divide(np.repeat(at, n) - self.place[hit], self.budget[item] + 1)
        # Band b covers the diagonals from b * width on, twice the width wide.
        item, band = np.r_[item, item], np.r_[band, band - 1]
        return np.unique(item * (1 << 40) + band + (1 << 39), return_counts=True)

    def leaks(self, text: str) -> list[tuple]:
        """``(item, start, end, edits)``: regions of an item that overlap or touch in
        the text are one place, with the most edits that one of them has."""
        places: list[tuple] = []
        for item, start, end, edits in sorted(((self.ids[i], *m) for i, *m in self.matches(text)), key=lambda m: (str(m[0]), m[1:])):
            if places and places[-1][0] == item and start <= places[-1][2] + 1 and self.cut.get(item):
                item, was, stop, most = places.pop()
                start, end, edits = was, max(end, stop), max(edits, most)
            places.append((item, start, end, edits))
        return places

    def matches(self, text: str) -> list[tuple]:
        """``(index, start, end, edits)`` in the normalised text: each place of a
        region.  Regions shorter than ``q`` are found as whole words only."""
        text = normalised(text)
        whole = ((i, re.compile(rf"(?<!\S){re.escape(self.texts[i])}(?!\S)")) for i in self.short)
        found = [(i, m.start(), m.end(), 0) for i, word in whole for m in word.finditer(text)]
        codes = _codes(text)
        grams = qgrams(codes, self.q)
        at = np.flatnonzero(self.filter[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return found
        first = np.searchsorted(self.hashes, grams[at], "left")
        n = np.searchsorted(self.hashes, grams[at], "right") - first
        # A frequent q-gram may stand in very many regions: counted in pieces.
        cuts = np.flatnonzero(np.diff(np.cumsum(n) // _HITS, prepend=-1))
        counted = [self._bands(*(x[a:b] for x in (at, first, n))) for a, b in zip(cuts, [*cuts[1:], len(n)], strict=True)]
        key, group = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
        count = np.bincount(group, np.concatenate([c for _, c in counted]), len(key)).astype(np.int64)
        good = count >= self.needed[key >> 40]
        near: dict[int, list[tuple]] = {}
        for k in key[good][np.argsort(-count[good], kind="stable")]:
            i = int(k >> 40)
            b, w, m = int(k & ((1 << 40) - 1)) - (1 << 39), int(self.budget[i]) + 1, len(self.codes[i])
            low, regions = (b - 1) * w, near.setdefault(i, [])
            edge = max(0, low)
            stop = max(edge, (b + 3) * w + m)
            if any(not edits and edge <= start and end <= stop for edits, start, end in regions):
                continue  # an overlapping band has told of it
            if (start := text.find(self.texts[i], edge, stop)) >= 0:
                regions.append((0, start, start + m))
                continue
            part = codes[edge:stop]
            edits, end = banded_alignment(self.codes[i], part, low - edge, (b + 3) * w - edge)
            if edits <= self.budget[i]:
                back, length = banded_alignment(self.codes[i][::-1], part[:end][::-1], -w, w, anchored=True)
                start = end - length if back <= edits else max(0, end - m)
                regions.append((edits, edge + start, edge + end))
        for i, regions in near.items():  # overlapping bands tell of one region
            taken: list[tuple] = []
            for edits, start, end in sorted(regions):
                if all(end <= s or start >= e for _, s, e in taken):
                    taken.append((edits, start, end))
            found += [(i, start, end, edits) for edits, start, end in taken]
        return found


def item_blocks(benchmark: DataFrame, item_id: str, text_col: str, q: int, edit_rate: float, block_chars: int, region_words: int):
    """Indexes of the items' regions, dealt into blocks of items of about ``block_chars``."""
    items = benchmark.select(F.col(item_id).cast("long").alias("_item"), text_or_empty(text_col).alias("_text"))
    chars = items.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()[0]
    blocks = -(-chars // block_chars)
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == b).collect()
        own = sorted({(r["_item"] is not None, r["_item"] or 0, normalised(r["_text"])) for r in own})
        own = [(n if known else None, t) for known, n, whole in own if whole for t in regions(whole, region_words)]
        yield ItemIndex(q, [n for n, _ in own], [t for _, t in own], edit_rate)


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    q: int = Q,
    edit_rate: float = EDIT_RATE,
    block_chars: int = BLOCK_CHARS,
    region_words: int = REGION_WORDS,
) -> DataFrame:
    """One row per place where a document holds an item, up to ``edit_rate`` edits
    per character: ``(id, item_id, start, end, edits)``, positions being
    characters of the normalised text.

    Items of up to ``region_words`` words are found whole; of longer ones every
    region of that many words, so a passage of one and a half times as many is
    found wherever it stands in the item.  Null or empty texts and items match
    nothing; items shorter than ``q`` characters match exactly, as whole words;
    repeated items count once; repeated rows are each reported; null ids are
    kept; an empty table gives an empty result; other columns are not carried."""
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    schema = "_id long, _item long, start long, end long, edits int"
    out = spark.createDataFrame([], schema)
    for n, index in enumerate(item_blocks(benchmark, item_id, item_text, q, edit_rate, block_chars, region_words)):
        found = rows.mapInArrow(_leaks(spark.sparkContext.broadcast(index)), schema)
        out = found if n == 0 else out.unionByName(found)
    return out.withColumnsRenamed({"_id": id_col, "_item": item_id})


def _leaks(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: ItemIndex = index.value
        for batch in batches:
            rows = [
                (d, item, start, end, edits)
                for d, text in zip(batch.column("_id").to_pylist(), batch.column("_text"), strict=True)
                for item, start, end, edits in own.leaks(text.as_py())
            ]
            kinds = [pa.int64()] * 4 + [pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                names=["_id", "_item", "start", "end", "edits"],
            )

    return run


def drop_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    q: int = Q,
    edit_rate: float = EDIT_RATE,
    block_chars: int = BLOCK_CHARS,
    region_words: int = REGION_WORDS,
) -> DataFrame:
    """The rows of ``df`` that hold no item (as :func:`find_leaks` finds them), in
    their own columns.  Null and empty texts stay, repeated rows are judged
    alike; without items, or rows, nothing changes."""
    spark = df.sparkSession
    prepare(spark)
    for index in item_blocks(benchmark, item_id, item_text, q, edit_rate, block_chars, region_words):
        clean = _clean(spark.sparkContext.broadcast(index))
        df = df.where(clean(F.coalesce(df[text_col].cast("string"), F.lit(""))))
    return df


def _clean(index):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: not index.value.matches(t)).astype(bool)

    return clean

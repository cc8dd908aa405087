"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers cut a text's bytes; where tokens of both end, a group ends.  A
merge of the two lists of token ends by two pointers gives the groups and the
links, the pairs of tokens that overlap.  Spark then counts in how many
documents each pair of ids is linked, and joins the counts, and the highest
counts of each side's ids, back to the documents.

Neither tokenizer here merges across the gap before a word, so a group never
reaches across one either: words are aligned once per worker and remembered,
and a document is put together from its words.  Where that does not hold, or a
word's bytes do not come back, the whole text is aligned at once.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_codec import MEMO_CHARS, Recent, split_words
from .common import materialize, prepare, text_or_empty
from .tokens import ByteBPE, PieceCounter, _byte_symbols

#: Pairs whose counts are broadcast: those with at least this share of all links
#: between different ids in documents.  So there are at most as many.
HOT_PAIRS = 100_000

ALIGNED = "_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<bigint>, times array<int>"


def merge_ends(a: list[int], b: list[int], len_a: list[int], len_b: list[int]) -> tuple[list[int], list[str]]:
    """Two pointers over the tokens of two sides that have the same length in all:
    the links ``a << 32 | b`` of all that overlap, and the groups between the
    places where both sides end, as text."""
    links, groups = [], []
    i = j = from_a = from_b = 0
    end_a, end_b = len_a[0], len_b[0]
    while True:
        links.append(a[i] << 32 | b[j])
        if end_a < end_b:
            i += 1
            end_a += len_a[i]
        elif end_b < end_a:
            j += 1
            end_b += len_b[j]
        else:
            if i == from_a and j == from_b:
                groups.append(f"{a[i]}|{b[j]}")
            else:
                groups.append(",".join(map(str, a[from_a : i + 1])) + "|" + ",".join(map(str, b[from_b : j + 1])))
            i, j = i + 1, j + 1
            if i == len(a):
                return links, groups
            from_a, from_b = i, j
            end_a, end_b = end_a + len_a[i], end_b + len_b[j]


#: A stretch of text: tokens of A, of B, groups, the groups as text, and the links.
Aligned = tuple[int, int, int, str, tuple[int, ...]]

NOTHING: Aligned = (0, 0, 0, "", ())


class Aligner:
    """Tokenizer A, a byte-level BPE ``tokenizer.json``, reads the text behind a
    blank; tokenizer B, a sentencepiece ``.model``, the text itself."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteBPE(a_path), PieceCounter(b_path)
        with open(a_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        symbols, model = _byte_symbols(), self.b.model
        self.a_bytes = {i: bytes(symbols[c] for c in t) for t, i in vocab.items() if all(c in symbols for c in t)}
        if not self.a.fast:
            self.a.whole.encode_special_tokens = True
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(map(model.id_to_piece, range(model.get_piece_size())))
        ]
        self.by_word = self.a.fast and self.b.by_word
        self.memo = Recent()

    def _merge(self, spaced: str, b: list[int]) -> Aligned | None:
        """The alignment of a stretch that starts with a blank; none where either
        side's bytes are not the stretch's."""
        if self.a.fast:
            a = self.a.engine.encode_ordinary(spaced)
        else:
            a = self.a.whole.encode(spaced, add_special_tokens=False).ids
        data, bytes_a, bytes_b = spaced.encode(), [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            return None
        links, groups = merge_ends(a, b, list(map(len, bytes_a)), list(map(len, bytes_b)))
        return len(a), len(b), len(groups), ";".join(groups), tuple(links)

    def _whole(self, text: str) -> Aligned:
        return self._merge(" " + text, self.b.model.encode(text, num_threads=1)) or NOTHING

    def align_all(self, texts: list[str]) -> list[tuple[int, int, int, int, str, list[int], list[int]]]:
        """Per text: tokens of A and of B, groups, links, the groups as text, and the
        different linked pairs with how often each occurs."""
        cut = [split_words(text) if self.by_word else [] for text in texts]
        new, known, out = self.memo.missing(set(chain.from_iterable(cut))), self.memo.young, []
        coded = self.b.model.encode(new, num_threads=1)
        known.update(zip(new, map(self._merge, [" " + word for word in new], coded), strict=True))
        odd = {word for word in new if known[word] is None}
        for text, own in zip(texts, cut, strict=True):
            if not text:
                found = [NOTHING]
            elif not own or not odd.isdisjoint(own):
                found = [self._whole(text)]
            else:
                found = list(map(known.__getitem__, own))
            n_a, n_b, n_groups, groups, links = zip(*found, strict=True)
            pairs = Counter(chain.from_iterable(links))
            out.append((sum(n_a), sum(n_b), sum(n_groups), pairs.total(), ";".join(groups), list(pairs), list(pairs.values())))
        self.memo.forget(word for word in new if len(word) > MEMO_CHARS or word in odd)
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per worker process and pair of files."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def align_tokens(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, groups, pairs, times)`` of every row.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of A and of B, group by group.
    ``pairs`` are the different linked ids as ``a << 32 | b``, ``times`` how often
    each is linked.  Strings of special tokens are plain text.  A text that is
    null or empty, or that either tokenizer's tokens do not spell out behind one
    blank, has no tokens: zeros, an empty string and no pairs.  Null ids are kept,
    repeated rows are rows of their own, an empty table gives an empty result,
    other columns are not carried."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = _aligner(a_path, b_path)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                found = list(zip(*aligner.align_all(part["_text"].tolist()), strict=True))
                names = ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
                yield pd.DataFrame({"_id": part["_id"].array} | dict(zip(names, map(list, found), strict=True)))

    rows = df.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    return rows.mapInPandas(run, ALIGNED).withColumnRenamed("_id", id_col)


def link_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, a_id, b_id, docs, best_of_a, best_of_b)``: in how many documents two
    ids are linked, and whether that is the highest count of either id.

    Counted in part before the shuffle.  The highest counts are a row for each
    id at most, so the vocabularies bound what is broadcast."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    a, b = F.shiftright("pair", 32).cast("int"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int")
    counts = found = materialize(counts.select("pair", a.alias("a_id"), b.alias("b_id"), "docs"), "pairs")
    for side in ("a", "b"):
        highest = counts.groupBy(f"{side}_id").agg(F.max("docs").alias("_most"))
        best = (F.col("docs") == F.col("_most")).alias(f"best_of_{side}")
        found = found.join(F.broadcast(highest), f"{side}_id").select(*found.columns, best)
    return found


def score_links(aligned: DataFrame) -> DataFrame:
    """``aligned`` without ``pairs`` and ``times``, with ``n_best_a`` and ``n_best_b``
    (links whose pair has the highest count of its A or B id, ties included) and
    ``count_sum`` (the pairs' counts, summed over links).  Zeros where there are
    no links; other columns of ``aligned`` are carried.

    Pairs that hold a good share of all links are joined by broadcast, so no key
    of the shuffled join is hot: a pair there has fewer than a hundred-thousandth
    of all rows."""
    told = [c for c in aligned.columns if c not in ("pairs", "times")]
    rows = materialize(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(link_counts(rows).select("pair", "docs", "best_of_a", "best_of_b"), "link_counts")
    total = counts.agg(F.sum("docs")).first()[0] or 0
    is_hot = F.col("docs") * HOT_PAIRS >= total
    hot, cold = F.broadcast(counts.where(is_hot)), counts.where(~is_hot)
    links = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("_l")).select("_row", "_l.pairs", "_l.times")
    links = links.withColumnRenamed("pairs", "pair")

    def summed(found: DataFrame) -> DataFrame:
        best = [F.sum(F.when(F.col(f"best_of_{s}"), F.col("times")).otherwise(0)).alias(f"n_best_{s}") for s in "ab"]
        return found.groupBy("_row").agg(*best, F.sum(F.col("docs") * F.col("times")).alias("count_sum"))

    parts = summed(links.join(hot, "pair")).unionByName(summed(links.join(hot, "pair", "left_anti").join(cold, "pair")))
    names = ["n_best_a", "n_best_b", "count_sum"]
    sums = parts.groupBy("_row").agg(*[F.sum(n).alias(n) for n in names])
    zeros = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names]
    return rows.select("_row", *told).join(sums, "_row", "left").select(*told, *zeros)

"""Byte-level BPE, both ways, by a sentencepiece model made from a rank file.

The rank file's entries become the pieces of a BPE model: each byte is written
as a printable character, an entry's score is its negative rank, and nothing is
normalised.  Merging the adjacent pair of the best score is then merging the
pair of the lowest rank.  Texts are cut into pre-tokens, each pre-token is
encoded on its own, and ids are decoded by the inverse mapping.  As words
repeat a lot, a worker remembers the ids of words it has met.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_or_empty
from .tokens import _DOUBLE_SPACE, _GAP, _byte_symbols, loaded

#: Words that a worker remembers, and the longest one.
MEMO_ENTRIES, MEMO_CHARS = 300_000, 64

_SYMBOL = {byte: char for char, byte in _byte_symbols().items()}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a base64 entry and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(entry): int(rank) for entry, rank in (line.split() for line in f if line.strip())}


def mapped(data: bytes) -> str:
    """The bytes as the printable characters that stand for them."""
    return data.decode("latin-1").translate(_SYMBOL)


def mapped_all(found: list[str]) -> list[str]:
    """The UTF-8 of each, mapped at once: the byte 0xFF, which UTF-8 has not, parts them."""
    return mapped(b"\xff".join([word.encode() for word in found])).split(_SYMBOL[0xFF]) if found else []


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _nested(field: int, data: bytes) -> bytes:
    """A length-delimited protobuf field."""
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> tuple[bytes, list[int]]:
    """The sentencepiece BPE model of a vocabulary, and the rank of each piece.

    All 256 bytes must be entries: then no text is out of the vocabulary, and
    the unknown piece that a model must have, the last one, is never used."""
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    # Field numbers and enumerations of sentencepiece's model format.
    normal, unknown, bpe = 1, 2, 2
    order = sorted(ranks, key=ranks.__getitem__)
    entries = [(mapped(entry), -float(ranks[entry]), normal) for entry in order] + [("<unk>", 0.0, unknown)]
    pieces = b"".join(
        _nested(1, _nested(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))
        for text, score, kind in entries
    )
    trainer = _number(3, bpe) + _number(4, len(entries)) + _number(40, len(order))
    identity = _nested(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return pieces + _nested(2, trainer) + _nested(3, identity), [ranks[entry] for entry in order]


def _ranges(chars: set[str]) -> str:
    """The characters as ranges of a set in a pattern."""
    codes, out = sorted(map(ord, chars)), []
    for code in codes:
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class PreTokens:
    """All matches of a pattern as tiktoken finds them.

    Its engine and ours know different versions of Unicode.  The letters and
    digits that only one of them knows are found by asking both about every
    character once; texts that hold one are cut by a corrected pattern."""

    def __init__(self, pattern: str):
        import tiktoken

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        one = {bytes([b]): b for b in range(256)}
        corrected, odd = pattern, set()
        for kind in (r"\p{L}", r"\p{N}", r"\s"):
            theirs = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=one, special_tokens={})
            there = set(theirs.decode(theirs.encode_ordinary(every)))
            here = set(regex.findall(kind, every))
            if here != there:
                less, more = _ranges(here - there), _ranges(there - here)
                own = f"[{kind}--[{less}]]" if less else kind
                corrected = corrected.replace(kind, f"[{own}||[{more}]]" if more else own)
                odd |= here ^ there
        self.plain = regex.compile(pattern).findall
        self.corrected = regex.compile(corrected, regex.V1).findall
        self.odd = regex.compile(f"[{_ranges(odd)}]").search if odd else None

    def __call__(self, text: str) -> list[str]:
        if self.odd is None or text.isascii() or not self.odd(text):
            return self.plain(text)
        return self.corrected(text)


def split_words(text: str) -> list[str]:
    """The text cut at each single blank between two words, without that blank: no
    pre-token reaches across such a place, and each such blank belongs to the
    word behind it."""
    if not text or text[0].isspace() or text[-1].isspace() or _DOUBLE_SPACE.search(text):
        return _GAP.split(text)
    return text.split(" ")


class Recent:
    """A bounded memo in two ages: the older half goes when the younger is full,
    but for what has been asked for again."""

    def __init__(self, most: int = MEMO_ENTRIES):
        self.young, self.old, self.half = {}, {}, most // 2

    def missing(self, asked: set[str]) -> list[str]:
        """The words that are not known; the others are young from now on."""
        new = asked.difference(self.young)
        known = {word for word in new if word in self.old}
        self.young.update((word, self.old[word]) for word in known)
        return list(new - known)

    def forget(self, words: Iterable[str]) -> None:
        for word in words:
            del self.young[word]
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}


class ByteCodec:
    """Encodes texts to, and decodes them from, ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        import sentencepiece
        from public_tokenizers import PATTERN

        ranks = read_ranks(path)
        data, order = serialise_model(ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.rank_of = np.array(order, "<u4")
        symbols = {ord(char): byte for byte, char in _SYMBOL.items()}
        pieces = [self.model.id_to_piece(i) for i in range(len(order))]
        self.entry = dict(zip(order, (p.translate(symbols).encode("latin-1") for p in pieces), strict=True))
        # An entry is its own token, also where no merges lead to it.
        merged = self.model.encode(pieces, num_threads=1)
        self.unreached = {p: [i] for i, (p, ids) in enumerate(zip(pieces, merged, strict=True)) if ids != [i]}
        self.split, self.memo = PreTokens(PATTERN), Recent()

    def _encode_new(self, new: list[str]) -> list[bytes]:
        """The ids of each word, by one call of the library for all their pre-tokens."""
        pieces = list(map(self.split, new))
        entries = mapped_all(list(chain.from_iterable(pieces)))
        coded = self.model.encode(entries, num_threads=1)
        if self.unreached:
            coded = [self.unreached.get(entry, ids) for entry, ids in zip(entries, coded, strict=True)]
        flat = self.rank_of[np.fromiter(chain.from_iterable(coded), "<i8")].tobytes()
        ends = np.cumsum([0, *map(len, coded)])[np.cumsum([0, *map(len, pieces)])] * 4
        return [flat[a:b] for a, b in pairwise(ends.tolist())]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        cut = [[first, *[" " + word for word in rest]] for first, *rest in map(split_words, texts)]
        new, known = self.memo.missing(set(chain.from_iterable(cut))), self.memo.young
        known.update(zip(new, self._encode_new(new), strict=True))
        out = [b"".join(map(known.__getitem__, own)) for own in cut]
        self.memo.forget(word for word in new if len(word) > MEMO_CHARS)
        return out

    def decode_all(self, coded: list[bytes]) -> list[bytes]:
        try:
            return [b"".join(map(self.entry.__getitem__, np.frombuffer(ids, "<u4").tolist())) for ids in coded]
        except KeyError as error:
            raise ValueError(f"no entry has the id {error.args[0]}") from None


def _mapped(path: str, method: str, column: str, out: str, *dropped: str):
    """Batches with ``out``, what the codec's method makes of ``column``, as the
    last column and without the ``dropped`` ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = getattr(loaded(ByteCodec, path), method)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                made = pa.array(work(piece.column(column).to_pylist()), pa.binary())
                names = [n for n in piece.schema.names if n not in dropped]
                yield pa.RecordBatch.from_arrays([*map(piece.column, names), made], names=[*names, out])

    return run


def encode_texts(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, token_ids)`` of every row, ids as little-endian uint32,
    as tiktoken's ``encode_ordinary`` gives them: strings of special tokens are
    plain text.

    A null or empty text has no tokens; ids of rows, null ones too, are passed
    on; repeated rows are encoded each; an empty table gives an empty result;
    other columns are not carried."""
    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    coded = rows.mapInArrow(_mapped(ranks_path, "encode_all", "_text", "token_ids", "_text"), "_id long, token_ids binary")
    n = (F.octet_length("token_ids") / 4).cast("long")
    return coded.select(F.col("_id").alias(id_col), n.alias("n_tokens"), "token_ids")


def decode_ids(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """``(id, token_ids, decoded)``: the bytes that the ids stand for.

    Bytes, not text: a cut-out of a text's ids need not be valid UTF-8.  Null
    ids decode to no bytes; an id that the vocabulary lacks is an error; an
    empty table gives an empty result; other columns are not carried."""
    prepare(df.sparkSession)
    ids = F.coalesce(F.col(ids_col).cast("binary"), F.lit(b"").cast("binary"))
    rows = df.select(F.col(id_col).cast("long").alias("_id"), ids.alias("_ids"))
    out = rows.mapInArrow(_mapped(ranks_path, "decode_all", "_ids", "decoded"), "_id long, _ids binary, decoded binary")
    return out.select(F.col("_id").alias(id_col), F.col("_ids").alias(ids_col), "decoded")

"""Exact, fast use of the two public tokenizer libraries inside tasks.

Both tokenizers here never merge across the gap in front of a word, so a text
is the concatenation of its words' tokens, and words repeat a lot.  A bounded
memo per worker then encodes each word once.  Whether a tokenizer really has
that property is checked when it is loaded; if not, whole texts are encoded.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np

#: Words that a worker's memo holds before it starts anew.
MEMO_WORDS = 200_000

_LOADED: dict[tuple, object] = {}
_DOUBLE_SPACE = re.compile(r"\s\s")
_GAP = re.compile(r"(?<=\S) (?=\S)")
_RUN = re.compile(r" *[^ ]+| +")


def loaded(kind, path: str):
    """One tokenizer per worker process and file."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


class _Memo(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word):
        if len(self) >= MEMO_WORDS:
            self.clear()
        out = self[word] = self.encode(word)
        return out


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files use for bytes: a byte
    that is printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE ``tokenizer.json``: ids as little-endian uint32 bytes.

    The merges are run by tiktoken, which is several times as fast and gives
    the same ids when merge number i makes id 256 + i; otherwise, or if the
    file has another pre-tokenizer or a normalizer, the tokenizers library
    encodes whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        plain_added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
        merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
        vocab = model["vocab"]
        ordered = all(vocab.get(m.replace(" ", "")) == 256 + i for i, m in enumerate(merges))
        self.fast = (
            model.get("type") == "BPE"
            and ordered
            and plain_added
            and spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
        )
        if self.fast:
            import tiktoken
            from public_tokenizers import PATTERN

            symbols = _byte_symbols()
            ranks = {bytes(symbols[c] for c in token): i for token, i in vocab.items() if token not in self.special}
            self.engine = engine = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.memo = _Memo(lambda word: np.array(engine.encode_ordinary(word), dtype="<u4").tobytes())
            self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        else:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(path)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0].isspace() or text[-1].isspace() or _DOUBLE_SPACE.search(text):
            words = _GAP.split(text)
        else:
            words = text.split(" ")
        memo = self.memo.__getitem__
        return memo(words[0]) + b"".join([memo(" " + w) for w in words[1:]])

    def encode(self, text: str) -> bytes:
        if not self.fast:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.marks is None or not self.marks.search(text):
            return self._plain(text)
        parts = self.marks.split(text)
        return b"".join(
            np.array([self.special[p]], "<u4").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts)
        )


class PieceCounter:
    """Token counts by a sentencepiece ``.model``."""

    #: Texts on which counting by words must agree with the library.
    PROBES = ("", " ", "a", " a", "a  b\n c　d ", "ﬁ é  x\ty z", "▁a ▁", "  <s> b</s>  한")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.memo = _Memo(lambda word: len(self.model.encode(word, num_threads=1)))
        self.by_word = self.by_word and all(self._words(p) == self._whole(p) for p in self.PROBES)

    def _whole(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))

    def _words(self, text: str) -> int:
        # The library puts one gap in front of what it is given: take one off.
        if "▁" in text:  # the gap's own sign would act as a gap
            return self._whole(text)
        memo = self.memo.__getitem__
        if "  " not in text and text[:1] not in ("", " ") and text[-1] != " ":
            return sum(map(memo, text.split(" ")))
        runs = _RUN.findall(text)
        return sum(memo(r if i == 0 else r[1:]) if i == 0 or len(r) > 1 else self._gap(runs, i) for i, r in enumerate(runs))

    def _gap(self, runs: list[str], i: int) -> int:
        """A text's last run may be one blank: what it adds to the run before."""
        before = runs[i - 1] if i == 1 else runs[i - 1][1:]
        return self._whole(before + runs[i]) - self.memo[before]

    def count(self, text: str) -> int:
        return self._words(text) if self.by_word else self._whole(text)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()

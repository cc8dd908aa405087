"""Word shingles as sets of 64-bit hashes, computed with numpy on UTF-8 bytes,
many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

# Odd multipliers of the hash functions.
_BASE = 0x9E3779B97F4A7C15
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_STEP = 0xD6E8FEB86659FD93

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, np.ndarray] = {}
#: Characters of texts that are hashed at a time; longer texts go alone.
_AT_ONCE = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


_INVERSE = pow(_BASE, -1, 1 << 64)


def _hashed(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, A-Z lower-cased,
    in order; and where each text's words begin, and the end.

    Words are slices of one polynomial prefix sum modulo 2^64."""
    parts = [text.encode().lower() for text in texts]
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
    starts = np.cumsum([1, *(len(p) + 1 for p in parts)])
    gap = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    begin, end = edge[0::2], edge[1::2]
    n = len(data)
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64)
    hashes = mixed((sums[end - 1] - sums[begin - 1]) * _powers(_INVERSE, n)[begin])
    return hashes, np.searchsorted(begin, starts)


def word_hashes(text: str) -> np.ndarray:
    return _hashed([text])[0]


def _sorted_set(words: np.ndarray, width: int) -> np.ndarray:
    span = min(width, len(words))
    if not span:
        return words
    out = mixed(words[: len(words) - span + 1] + np.uint64(span))
    for i in range(1, span):
        out = mixed(out * np.uint64(_STEP) + words[i : len(words) - span + 1 + i])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words give
    one shingle of all of them, no words none."""
    return _sorted_set(word_hashes(text), width)


def shingle_sets(texts: Sequence[str], width: int) -> Iterator[np.ndarray]:
    """The sets of many texts, in order."""
    at = 0
    while at < len(texts):
        size, stop = len(texts[at]), at + 1
        while stop < len(texts) and size + len(texts[stop]) <= _AT_ONCE:
            size, stop = size + len(texts[stop]), stop + 1
        hashes, starts = _hashed(texts[at:stop])
        words = np.diff(starts)
        full = words >= width
        # Windows that reach into the next text are left out below.
        if len(hashes) >= width:
            grams = mixed(hashes[: len(hashes) - width + 1] + np.uint64(width))
            for i in range(1, width):
                grams = mixed(grams * np.uint64(_STEP) + hashes[i : len(hashes) - width + 1 + i])
        for i in range(stop - at):
            if full[i]:
                out = np.sort(grams[starts[i] : starts[i + 1] - width + 1])
                fresh = out[1:] != out[:-1]
                yield out if fresh.all() else out[np.concatenate(([True], fresh))]
            else:
                yield _sorted_set(hashes[starts[i] : starts[i + 1]], width)
        at = stop


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum()) if len(large) else 0

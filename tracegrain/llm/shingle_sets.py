"""Word shingle sets as sorted arrays of 64-bit hashes, by array operations over the bytes of a text."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
# bytes of a shingle's words from which it counts as one level rarer: chance repeats are short runs of common words
RARER = (14, 18, 22, 26, 30, 36, 44)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b]), 7) for b in range(256)], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    table = _powers[name]
    if len(table) < n:
        table = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16) - 1, base)]), dtype=np.uint64)
        _powers[name] = table
    return table[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX_1
    h = (h ^ (h >> np.uint64(27))) * _MIX_2
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte lengths of the words `[^\\x20\\x09-\\x0D]+` after A-Z have been lower-cased.

    A word's hash is the polynomial of its bytes: a difference of prefix sums, shifted to the word's beginning.
    """
    raw = np.frombuffer(text.encode("utf-8").lower(), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edge[::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power("up", _ODD, len(raw)), out=sums[1:])
    return _mixed((sums[stop] - sums[start]) * _power("down", _INVERSE, len(raw))[start]), stop - start


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of all runs of `width` words; a shorter text is one run, a text without words none.

    The upper three bits hold a level by the length of the words, 0 for the longest, so that the sorted order begins with
    shingles that are likely to be rare.
    """
    words, sizes = word_hashes(text or "")
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    h, size = np.full(n, np.uint64(min(len(words), width))), np.zeros(n, np.int64)
    for j in range(min(width, len(words))):
        h = _mixed(h * _ODD + words[j:j + n])
        size += sizes[j:j + n]
    level = (len(RARER) - np.searchsorted(RARER, size, side="right")).astype(np.uint64)
    return np.unique((h >> np.uint64(3)) | (level << np.uint64(61)))


def signed(value: int) -> int:
    return value - (1 << 64) * (value >> 63)


def digest(tokens: np.ndarray) -> int:
    """A set's identity as a signed 64-bit number."""
    return signed(xxhash.xxh3_64_intdigest(tokens.tobytes()))

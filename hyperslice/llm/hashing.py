"""Words of many texts as 64-bit hashes, by array operations on their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SLOTS = 64
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, (_SLOTS, 256), dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes of words: all but space and \\x09-\\x0D; or digits, letters and all bytes of non-ASCII characters.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def hashed_words(texts: list[bytes], word_bytes: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order with A-Z folded, number of words of each text). Positions over 64 are mixed in by
    a multiplier for each 64, so that words of any length count whole."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    inside = word_bytes[raw]
    edges = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)  # each text ends with a space
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(lens)))))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    place = np.flatnonzero(inside)
    width = ends - starts
    first = np.concatenate(([0], np.cumsum(width)[:-1]))
    at = np.arange(len(place)) - np.repeat(first, width)
    value = _TABLE[at & (_SLOTS - 1), _FOLD[raw[place]]]
    if width.max() > _SLOTS:
        value = value * (2 * (at // _SLOTS).astype(np.uint64) * np.uint64(0x5851F42D4C957F2D) + np.uint64(1))
    return _mix(np.add.reduceat(value, first)), counts


def in_parts(texts: list[bytes], size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` bytes together."""
    a = held = 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= size:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(texts):
        yield a, len(texts)

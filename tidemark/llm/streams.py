"""Batches of texts as numpy arrays of code points: words, word hashes and normalised streams, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    """For every code point: 0, or itself if it is a letter or digit."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if chr(c).isalnum():
            table[c] = c
    return table


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, one after the other, and where each begins (with the end as last entry)."""
    lowered = [t.lower() for t in texts]
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in lowered], out=bounds[1:])
    return np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), bounds


def chunks(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def words(cp: np.ndarray, bounds: np.ndarray, drop_removed_lines: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each word: an unbroken run of letters or digits within one text.

    With ``drop_removed_lines`` the lines that start with ``-`` have no words; lines end at line feed, carriage
    return or both.
    """
    al = _tables()[cp] > 0
    if drop_removed_lines and len(cp):
        begins = np.zeros(len(cp) + 1, dtype=bool)
        begins[bounds[:-1]] = True
        ends = np.flatnonzero((cp == 10) | (cp == 13))
        begins[ends + 1] = True
        first = np.flatnonzero(begins[:-1])
        removed = cp[first] == 45
        length = np.diff(np.append(first, len(cp)))
        al &= ~np.repeat(removed, length)
    edge = np.zeros(len(cp) + 1, dtype=bool)
    edge[bounds] = True
    starts = al & ~np.append(False, al[:-1])
    stops = al & ~np.append(al[1:], False)
    inner = edge[1:-1]  # between neighbours of different texts
    if len(cp) > 1:
        starts[1:] |= al[1:] & inner
        stops[:-1] |= al[:-1] & inner
    s, e = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    return s, e, np.searchsorted(bounds, s, side="right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MUL
    return h ^ (h >> np.uint64(29))


def word_hashes(cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's code points, by length-position polynomials over the word only."""
    if not len(s):
        return np.zeros(0, dtype=np.uint64)
    length = e - s
    inside = np.repeat(s, length) + (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
    place = (inside - np.repeat(s, length)).astype(np.uint64)
    terms = mix(cp[inside].astype(np.uint64) + (place + np.uint64(1)) * _ODD)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(terms, np.cumsum(length) - length) + length.astype(np.uint64))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of every ``n`` successive entries."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    m = len(h) - n + 1
    out = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _ODD + h[k : k + m]
    return mix(out)

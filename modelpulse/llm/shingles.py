"""Words and shingles of many texts at once, as arrays of hashes."""

from __future__ import annotations

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values to 64-bit values without visible order."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, in order, and the number of words of each text."""
    raw = [t.encode("utf-8") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    blank = BLANK[data]
    start = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    end = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    size = end - start
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    # Place of each byte in its word; bytes of blanks don't count.
    opening = np.append(0, start)
    place = np.arange(len(data)) - np.repeat(opening, np.diff(np.append(opening, len(data))))
    power = np.cumprod(np.full(int(size.max()) + 1, BASE, np.uint64))
    value = BYTE[data] * power[np.minimum(place, len(power) - 1)]
    value[blank] = 0
    words = mixed(np.add.reduceat(value, start) ^ size.astype(np.uint64))
    edges = np.cumsum([0] + [len(r) + 1 for r in raw])
    counts = np.diff(np.searchsorted(start, edges))
    return words, counts.astype(np.int64)


def shingle_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `width` words of all texts, and how many each text has.

    A text of fewer words has one shingle of all its words, a text without words none.
    """
    words, counts = word_hashes(texts)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    if not len(words):
        return words, sizes
    first = np.cumsum(counts) - counts
    start = np.repeat(first, sizes) + ragged_range(sizes)
    stop = np.repeat(first + counts, sizes)
    out = np.zeros(len(start), np.uint64)
    for k in range(width):
        at = start + k
        inside = at < stop
        factor = mixed(np.array([k + 1], np.uint64))[0] | np.uint64(1)
        out[inside] += words[at[inside]] * factor
    return mixed(out), sizes


def ragged_range(sizes: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n, behind one another."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)

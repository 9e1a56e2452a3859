"""Words of whole texts as arrays: where they start and end, and a 64-bit hash of each.

Texts come as one run of UTF-8 bytes with offsets. The bytes are read in slices that end between
words, so scratch memory follows the slice and not the text; what is returned takes 24 bytes a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from vacantlens.llm.text import mix

#: Bytes read at a time.
SLICE = 1 << 20

_POWER = [np.ones(1, np.uint64)]
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    """The base's powers for the bytes of a word, enough for words of ``n`` bytes."""
    if len(_POWER[0]) < n:
        steps = np.full(max(n, 256), _BASE, np.uint64)
        steps[0] = 1
        _POWER[0] = np.multiply.accumulate(steps)
    return _POWER[0]


def byte_table(values: bytes) -> np.ndarray:
    """True at the given bytes."""
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


def same_bytes() -> np.ndarray:
    return np.arange(256, dtype=np.uint8)


def lower_bytes() -> np.ndarray:
    """A-Z as a-z, every other byte as it is."""
    table = same_bytes()
    table[65:91] += 32
    return table


@dataclass
class Words:
    """The words of a batch of texts, in order."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    #: Words of each text.
    counts: np.ndarray


def _slice_end(data: np.ndarray, blank: np.ndarray, low: int, high: int) -> int:
    """End of the slice that begins at ``low``: after a blank, or ``high``."""
    stop = low + SLICE
    if stop >= high:
        return high
    gaps = np.flatnonzero(blank[data[low:stop]])
    if len(gaps):
        return low + int(gaps[-1]) + 1
    while stop < high:  # one word fills the slice
        gaps = np.flatnonzero(blank[data[stop : stop + SLICE]])
        if len(gaps):
            return stop + int(gaps[0]) + 1
        stop += SLICE
    return high


def _slice_words(data: np.ndarray, blank: np.ndarray, fold: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of one slice; no word crosses a cut."""
    solid = ~blank[data]
    n = len(data)
    joined = np.zeros(n + 1, bool)  # bytes i-1 and i belong to one word
    joined[1:n] = solid[1:] & solid[:-1]
    joined[cuts] = False
    starts = np.flatnonzero(solid & ~joined[:-1])
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64)
    ends = np.flatnonzero(solid & ~joined[1:]) + 1
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    terms = (fold[data[solid]].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[place]
    return starts, ends, mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray, fold: np.ndarray) -> Words:
    """All words of the texts ``data[offsets[i]:offsets[i+1]]``: runs of bytes that are not
    ``blank``, hashed after ``fold``."""
    low, high = int(offsets[0]), int(offsets[-1])
    starts, ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    while low < high:
        stop = _slice_end(data, blank, low, high)
        inner = offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, stop, "right")] - low
        s, e, h = _slice_words(data[low:stop], blank, fold, inner)
        starts.append(s + low)
        ends.append(e + low)
        hashes.append(h)
        low = stop
    start = np.concatenate(starts)
    counts = np.diff(np.searchsorted(start, offsets))
    return Words(start, np.concatenate(ends), np.concatenate(hashes), counts)


def run_hashes(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` neighbouring words, by their first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = int(mix(np.array([2 * seed + 1], np.uint64))[0]) | 1
    steps = np.full(len(hashes), base, np.uint64)
    steps[0] = 1
    powers = np.multiply.accumulate(steps)
    back = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum((mix(hashes + np.uint64(seed)) if seed else hashes) * powers, out=sums[1:])
    return mix((sums[size:] - sums[:n]) * back)

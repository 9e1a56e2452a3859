"""Word work shared by the operators: bounded numpy passes over whole UTF-8 texts.

A word is a run of bytes outside space and 0x09-0x0D; A-Z count as a-z. A null text has no
words. All hashes are 64-bit and the same in every process and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes hashed at a time; longer texts are cut at white space, so memory does not follow them.
PIECE = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def bounded_batches(spark: SparkSession, rows: int = 512) -> SparkSession:
    """Python workers get at most this many rows at a time (whole texts can be long), unless the
    session already asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    return spark


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets) of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: list[np.ndarray] = []


def _tables_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        _tables[:] = [_powers(_BASE, max(n, PIECE + 1)), _powers(_INVERSE, max(n, PIECE + 1))]
    return _tables[0], _tables[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _piece(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words in one run of bytes; no word crosses a break."""
    solid = ~_SPACE[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = solid
    after = np.empty(len(data) + 1, bool)
    after[:-1] = solid
    after[-1] = False
    before[breaks] = False
    after[breaks] = False
    starts = np.flatnonzero(solid & ~before[:-1])
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    ends = np.flatnonzero(solid & ~after[1:]) + 1
    powers, inverses = _tables_for(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64)), starts


def _cut(data: np.ndarray, start: int, end: int) -> int:
    """End of the piece that begins at ``start``: at most PIECE bytes, longer only for one word."""
    stop = start + PIECE
    if stop >= end:
        return end
    blanks = np.flatnonzero(_SPACE[data[start:stop]])
    if len(blanks):
        return start + int(blanks[-1]) + 1
    while stop < end:  # one word fills the piece: go on to where it ends
        blanks = np.flatnonzero(_SPACE[data[stop : stop + PIECE]])
        if len(blanks):
            return stop + int(blanks[0]) + 1
        stop += PIECE
    return end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Hashes of every text's words, a run of texts at a time.

    Yields (first text, words per text, hashes of all their words in order). Short texts share
    a run; a long one comes alone.
    """
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        j = min(j, n)
        low, high = int(offsets[i]), int(offsets[j])
        if j > i + 1 or high - low <= PIECE:
            hashes, starts = _piece(data[low:high], offsets[i + 1 : j] - low)
            yield i, np.diff(np.searchsorted(starts, offsets[i : j + 1] - low)), hashes
        else:
            found, at = [], low
            while at < high:
                stop = _cut(data, at, high)
                found.append(_piece(data[at:stop], np.zeros(0, np.int64))[0])
                at = stop
            hashes = np.concatenate(found)
            yield i, np.array([len(hashes)]), hashes
        i = j


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's runs of ``size`` words, how many per text), repeats included.

    A text with fewer words, but some, has its whole sequence as one shingle.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    per_text = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    weights = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    span = len(words) - size + 1
    if span > 0:
        runs = np.zeros(span, np.uint64)
        for k in range(size):
            runs += words[k : k + span] * weights[k]
    else:
        runs = np.zeros(0, np.uint64)
    out = np.empty(int(per_text.sum()), np.uint64)
    at = np.cumsum(per_text) - per_text
    long = counts >= size
    if long.any():
        lengths = per_text[long]
        shift = np.repeat(starts[long] - (np.cumsum(lengths) - lengths), lengths)
        place = np.repeat(at[long] - (np.cumsum(lengths) - lengths), lengths)
        steps = np.arange(int(lengths.sum()))
        out[place + steps] = mix(runs[shift + steps])
    for t in np.flatnonzero(~long & (counts > 0)):
        own = words[starts[t] : ends[t]]
        out[at[t]] = mix((own * weights[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
    return out, per_text


def distinct_per_text(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each text's distinct values in ascending order, how many per text)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        keep = np.empty(len(values), bool)
        keep[0] = True
        keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[keep], owner[keep]
    return values, np.bincount(owner, minlength=len(counts))

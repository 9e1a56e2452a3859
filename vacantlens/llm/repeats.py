"""Removal of passages that stand elsewhere too: a count-min prefilter, then exact grouping.

A window is ``size`` neighbouring words of one document. First every task sketches its windows,
the sketches are added up, and the sum overestimates how often each window occurs; then only
windows estimated to occur twice or more are grouped by their whole content. A window that does
occur twice is always estimated so, hence none is lost; one that doesn't is freed by the grouping.

* A window is sketched by its anchor, the smallest hash among its runs of ``ANCHOR`` words, the
  leftmost if several are equal. Equal windows have equal anchors at equal places, so an anchor
  occurs at least as often as its windows, and neighbouring windows share one: the sketch takes
  about one entry in twelve words.
* The sketch has two rows and grows with the corpus (``BYTES_PER_SLOT``). It is never whole in one
  place: a task sends its sparse share of each block, the block's task adds the shares up and
  answers each with one bit an entry. So nothing is broadcast, and a window that a third of all
  rows hold is one entry per task. Exact grouping goes the same way, with 128-bit hashes of
  windows in place of slots.
* Rows travel in packs, compressed Arrow batches of about ``PACK`` bytes of text, stored in the
  shared folder, so every later step is repeated from there if an executor is lost.

Defined cases: a null, empty or blank text has no words and becomes the empty text; a text of
fewer words than a window stays; rows that repeat a doc_id are separate documents, so copies of
``size`` words or more lose all their words; an empty table gives no rows; other columns are
kept; an input column named like one of the two counts is replaced by it. A document is held whole
by one task, with about 100 bytes of scratch per word.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantlens.llm import stream
from vacantlens.llm.text import bounded_batches, mix, utf8
from vacantlens.session import stored

#: Words of a window, words of an anchor, bytes of text per slot of a sketch row.
WINDOW, ANCHOR, BYTES_PER_SLOT = 35, 12, 8
#: Bytes of text per pack; slots and windows of a block, which bound what one task adds up.
PACK, BLOCK_SLOTS, BLOCK_WINDOWS = 4 << 20, 1 << 24, 2 << 20
BLANK = stream.byte_table(b" \t\n\x0b\x0c\r")

_PACKS = "bytes long, body binary"
_SHARES = "chunk long, block long, entries binary, more binary"
_ANSWERS = "chunk long, block long, bits binary"


# --- packs --------------------------------------------------------------------------------


def _packed(batches: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([sink.getvalue()], pa.binary())], names=["bytes", "body"])


def packs(docs: DataFrame, text: str) -> DataFrame:
    """(chunk, bytes, body): the rows of ``docs`` in stored packs."""
    place = docs.columns.index(text)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(lengths):
                room = np.cumsum(lengths[at:])
                take = max(1, int(np.searchsorted(room, PACK - size, "right"))) if not held else int(np.searchsorted(room, PACK - size, "right"))
                if take:
                    held.append(batch.slice(at, take))
                    size += int(room[take - 1])
                    at += take
                if at < len(lengths):
                    yield _packed(held, size)
                    held, size = [], 0
        if held:
            yield _packed(held, size)

    bounded_batches(docs.sparkSession)
    return stored(docs.mapInArrow(pack, _PACKS).withColumn("chunk", F.monotonically_increasing_id()), "packs")


def _rows(body: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(body.as_buffer()).read_all()


# --- windows of a pack ----------------------------------------------------------------------


class _Pack:
    """The words of a pack's texts, its windows and their anchors."""

    def __init__(self, rows: pa.Table, text: str | int, size: int) -> None:
        self.data, offsets = utf8(rows.column(text))
        self.words = stream.words_of(self.data, offsets, BLANK, stream.same_bytes())
        self.size = size
        n = len(self.words.hashes)
        left = np.repeat(np.cumsum(self.words.counts), self.words.counts) - np.arange(n)
        #: First words of all windows.
        self.windows = np.flatnonzero(left >= size)
        #: The anchor's place, by window.
        self.place = self._leftmost(stream.run_hashes(self.words.hashes, min(ANCHOR, size)))

    def _leftmost(self, runs: np.ndarray) -> np.ndarray:
        """Place of the leftmost smallest run in every window."""
        span = self.size - min(ANCHOR, self.size) + 1
        self.runs = runs
        least, place, width = runs, np.arange(len(runs)), 1
        while width < span and len(self.windows):
            step = min(width, span - width)
            later = least[step:] < least[:-step]
            least, place = np.where(later, least[step:], least[:-step]), np.where(later, place[step:], place[:-step])
            width += step
        return place[self.windows] if len(self.windows) else np.zeros(0, np.int64)

    def slots(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted slots of both sketch rows, whether the pack fills a slot twice or more, by window
        the two slots of its anchor)."""
        chosen = np.ones(len(self.place), bool)
        chosen[1:] = self.place[1:] != self.place[:-1]
        anchors = self.runs[self.place[chosen]]
        both = np.stack([self._slot(anchors, width, row) for row in (0, 1)])
        unique, times = np.unique(both, return_counts=True)
        return unique, times > 1, both[:, np.cumsum(chosen) - 1] if len(chosen) else both

    @staticmethod
    def _slot(anchors: np.ndarray, width: int, row: int) -> np.ndarray:
        return (mix(anchors + np.uint64(row)) & np.uint64(width - 1)) + np.uint64(row * width)

    def keys(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct 128-bit hashes of the windows ``asked``, whether the pack holds one twice
        or more, by window its hash's place)."""
        first = self.windows[asked]
        if not len(first):
            return np.zeros((2, 0), np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
        h1, h2 = (stream.run_hashes(self.words.hashes, self.size, seed)[first] for seed in (1, 2))
        order, group, fresh = _grouped(h1, h2)
        own = np.empty(len(first), np.int64)
        own[order] = group
        return np.stack([h1[order][fresh], h2[order][fresh]]), np.bincount(group) > 1, own

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        """By word: whether one of the windows ``repeated`` covers it."""
        n = len(self.words.hashes)
        edge = np.zeros(n + 1, np.int64)
        edge[self.windows[repeated]] += 1
        edge[self.windows[repeated] + self.size] -= 1
        return np.cumsum(edge[:n]) > 0


def _grouped(h1: np.ndarray, h2: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorting order, group number and whether a group begins, in that order) of equal keys."""
    order = np.argsort(h1, kind="stable") if h2 is None else np.lexsort((h2, h1))
    fresh = np.ones(len(order), bool)
    a = h1[order]
    fresh[1:] = a[1:] != a[:-1]
    if h2 is not None:
        b = h2[order]
        fresh[1:] |= b[1:] != b[:-1]
    return order, np.cumsum(fresh) - 1, fresh


# --- asking which entries occur twice -----------------------------------------------------------


def _shares(chunk: int, blocks: np.ndarray, entries: list[np.ndarray], more: np.ndarray) -> pa.Table:
    """One row per block of a pack's sorted entries; ``blocks`` never decreases."""
    cuts = np.flatnonzero(np.diff(blocks)) + 1
    lows = np.concatenate([[0], cuts]).astype(np.int64) if len(blocks) else np.zeros(0, np.int64)
    highs = np.concatenate([cuts, [len(blocks)]]).astype(np.int64) if len(blocks) else np.zeros(0, np.int64)
    return pa.table(
        {
            "chunk": pa.array(np.full(len(lows), chunk), pa.int64()),
            "block": pa.array(blocks[lows].astype(np.int64), pa.int64()),
            "entries": pa.array([b"".join(np.ascontiguousarray(e[a:b]).tobytes() for e in entries) for a, b in zip(lows, highs)], pa.binary()),
            "more": pa.array([np.packbits(more[a:b]).tobytes() for a, b in zip(lows, highs)], pa.binary()),
        }
    )


def _answer(shares: pa.Table, kind: type, lanes: int) -> pa.Table:
    """Adds up the shares of one block; bit by entry: whether it occurs twice or more."""
    own = [np.frombuffer(e.as_buffer(), kind).reshape(lanes, -1) for e in shares.column("entries")]
    sizes = [e.shape[1] for e in own]
    keys = np.concatenate(own, axis=1)
    more = np.concatenate([np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8), count=n) for m, n in zip(shares.column("more"), sizes)])
    order, group, _ = _grouped(keys[0], keys[1] if lanes > 1 else None)
    repeated = np.empty(len(order), bool)
    repeated[order] = (np.bincount(group, weights=1 + more[order]) >= 2)[group]
    parts = np.split(repeated, np.cumsum(sizes)[:-1])
    return pa.table({"chunk": shares.column("chunk"), "block": shares.column("block"), "bits": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})


def _answered(answers: pa.Table, blocks: np.ndarray) -> np.ndarray:
    """The bits of a pack's sorted entries, whose blocks are given."""
    order = np.argsort(answers.column("block").to_numpy())
    _, sizes = np.unique(blocks, return_counts=True)
    bits = [answers.column("bits")[int(i)].as_buffer() for i in order]
    found = [np.unpackbits(np.frombuffer(b, np.uint8), count=int(n)) for b, n in zip(bits, sizes)]
    return np.concatenate(found).astype(bool) if found else np.zeros(0, bool)


def _power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(n, 1)))))


# --- the operator ---------------------------------------------------------------------------------


def remove_repeats(docs: DataFrame, size: int = WINDOW, text: str = "text", words: str = "_words", removed: str = "_removed") -> DataFrame:
    """All columns of ``docs`` with every word gone that is covered by a window that also starts
    anywhere else, the rest of ``text`` joined by one space; and the columns ``words`` and
    ``removed``: how many there were and how many went."""
    docs = docs.drop(*[c for c in (words, removed) if c != text])
    packed = packs(docs, text)
    total = packed.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    width = max(_power_of_two(total / BYTES_PER_SLOT), 1 << 16)
    # Blocks of slots are powers of two, so a slot's low bits are its place in its block.
    low = max(int(np.log2(min(BLOCK_SLOTS, max(2 * width // 16, 256)))), 8)
    blocks = _power_of_two(max(16, total / 6 / BLOCK_WINDOWS))
    place = docs.columns.index(text)

    def slot_blocks(slots: np.ndarray) -> np.ndarray:
        return slots >> np.uint64(low)

    def key_blocks(keys: np.ndarray) -> np.ndarray:
        return keys[0] >> np.uint64(64 - int(np.log2(blocks)))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column(0), batch.column(1)):
                slots, more, _ = _Pack(_rows(body), place, size).slots(width)
                yield from _shares(chunk.as_py(), slot_blocks(slots), [(slots & np.uint64((1 << low) - 1)).astype(np.uint32)], more).to_batches()

    def estimated(pack: _Pack, answers: pa.Table) -> np.ndarray:
        """By window: whether both sketch rows count its anchor twice or more."""
        slots, _, by_window = pack.slots(width)
        bits = _answered(answers, slot_blocks(slots))
        return bits[np.searchsorted(slots, by_window[0])] & bits[np.searchsorted(slots, by_window[1])] if len(by_window[0]) else np.zeros(0, bool)

    def asked(left: pa.Table, right: pa.Table) -> pa.Table:
        pack = _Pack(_rows(left.column("body")[0]), place, size)
        keys, more, _ = pack.keys(estimated(pack, right))
        return _shares(left.column("chunk")[0].as_py(), key_blocks(keys), list(keys), more)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _rows(left.column("body")[0])
        pack = _Pack(rows, place, size)
        sketch, exact = (right.filter(pc.equal(right.column("exact"), flag)) for flag in (False, True))
        ask = estimated(pack, sketch)
        keys, _, own = pack.keys(ask)
        repeated = np.zeros(len(ask), bool)
        repeated[ask] = _answered(exact, key_blocks(keys))[own]
        gone = pack.covered(repeated)
        counts = pack.words.counts
        went = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(np.cumsum(counts) - counts, len(gone)))
        went[counts == 0] = 0
        out = {name: rows.column(i) for i, name in enumerate(out_schema[:-2])}
        out[out_schema[place]] = pa.array(_kept(pack, gone), pa.string())
        return pa.table([out[name] for name in out_schema[:-2]] + [pa.array(counts, pa.int64()), pa.array(went, pa.int64())], names=out_schema)

    out_schema = [*docs.columns, words, removed]
    schema = T.StructType([*docs.schema.fields, T.StructField(words, T.LongType()), T.StructField(removed, T.LongType())])
    shares = packed.select("chunk", "body").mapInArrow(sketched, _SHARES)
    first = stored(shares.groupBy("block").applyInArrow(lambda t: _answer(t, np.uint32, 1), _ANSWERS), "sketch")
    groups = packed.select("chunk", "body").groupBy("chunk")
    windows = groups.cogroup(first.groupBy("chunk")).applyInArrow(asked, _SHARES)
    second = windows.groupBy("block").applyInArrow(lambda t: _answer(t, np.uint64, 2), _ANSWERS)
    answers = first.withColumn("exact", F.lit(False)).unionByName(second.withColumn("exact", F.lit(True)))
    return groups.cogroup(answers.groupBy("chunk")).applyInArrow(cut, schema)


def _kept(pack: _Pack, gone: np.ndarray) -> list[str]:
    """Every text's kept words, joined by one space."""
    w, out, at = pack.words, [], 0
    data = memoryview(np.ascontiguousarray(pack.data))
    for count in w.counts:
        stay = np.flatnonzero(~gone[at : at + count]) + at
        # Neighbouring words one blank apart are taken together.
        if len(stay):
            cut = np.flatnonzero((np.diff(stay) > 1) | (w.starts[stay[1:]] - w.ends[stay[:-1]] != 1) | (pack.data[w.ends[stay[:-1]]] != 0x20)) + 1
            heads, tails = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(stay) - 1]])
            out.append(b" ".join(bytes(data[a:b]) for a, b in zip(w.starts[stay[heads]].tolist(), w.ends[stay[tails]].tolist())).decode())
        else:
            out.append("")
        at += count
    return out

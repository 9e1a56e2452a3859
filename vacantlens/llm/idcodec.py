"""Token ids as binary blocks: an adaptive context-mixing range coder.

A block holds up to ``BLOCK_IDS`` ids, is coded without anything from other blocks and ends in a
CRC-32, so any block can be read alone. Inside a block the ids stand in lanes, runs of equal
length that advance together: every step codes one id of each lane, all with the same model,
and then lets the model learn from all of them. So numpy works on whole lanes at a time, and
encoder and decoder see the same model.

The probability of an id is a mix of three predictions: the id that last followed the same two
ids, the one that last followed the previous id, and the frequencies of all ids of the block so
far. The weights are the hit rates of the two predictors at their present confidence, learnt as
the block goes on. The mixed interval drives a carry-less range coder of each lane.

Block layout, little-endian: magic "CMR1", ids u32, lanes u32, vocabulary u32, CRC-32 of the
ids u32, then each lane's number of 16-bit words u32, then the lanes' words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR1"
BLOCK_IDS, LANES = 1 << 21, 8192
#: Bits of the mixed total and of the order-0 total.
MIX_BITS, ZERO_BITS = 24, 20
MIX, ZERO = 1 << MIX_BITS, 1 << ZERO_BITS
CONTEXT_BITS, LEVEL_BITS = 20, 3
LEVELS = 1 << LEVEL_BITS

#: Next level of confidence by level, after a miss and after a hit.
_NEXT = np.array([k >> 1 for k in range(LEVELS)] + [min(k + 1, LEVELS - 1) for k in range(LEVELS)], np.int64)
#: Factor of the id before the previous one in the hash of both.
_FIRST = 0x9E3779B1

_U = np.uint64
_WIDTH = (1 << 32) - 1
_TOP, _BOTTOM = _U(1 << 48), _U(1 << 32)


class _Model:
    """Order-0 to order-2 predictions shared by the lanes of a block."""

    def __init__(self, vocabulary: int, lanes: int, decoding: bool = False) -> None:
        self.vocabulary, self.lanes, self.decoding = vocabulary, lanes, decoding
        self.counts = np.zeros(vocabulary, np.int64)
        self.fresh: list[np.ndarray] = []
        self.step, self.rebuild = 0, 1
        # Predicted id times LEVELS plus confidence, by the previous id and by the hash of the previous two.
        self.one = np.zeros(vocabulary + 1, np.int32)
        self.two = np.zeros(1 << CONTEXT_BITS, np.int32)
        states = LEVELS * LEVELS * 2
        # Hits of order 2, of order 1 alone, and trials, per state of both confidences.
        self.hits = np.tile(np.array([[0.5], [0.5], [4.0]]), (1, states))
        self.last = np.full(lanes, vocabulary, np.int64)
        self.before = self.last * _FIRST
        self._frequencies()
        self._weights()

    def _frequencies(self) -> None:
        if self.fresh:
            self.counts += np.bincount(np.concatenate(self.fresh), minlength=self.vocabulary)
            self.fresh = []
        total = int(self.counts.sum())
        spare = ZERO - self.vocabulary
        scaled = 1 + (self.counts * spare) // max(total, 1)
        scaled[int(scaled.argmax())] += ZERO - int(scaled.sum())
        # Where an id's interval begins, in the upper half, and its width.
        self.places = ((np.cumsum(scaled) - scaled) << 32) | scaled
        if self.decoding:
            self.inverse = np.repeat(np.arange(self.vocabulary, dtype=np.int32), scaled)

    def _weights(self) -> None:
        rate = self.hits[:2] / self.hits[2]
        # Never all of the mass: order 0 keeps an eighth of what the two have left, or 1/64.
        scale = np.minimum(1.0, (63 / 64) / rate.sum(axis=0))
        self.share = np.floor(rate * scale * (MIX / ZERO)).astype(np.int64) * ZERO
        # Odd states: both name the same id, which gets both shares.
        self.share[0, 1::2] += self.share[1, 1::2]
        self.share[1, 1::2] = 0
        self.rest = (MIX - self.share.sum(axis=0)) >> ZERO_BITS

    def predict(self) -> tuple[np.ndarray, ...]:
        """Per lane: the id that order 2 names, its share, that of order 1, its share, order-0 factor."""
        self.context = ((self.before + self.last * 0x85EBCA77) >> 5) & ((1 << CONTEXT_BITS) - 1)
        self.entry_two, self.entry_one = self.two.take(self.context).astype(np.int64), self.one.take(self.last).astype(np.int64)
        self.guess_two, self.guess_one = self.entry_two >> LEVEL_BITS, self.entry_one >> LEVEL_BITS
        self.sure_two, self.sure_one = self.entry_two & (LEVELS - 1), self.entry_one & (LEVELS - 1)
        self.state = (((self.sure_two << LEVEL_BITS) | self.sure_one) << 1) | (self.guess_two == self.guess_one)
        return self.guess_two, self.share[0].take(self.state), self.guess_one, self.share[1].take(self.state), self.rest.take(self.state)

    def learn(self, ids: np.ndarray) -> None:
        hit_two, hit_one = (ids == self.guess_two).astype(np.int64), (ids == self.guess_one).astype(np.int64)
        states = self.hits.shape[1]
        # Outcome 1: order 2 was right, 2: order 1 alone, 0: neither.
        outcomes = np.bincount(self.state * 3 + hit_two + 2 * (hit_one & ~hit_two), minlength=3 * states).reshape(states, 3)
        self.hits[0] += outcomes[:, 1]
        self.hits[1] += outcomes[:, 2]
        self.hits[2] += outcomes.sum(axis=1)
        for table, at, guess, sure, hit in (
            (self.two, self.context, self.entry_two, self.sure_two, hit_two),
            (self.one, self.last, self.entry_one, self.sure_one, hit_one),
        ):
            level = sure + (hit << LEVEL_BITS)
            # A wrong guess without confidence gives way.
            table[at] = np.where(level == 0, ids << LEVEL_BITS, guess - sure + _NEXT.take(level))
        self.before, self.last = self.last * _FIRST, ids
        self.fresh.append(ids.astype(np.int32))
        self.step += 1
        if self.step == self.rebuild:
            self.rebuild += max(1, self.rebuild // 2)
            self._frequencies()
        if self.step < 32 or self.step % 16 == 0:
            self._weights()


def _lanes(n: int, lanes: int) -> tuple[int, int]:
    """(lanes, steps) of n ids: few ids stand in few lanes."""
    lanes = max(1, min(lanes, -(-n // 64)))
    return lanes, -(-n // lanes)


def encode_block(ids: np.ndarray, vocabulary: int, lanes: int = LANES) -> bytes:
    """One block of at least one id, each below ``vocabulary``."""
    n = len(ids)
    lanes, steps = _lanes(n, lanes)
    grid = np.zeros(lanes * steps, np.uint32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    # Lanes in 16 bits are ordered by radix.
    lane = np.uint16 if lanes <= 1 << 16 else np.int64
    model = _Model(vocabulary, lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    owners, words = [], []
    everyone = np.arange(lanes)

    def emit(of: np.ndarray, bottom: np.ndarray) -> None:
        owners.append(of.astype(lane))
        words.append((bottom >> _U(48)).astype(np.uint16))

    for symbols in map(np.int64, grid):
        a, wa, b, wb, zero = model.predict()
        part = span >> _U(MIX_BITS)
        start, size = _interval(model, symbols, a, wa, b, wb, zero)
        low += part * start
        span = part * size
        _renormalise(low, span, emit)
        model.learn(symbols)
    for _ in range(4):
        emit(everyone, low)
        low <<= _U(16)
    owner, word = np.concatenate(owners), np.concatenate(words)
    order = np.argsort(owner, kind="stable")
    head = struct.pack("<4sIIII", MAGIC, n, lanes, vocabulary, zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()))
    return head + np.bincount(owner, minlength=lanes).astype("<u4").tobytes() + word[order].astype("<u2").tobytes()


def _interval(model: _Model, ids: np.ndarray, a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray, zero: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and width of the mixed intervals of ``ids``, of ``MIX`` in all."""
    place = model.places.take(ids)
    start = (place >> 32) * zero + wa * (a < ids) + wb * (b < ids)
    size = (place & _WIDTH) * zero + wa * (a == ids) + wb * (b == ids)
    return start.view(np.uint64), size.view(np.uint64)


def _renormalise(low: np.ndarray, span: np.ndarray, shift) -> None:
    """Shift 16 settled bits at a time until every lane's span is wide enough. A span that
    straddles a boundary is cut back to it, so no carry is ever needed. Only lanes that were
    shifted are looked at again."""
    due = np.flatnonzero(((low ^ (low + span)) < _TOP) | (span < _BOTTOM))
    while len(due):
        bottom, width = low[due], span[due]
        loose = (bottom ^ (bottom + width)) >= _TOP
        if loose.any():
            width = np.where(loose, (~bottom + _U(1)) & (_BOTTOM - _U(1)), width)
        shift(due, bottom)
        low[due] = bottom = bottom << _U(16)
        span[due] = width = width << _U(16)
        due = due[((bottom ^ (bottom + width)) < _TOP) | (width < _BOTTOM)]


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; ValueError if it is no block or its checksum fails."""
    if len(block) < 20 or block[:4] != MAGIC:
        raise ValueError("not a block")
    _, n, lanes, vocabulary, crc = struct.unpack_from("<4sIIII", block)
    lengths = np.frombuffer(block, "<u4", lanes, 20).astype(np.int64)
    words = np.frombuffer(block, "<u2", -1, 20 + 4 * lanes)
    if int(lengths.sum()) != len(words) or not n:
        raise ValueError("block cut off")
    words = np.concatenate([words, np.zeros(4, words.dtype)])
    place, final = np.cumsum(lengths) - lengths, len(words) - 1
    steps = -(-n // lanes)
    model = _Model(vocabulary, lanes, decoding=True)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = (code << _U(16)) | words[place].astype(np.uint64)
        place += 1
    out = np.empty((steps, lanes), np.int32)

    def take(of: np.ndarray, bottom: np.ndarray) -> None:
        at = place[of]
        code[of] = (code[of] << _U(16)) | words[np.minimum(at, final)].astype(np.uint64)
        place[of] = at + 1

    for step in range(steps):
        two, w2, one, w1, zero = model.predict()
        swap = one < two
        a, b = np.where(swap, one, two), np.where(swap, two, one)
        wa, wb = np.where(swap, w1, w2), np.where(swap, w2, w1)
        part = span >> _U(MIX_BITS)
        target = np.minimum((code - low) // part, _U(MIX - 1)).view(np.int64)
        # Where the intervals of the two candidates begin and end.
        a_place, b_place = model.places.take(a), model.places.take(b)
        a_start, b_start = (a_place >> 32) * zero, (b_place >> 32) * zero + wa * (a < b)
        a_end = a_start + (a_place & _WIDTH) * zero + wa
        b_end = b_start + (b_place & _WIDTH) * zero + wb + wa * (a == b)
        plain = target - wa * (target >= a_end) - wb * (target >= b_end)
        # Inside a candidate's interval the quotient means nothing; that lane is set below.
        # Both are below 2^25, so the quotient of floats has the right whole part.
        place_in = np.minimum(np.maximum(plain, 0) / zero, ZERO - 1).astype(np.int64)
        ids = model.inverse.take(place_in).astype(np.int64)
        ids = np.where((target >= b_start) & (target < b_end), b, ids)
        ids = np.where((target >= a_start) & (target < a_end), a, ids)
        start, size = _interval(model, ids, a, wa, b, wb, zero)
        low += part * start
        span = part * size
        _renormalise(low, span, take)
        model.learn(ids)
        out[step] = ids
    ids = np.ascontiguousarray(out.T).reshape(-1)[:n].astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("block checksum differs")
    return ids

"""Similarity of one key against a block of catalog entries; runs inside Spark tasks.

Token-set similarity compares the distinct words of two texts: shared words count fully,
the remaining words of both sides are compared letter by letter (insertions and deletions
only). Its letter part is the one score Spark has no expression for. Most pairs never need
it: word and letter counts bound the score, and a pair is scored exactly only while its
bound can still enter the best k.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

# Characters 128-255 are dropped before comparing, as the published scorer does.
_DROPPED = {code: None for code in range(128, 256)}
_NOT_WORD = re.compile(r"(?ui)\W")
#: Sets of shared words whose rest of a key is kept: bounds the memory of long keys.
RESTS = 64


def comparable(text: str | None) -> str:
    """Accented Latin-1 letters dropped, punctuation as blanks, lower case."""
    return _NOT_WORD.sub(" ", (text or "").strip().lower().translate(_DROPPED)).strip().lower()


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; one big-integer step per character of ``b``."""
    places: dict[str, int] = {}
    for i, char in enumerate(a):
        places[char] = places.get(char, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for char in b:
        hit = state & places.get(char, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def token_set_score(a: str, b: str) -> int:
    """Similarity 0-100 of two comparable texts, rounded half to even."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0
    shared = left & right
    if shared and (left <= right or right <= left):
        return 100
    s = len(" ".join(shared))
    da, db = " ".join(sorted(left - shared)), " ".join(sorted(right - shared))
    gap = 1 if shared else 0
    la, lb = s + gap + len(da), s + gap + len(db)
    best = 100 - 100 * (len(da) + len(db) - 2 * common_length(da, db)) / (la + lb)
    if shared:
        best = max(best, 100 - 100 * (gap + len(da)) / (s + la), 100 - 100 * (gap + len(db)) / (s + lb))
    return round(best)


class KeyScorer:
    """``token_set_score`` of one key against many entries: the key is taken apart once, and the places of
    its letters are kept for every set of words it shares with an entry."""

    def __init__(self, key: str) -> None:
        self.words = set(key.split())
        self.rests: dict[frozenset[str], tuple[int, int, dict[str, int]]] = {}

    def _rest(self, shared: frozenset[str]) -> tuple[int, int, dict[str, int]]:
        """(letters of the shared words, letters of the rest, bits of the rest's places by letter)."""
        found = self.rests.get(shared)
        if found is None:
            rest = " ".join(sorted(self.words - shared))
            bits: dict[str, int] = {}
            bit = 1
            for char in rest:
                bits[char] = bits.get(char, 0) | bit
                bit <<= 1
            if len(self.rests) >= RESTS:
                self.rests.clear()
            found = self.rests[shared] = len(" ".join(shared)), len(rest), bits
        return found

    def score(self, words: set[str]) -> int:
        """Score of the entry of these words."""
        if not self.words or not words:
            return 0
        shared = frozenset(self.words & words)
        if shared and (len(shared) == len(self.words) or len(shared) == len(words)):
            return 100
        s, da, bits = self._rest(shared)
        db = " ".join(sorted(words - shared))
        gap = 1 if shared else 0
        full = (1 << da) - 1
        state = full
        for char in db:  # as in common_length
            hit = state & bits.get(char, 0)
            if hit:
                state = ((state + hit) | (state - hit)) & full
        common = da - state.bit_count()
        la, lb = s + gap + da, s + gap + len(db)
        best = 100 - 100 * (da + len(db) - 2 * common) / (la + lb)
        if shared:
            best = max(best, 100 - 100 * (gap + da) / (s + la), 100 - 100 * (gap + len(db)) / (s + lb))
        return round(best)


@dataclass
class Catalog:
    """A block of catalog entries in catalog order, prepared for scoring."""

    texts: list[str]
    vectors: np.ndarray | None = None
    words: list[set[str]] = field(init=False)

    def __post_init__(self) -> None:
        self.words = [set(t.split()) for t in self.texts]
        self.word_count = np.array([len(w) for w in self.words], dtype=np.int64)
        self.letters = np.array([sum(map(len, w)) for w in self.words], dtype=np.int64)
        self.holders: dict[str, list[int]] = {}
        alphabet: dict[str, int] = {}
        for i, words in enumerate(self.words):
            for word in words:
                self.holders.setdefault(word, []).append(i)
                for char in word:
                    alphabet.setdefault(char, len(alphabet))
        self.alphabet = alphabet
        self.bags = np.zeros((len(self.texts), len(alphabet)), dtype=np.int32)
        for i, words in enumerate(self.words):
            for word in words:
                for char in word:
                    self.bags[i, alphabet[char]] += 1

    def bounds(self, key: str) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound (0-100, not rounded) of the token-set score of each entry."""
        size = len(self.texts)
        words = set(key.split())
        if not words:
            return np.zeros(size), np.zeros(size)
        shared = np.zeros(size, dtype=np.int64)
        shared_letters = np.zeros(size, dtype=np.int64)
        bag = np.zeros(len(self.alphabet), dtype=np.int32)
        for word in words:
            holders = self.holders.get(word)
            if holders:
                shared[holders] += 1
                shared_letters[holders] += len(word)
        for char, times in Counter("".join(words)).items():
            slot = self.alphabet.get(char)
            if slot is not None:
                bag[slot] = times
        rest_a, rest_b = len(words) - shared, self.word_count - shared
        a = sum(map(len, words)) - shared_letters + np.maximum(rest_a - 1, 0)
        b = self.letters - shared_letters + np.maximum(rest_b - 1, 0)
        s = shared_letters + np.maximum(shared - 1, 0)
        gap = (shared > 0).astype(np.int64)
        la, lb = s + gap + a, s + gap + b
        alike = np.minimum(self.bags, bag).sum(axis=1) - shared_letters
        blanks = np.minimum(np.maximum(rest_a - 1, 0), np.maximum(rest_b - 1, 0))
        common = np.minimum(np.minimum(a, b), alike + blanks)
        with np.errstate(divide="ignore", invalid="ignore"):
            letters = 1 - (a + b - 2 * common) / (la + lb)
            side = np.maximum(1 - (gap + a) / (s + la), 1 - (gap + b) / (s + lb))
        low = np.where(shared > 0, side, 0.0)
        high = np.maximum(low, letters)
        inside = (shared > 0) & ((rest_a == 0) | (rest_b == 0))
        low, high = np.where(inside, 1.0, low), np.where(inside, 1.0, high)
        empty = self.word_count == 0
        return 100 * np.where(empty, 0.0, low), 100 * np.where(empty, 0.0, high)

    def cosines(self, vectors: np.ndarray) -> np.ndarray:
        """Cosine times 100, cut to whole numbers, of each key vector with each entry.

        Noise beyond nine decimals is removed first, so that equal directions give 100.
        """
        unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
        return np.trunc(100 * np.round(unit @ self.vectors.T, 9)).astype(np.int64)

    def top(self, key: str | None, semantic: np.ndarray | None, k: int, threshold: int) -> list[tuple[int, int, int]]:
        """(entry, semantic, fuzzy) of the best ``k`` entries by the larger score; ties go to
        the earlier entry. ``key`` None leaves the fuzzy score out, ``semantic`` None the other.
        With both, a score below the threshold counts as missing, that is 0."""
        size = len(self.texts)
        if key is None:
            order = np.lexsort((np.arange(size), -semantic))[:k]
            return [(int(i), int(semantic[i]), 0) for i in order if semantic[i] >= threshold]
        base = np.zeros(size, dtype=np.int64) if semantic is None else np.where(semantic >= threshold, semantic, 0)
        low, high = self.bounds(key)
        low = np.maximum(base, np.floor(low))
        high = np.maximum(base, np.ceil(high))
        exact: dict[int, int] = {}
        best: list[int] = []
        scorer = KeyScorer(key)
        floor = np.partition(low, size - k)[size - k] if size > k else -np.inf
        for i in np.argsort(-high, kind="stable"):
            if high[i] < floor:
                break
            score = scorer.score(self.words[i])
            exact[int(i)] = score if score >= threshold else 0
            best.append(max(int(base[i]), exact[int(i)]))
            if len(best) > k:
                best = sorted(best, reverse=True)[:k]
            if len(best) == k:
                floor = max(floor, min(best))
        order = sorted(exact, key=lambda i: (-max(int(base[i]), exact[i]), i))[:k]
        return [(i, int(base[i]), exact[i]) for i in order if max(int(base[i]), exact[i]) >= threshold]


def prepare_catalog(texts: list[str | None], vectors: list | None, width: int) -> Catalog:
    """Catalog block with unit vectors; an entry without a vector gets zeros."""
    matrix = None
    if vectors is not None:
        matrix = as_matrix(vectors, width)
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    return Catalog([comparable(t) for t in texts], matrix)


def as_matrix(vectors: list, width: int) -> np.ndarray:
    """Rows of vectors; a missing vector is zeros, and so is every row when ``width`` is 0."""
    out = np.zeros((len(vectors), width))
    for i, vector in enumerate(vectors):
        if vector is not None and width:
            out[i] = vector
    return out

"""Benchmark decontamination by latent semantic retrieval.

1. Passages of ``WINDOW`` words cover every document. Every word weighs its own inverse document
   frequency, never nothing (one pass counts the documents of every word; the weights of the
   benchmark's words and of words in more than 1 / ``RARE`` of the documents are kept, all others
   weigh as the rarest of these). Only then are words hashed to the ``TERMS`` columns of the space.
2. A randomised SVD finds the latent space: every task multiplies its passages A by a seeded
   random matrix and back, A'(A R); the sums over all tasks and one small factorisation give the
   leading right singular vectors (single-pass Nystroem form).
3. Two ways lead to candidates. Every run of ``LEAST_WORDS`` words of an item (all of a shorter
   item) is looked up among the runs of every document, so verbatim leaks do not depend on the
   latent space. Passages, now every ``STRIDE`` words, and benchmark items are projected; a passage is a
   candidate for the items whose cosine reaches ``COSINE`` and that share half of its words. The
   benchmark is a stated query set against all passages.
4. A candidate stays if the longest common subsequence of words of the item and of the passage
   (or of the place of the run) with its surroundings covers ``COVER`` of the item, which also finds paraphrases that keep
   word order, and if the item's answer (its last ``ANSWER`` words) is found there as well, or
   the cover is ``SURE`` without it.

Defined cases: null or wordless texts and items match nothing; rows without doc_id are left out
of the pairs, but go from the documents if they hold an item; rows that repeat a doc_id or item_id give one pair; items of fewer than
``LEAST_WORDS`` words match only as a whole run of words; an empty benchmark or corpus gives no
rows; further columns are ignored. A pair that only its run shows has the cosine of the passage
around the run, which may lie below ``COSINE``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantlens.llm.sums import PARTIAL, add_up, partial
from vacantlens.llm.text import bounded_batches, mix, utf8, word_hashes
from vacantlens.session import ship

STRIDE = 8
WINDOW = 2 * STRIDE
TERM_BITS = 14
TERMS = 1 << TERM_BITS
#: Dimensions of the latent space, further random directions of the range finder.
RANK, OVERSAMPLE = 48, 8
#: Words in more than 1 / RARE of the documents have weights of their own, at most RARE times the
#: distinct words of an average document.
RARE = 2000
#: Bits of a word's hash that tell words apart, and that find its slot in the table of weights.
WORD_BITS, SLOT_BITS = 48, 20
#: Numbers below 2 ** DIRECT_BITS are their own slots.
DIRECT_BITS = 22
#: Distinct words a task holds before it sends their counts on; pairs of runs looked at at a time.
HELD, PAIRS = 1 << 21, 1 << 20
COSINE, COVER, SURE, ANSWER, LEAST_WORDS = 0.6, 0.6, 0.75, 3, 6
#: Share of a candidate passage's words that must be words of the item before they are aligned.
SHARED = 0.5
#: Benchmark items of a pass over the documents: a pass broadcasts its items. Cells of a task's cosines.
ITEMS_AT_ONCE, CELLS = 50_000, 1 << 24


def _terms(words: np.ndarray) -> np.ndarray:
    return (mix(words) >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def _strides(counts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of every stride of ``step`` words of a run of texts."""
    starts = np.cumsum(counts) - counts
    per_text = -(-counts // step)
    text = np.repeat(np.arange(len(counts)), per_text)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    return starts[text] + number * step, text


def _sums(rows: np.ndarray, which: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The weighted rows added up by stretch; each begins at ``first`` and ends at the next. Stretches of up to a power of two
    are padded to it and go together."""
    out = np.empty((len(first), rows.shape[1]), np.float32)
    end = np.append(first[1:], len(which))
    power = np.ceil(np.log2(end - first)).astype(np.int64)
    for size in np.flatnonzero(np.bincount(power)):
        own = np.flatnonzero(power == size)
        place = first[own, None] + np.arange(1 << size)
        inside = place < end[own, None]
        place = np.minimum(place, len(which) - 1)
        out[own] = np.matmul((weight[place] * inside)[:, None, :], rows[which[place]])[:, 0]
    return out


def _keys(words: np.ndarray) -> np.ndarray:
    return words >> np.uint64(64 - WORD_BITS)


class Weights:
    """Weights of words by hash, and one for all other words. A slot holds its most frequent
    word; the few words that share a slot are found by bisection."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, least: int, total: int) -> None:
        def idf(n: np.ndarray) -> np.ndarray:
            return (np.log((1 + total) / (1 + n)) + 0.1).astype(np.float32)

        order = np.argsort(counts, kind="stable")
        keys, weight = keys[order], idf(counts[order])
        slot = self._slot(keys)
        self.other = idf(np.array([least]))[0]
        self.key, self.weight = np.full(1 << SLOT_BITS, np.iinfo(np.uint64).max), np.zeros(1 << SLOT_BITS, np.float32)
        self.key[slot], self.weight[slot] = keys, weight
        self.crowded = np.bincount(slot, minlength=1 << SLOT_BITS) > 1
        rest = np.flatnonzero(self.crowded[slot])
        rest = rest[np.argsort(keys[rest])]
        self.rest, self.rest_weight = keys[rest], weight[rest]

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(WORD_BITS - SLOT_BITS)).astype(np.int64)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        keys = _keys(words)
        slot = self._slot(keys)
        hit = self.key[slot] == keys
        out = np.where(hit, self.weight[slot], self.other)
        if len(self.rest):
            others = np.flatnonzero(~hit & self.crowded[slot])
            at = np.minimum(np.searchsorted(self.rest, keys[others]), len(self.rest) - 1)
            same = self.rest[at] == keys[others]
            out[others[same]] = self.rest_weight[at[same]]
        return out


def _owners(at: np.ndarray, n: int) -> np.ndarray:
    """The stride of each of ``n`` words."""
    return np.repeat(np.arange(len(at)), np.diff(np.append(at, n)))


def _passages(strides: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every passage is a stride and the next one of its text; a text's last stride is a passage
    of its own only if the text has no other. Returns (rows, their first stride)."""
    follows = np.zeros(len(text), bool)
    follows[:-1] = text[1:] == text[:-1]
    single = np.ones(len(text), bool)
    single[1:] &= text[1:] != text[:-1]
    single &= ~follows
    out = strides.copy()
    out[:-1][follows[:-1]] += strides[1:][follows[:-1]]
    first = np.flatnonzero(follows | single)
    return out[first], first


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, their counts added up)."""
    every, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, count = every[order], count[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.add.reduceat(count, first) if len(first) else count


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def word_weights(docs: DataFrame, known: np.ndarray) -> Weights:
    """The weights of words by the documents of ``docs`` (text) that hold them, exact for the
    hashes ``known`` and for every word in more than 1 / RARE of the documents."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, total = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[0].astype(np.int64)), pa.array(counts[0])], names=["word", "n"])

        for batch in batches:
            for _, sizes, words in word_hashes(*utf8(batch.column(0))):
                total += int((sizes > 0).sum())
                ends = np.cumsum(sizes)
                # Text and word in one number: at most 65,536 texts at a time.
                for low in range(0, len(sizes), 1 << (64 - WORD_BITS)):
                    own = sizes[low : low + (1 << (64 - WORD_BITS))]
                    here = words[ends[low] - sizes[low] : ends[low + len(own) - 1]]
                    owner = np.repeat(np.arange(len(own), dtype=np.uint64), own)
                    pairs = _distinct(owner << np.uint64(WORD_BITS) | _keys(here))
                    found, n = np.unique(pairs & np.uint64((1 << WORD_BITS) - 1), return_counts=True)
                    keys.append(found)
                    counts.append(n)
                    held += len(found)
            if held > HELD:
                one, n = _merged(keys, counts)
                keys, counts, held = [one], [n], 0
                if len(one) > HELD // 2:
                    yield sent()
                    keys, counts = [one[:0]], [n[:0]]
        one, n = _merged(keys, counts)
        keys, counts = [np.append(one, np.iinfo(np.uint64).max)], [np.append(n, total)]
        yield sent()

    least = max(1, docs.count() // RARE)
    wanted = pa.table({"word": np.unique(_keys(known)).astype(np.int64)})
    wanted = spark.createDataFrame(wanted).select("word", F.lit(0).cast("long").alias("n"), F.lit(True).alias("kept"))
    counted = docs.select("text").mapInArrow(run, "word long, n long").withColumn("kept", F.col("word") == -1)
    summed = counted.unionByName(wanted).groupBy("word").agg(F.sum("n").alias("n"), F.max("kept").alias("kept"))
    rows = summed.where((F.col("n") > least) | F.col("kept")).select("word", "n").toArrow()
    word, n = rows.column("word").to_numpy(), rows.column("n").to_numpy()
    real = word >= 0
    return Weights(word[real].astype(np.uint64), n[real], least, int(n[~real].sum()))


def _range(docs: DataFrame, weights: Weights, directions: np.ndarray) -> np.ndarray:
    """A'(A R) over all texts, cut into passages that follow one another."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((directions.astype(np.float32), weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weighed = shipped.value
        total = np.zeros(rows.shape, np.float32)
        for batch in batches:
            for _, sizes, words in word_hashes(*utf8(batch.column(0))):
                if not len(words):
                    continue
                at, _ = _strides(sizes, WINDOW)
                terms, weight, stride = _terms(words), weighed(words), _owners(at, len(words))
                passages = _sums(rows, terms, weight, at)
                # Back: every word of a passage adds the passage's row to its term.
                order = np.argsort(terms.astype(np.uint16), kind="stable")
                own = terms[order]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                total[own[first]] += _sums(passages, stride[order], weight[order], first)
        yield from partial(total)

    return add_up(docs.select("text").mapInArrow(run, PARTIAL), directions.shape)


@dataclass
class LatentSpace:
    """``projection`` maps terms to the latent space, every direction divided by its singular
    value, so that the few leading directions do not decide every cosine; ``values`` holds the
    singular values, ``weights`` those of the words."""

    projection: np.ndarray
    values: np.ndarray
    weights: Weights


def latent_space(docs: DataFrame, known: np.ndarray, rank: int = RANK, seed: int = 42) -> LatentSpace:
    """Randomised SVD of the TF-IDF passages of ``docs`` (text); ``known``: hashes of the
    benchmark's words."""
    weights = word_weights(docs, known)
    directions = np.random.default_rng(seed).standard_normal((TERMS, rank + OVERSAMPLE))
    image = _range(docs, weights, directions)
    # G ~ Y (R'Y)^-1 Y' for G = A'A: with R'Y = L L', G ~ B B', B = Y L^-T.
    small = directions.T @ image
    small = (small + small.T) / 2
    value, vector = np.linalg.eigh(small)
    keep = value > max(float(value.max(initial=0)), 0) * 1e-9
    if not keep.any():
        return LatentSpace(np.zeros((TERMS, rank), np.float32), np.zeros(rank), weights)
    root = image @ (vector[:, keep] / np.sqrt(value[keep]))
    left, singular, _ = np.linalg.svd(root, full_matrices=False)
    basis = np.zeros((TERMS, rank))
    found = min(rank, left.shape[1])
    basis[:, :found] = left[:, :found] / np.maximum(singular[:found], 1e-12)
    return LatentSpace(basis.astype(np.float32), singular[:rank], weights)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    masks: dict[int, int] = {}
    for place, word in enumerate(item.tolist()):
        masks[word] = masks.get(word, 0) | 1 << place
    full = (1 << len(item)) - 1
    row = full
    for word in text.tolist():
        mask = masks.get(word)
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


class Places:
    """The place of numbers among distinct rising ``keys``, -1 for others. A slot holds one key; the few
    keys that share a slot are found by bisection. Numbers ``below`` a few millions have a slot each."""

    def __init__(self, keys: np.ndarray, below: int = 1 << 64) -> None:
        self.keys, self.direct = keys.astype(np.uint64), below <= 1 << DIRECT_BITS
        self.shift = np.uint64(64 - max(8, (8 * len(keys)).bit_length()))
        slot, slots = self._slot(self.keys), below if self.direct else 1 << (64 - int(self.shift))
        self.held = np.full(slots, -1, np.int32)
        self.held[slot] = np.arange(len(keys))
        self.crowded = np.bincount(slot, minlength=slots) > 1
        self.rest = np.flatnonzero(self.crowded[slot])
        self.rest_keys = self.keys[self.rest]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        if self.direct:
            return keys.view(np.int64)
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        slot = self._slot(wanted)
        at = self.held[slot]
        if self.direct:
            return at
        out = np.where((at >= 0) & (self.keys[at] == wanted), at, -1)
        if len(self.rest):
            others = np.flatnonzero((out < 0) & self.crowded[slot])
            near = np.minimum(np.searchsorted(self.rest_keys, wanted[others]), len(self.rest) - 1)
            out[others] = np.where(self.rest_keys[near] == wanted[others], self.rest[near], -1)
        return out


class ItemWords:
    """The words of every item: their numbers, and how often each stands in its item."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        every = np.concatenate([words for _, words in items])
        kinds = np.unique(every)
        self.known, self.kinds = Places(kinds), np.uint64(len(kinds))
        owner = np.repeat(np.arange(len(items), dtype=np.uint64), [len(words) for _, words in items])
        keys, self.counts = np.unique(self._keys(np.searchsorted(kinds, every).astype(np.uint64), owner), return_counts=True)
        self.first = np.searchsorted(keys, self._keys(np.uint64(0), np.arange(len(items) + 1)))
        self.entry = Places(keys, len(items) * (len(kinds) + 1))

    def number(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words; ``kinds`` is that of a word no item has."""
        at = self.known(words)
        return np.where(at < 0, self.kinds, at.astype(np.uint64))

    def _keys(self, numbers: np.ndarray, item: np.ndarray) -> np.ndarray:
        return item.astype(np.uint64) * (self.kinds + np.uint64(1)) + numbers

    def shared(self, numbers: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray) -> np.ndarray:
        """For every candidate, how many words of its passage are words of its item; ``numbers``: of the texts' words."""
        count = np.zeros(len(begin), np.int64)
        for place in (begin + k for k in range(WINDOW)):
            count += (self.entry(self._keys(numbers[np.minimum(place, len(numbers) - 1)], item)) >= 0) & (place < end)
        return count

    def bound(self, numbers: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray) -> np.ndarray:
        """For every candidate, how many words of its item the words ``low`` to ``high`` hold, each at most as often
        as it stands in both: no common subsequence is longer."""
        size, out = high - low, np.zeros(len(item), np.int64)
        upto, a = np.cumsum(size), 0
        while a < len(item):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] - size[a] + PAIRS, "right")))
            own, sizes = item[a:b], size[a:b]
            which = np.repeat(np.arange(b - a), sizes)
            number = numbers[np.arange(len(which)) + np.repeat(low[a:b] - (np.cumsum(sizes) - sizes), sizes)]
            known = np.flatnonzero(number < self.kinds)
            which, entry = which[known], self.entry(self._keys(number[known], own[which[known]]))
            which, entry = which[entry >= 0], entry[entry >= 0]
            # A cell per candidate and distinct word of its item.
            cells = self.first[own + 1] - self.first[own]
            base = np.cumsum(cells) - cells
            found = np.bincount(entry + (base - self.first[own])[which], minlength=int(cells.sum()))
            most = self.counts[np.arange(len(found)) + np.repeat(self.first[own] - base, cells)]
            out[a:b] = np.add.reduceat(np.minimum(found, most), base)
            a = b
        return out


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` words."""
    span = max(0, len(words) - size + 1)
    out = np.zeros(span, np.uint64)
    for k in range(size if span else 0):
        out += words[k : k + span] * (mix(np.array([k + 1], np.uint64))[0] | np.uint64(1))
    return mix(out)


class ItemRuns:
    """The runs of every item's words, by size of run: (hash, item, place in the item), and
    whether any hash begins with the same bits."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, (_, words) in enumerate(items):
            size = min(len(words), LEAST_WORDS)
            found.setdefault(size, []).append((_runs(words, size), k))
        self.by_size = {}
        for size, own in found.items():
            hashes = np.concatenate([h for h, _ in own])
            item = np.concatenate([np.full(len(h), k) for h, k in own])
            place = np.concatenate([np.arange(len(h)) for h, _ in own])
            order = np.argsort(hashes, kind="stable")
            begins = np.zeros(1 << SLOT_BITS, bool)
            begins[hashes >> np.uint64(64 - SLOT_BITS)] = True
            self.by_size[size] = hashes[order], item[order], place[order], begins

    def among(self, words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, where the item would begin, first common run) of each run shared with a text;
        runs that place an item alike come once in a slice."""
        for size, (hashes, item, offset, begins) in self.by_size.items():
            own = _runs(words, size)
            place = np.flatnonzero(begins[own >> np.uint64(64 - SLOT_BITS)])
            text = np.searchsorted(ends, place, "right")
            place = place[place + size <= ends[text]]
            low = np.searchsorted(hashes, own[place])
            count = np.searchsorted(hashes, own[place], "right") - low
            place, low, count = place[count > 0], low[count > 0], count[count > 0]
            upto = np.cumsum(count)
            for start in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
                pair = np.arange(start, min(start + PAIRS, int(upto[-1])))
                run = np.searchsorted(upto, pair, "right")
                at = low[run] + pair - (upto[run] - count[run])
                begin = place[run] - offset[at]
                order = np.lexsort((place[run], begin, item[at]))
                one = np.append(True, (np.diff(item[at][order]) != 0) | (np.diff(begin[order]) != 0))
                order = order[one]
                yield item[at][order], begin[order], place[run][order]


def _shown(item: np.ndarray, text: np.ndarray) -> tuple[float, bool]:
    """(share of the item that is a common subsequence, whether its answer is in the text)."""
    cover = common_subsequence(item, text) / len(item)
    answer = item[-ANSWER:]
    return cover, bool(np.isin(answer, text).all())


def _items(benchmark: DataFrame) -> list[tuple[int, np.ndarray]]:
    table = benchmark.toArrow()  # ITEMS_AT_ONCE rows or so
    out = []
    texts = table.column("text").combine_chunks()
    for first, counts, words in word_hashes(*utf8(texts)):
        ends = np.cumsum(counts)
        for i, (count, end) in enumerate(zip(counts, ends)):
            if count:
                out.append((table.column("item_id")[first + i].as_py(), words[end - count : end].copy()))
    return sorted(out, key=lambda x: (x[0], len(x[1])))


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, cover: float = COVER) -> DataFrame:
    """(doc_id, item_id, cosine, cover): pairs of documents and benchmark items they hold, one
    row per pair, with the best passage's figures."""
    texts = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    return _pairs(texts, benchmark, cosine, cover).where("doc_id IS NOT NULL")


def _pairs(texts: DataFrame, benchmark: DataFrame, cosine: float = COSINE, cover: float = COVER, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """The pairs of ``texts`` (text, doc_id of any type), in as many passes as the items need."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["item_id", "text"])
    passes = max(1, -(-rows.count() // at_once))
    part = F.pmod(F.xxhash64("item_id"), F.lit(passes))
    texts = texts.select("text", "doc_id")
    return reduce(DataFrame.unionByName, [_pass(texts, rows.where(part == i), cosine, cover) for i in range(passes)])


def _pass(texts: DataFrame, benchmark: DataFrame, cosine: float, cover: float) -> DataFrame:
    spark = bounded_batches(ship(texts.sparkSession))
    kind = texts.schema["doc_id"].dataType.simpleString()
    items = _items(benchmark)
    if not items:
        return spark.createDataFrame([], f"doc_id {kind}, item_id long, cosine double, cover double")
    space = latent_space(texts, np.concatenate([words for _, words in items]))
    # An item longer than a passage has passages of its own: any of them may meet a document's.
    owner, pieces = [], []
    for k, (_, words) in enumerate(items):
        for at in range(0, max(1, len(words) - STRIDE + 1), WINDOW):
            piece = words[at : at + WINDOW]
            pieces.append(space.weights(piece) @ space.projection[_terms(piece)])
            owner.append(k)
    query = _unit(np.array(pieces, np.float32))
    shipped = spark.sparkContext.broadcast((space.projection, space.weights, query, np.array(owner), items, ItemWords(items), ItemRuns(items)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, weighed, asked, owners, known, vocabulary, runs = shipped.value
        lengths = np.array([len(w) for _, w in known])
        # Words a passage has in common with the item, and a longest common subsequence.
        least, most = SHARED * np.minimum(lengths, WINDOW), np.where(lengths >= LEAST_WORDS, cover, 1.0)
        for batch in batches:
            for base, sizes, words in word_hashes(*utf8(batch.column(0))):
                best: dict[tuple[int, int], tuple[float, float]] = {}
                at, text = _strides(sizes, STRIDE)
                if not len(words):
                    continue
                rows, first = _passages(_sums(projection, _terms(words), weighed(words), at), text)
                rows, ends, numbers = _unit(rows), np.cumsum(sizes), vocabulary.number(words)
                starts = ends - sizes
                for item, begin, place in runs.among(words, ends):
                    own = np.searchsorted(ends, place, "right")
                    keep = np.flatnonzero(vocabulary.shared(numbers, place, ends[own], item) >= least[item])
                    item, begin, place, own = item[keep], begin[keep], place[keep], own[keep]
                    low, high = np.maximum(starts[own], begin - lengths[item]), np.minimum(ends[own], begin + 2 * lengths[item])
                    for c in np.flatnonzero(vocabulary.bound(numbers, low, high, item) / lengths[item] >= most[item]).tolist():
                        k, o = int(item[c]), int(own[c])
                        if best.get((o, k), (0.0, 0.0))[0] == 1:
                            continue
                        span, near = known[k][1], words[low[c] : high[c]]
                        found, answered = _shown(span, near)
                        if found >= (cover if len(span) >= LEAST_WORDS else 1.0) and (answered or found >= SURE):
                            # The passages of a text begin with it: the one that holds the place.
                            p = int(np.searchsorted(at[first], place[c], "right")) - 1
                            own_pieces = slice(*np.searchsorted(owners, [k, k + 1]))
                            best[o, k] = max(best.get((o, k), (0.0, 0.0)), (found, float((asked[own_pieces] @ rows[p]).max())))
                step = max(1, min(4096, CELLS // len(asked)))
                # Words of any item before each word.
                held = np.append(0, np.cumsum(numbers < vocabulary.kinds))
                for upto in range(0, len(rows), step):
                    close = rows[upto : upto + step] @ asked.T
                    hit = np.flatnonzero((close >= cosine).ravel())
                    if not len(hit):
                        continue
                    passage, which = hit // len(asked), hit % len(asked)
                    item, begin = owners[which], at[first[upto + passage]]
                    own = text[first[upto + passage]]
                    keep = np.flatnonzero(held[np.minimum(begin + WINDOW, ends[own])] - held[begin] >= least[item])
                    keep = keep[vocabulary.shared(numbers, begin[keep], ends[own[keep]], item[keep]) >= least[item[keep]]]
                    item, begin, own, passage, which = item[keep], begin[keep], own[keep], passage[keep], which[keep]
                    # The passage and as much on both sides as the item is long.
                    low, high = np.maximum(starts[own], begin - lengths[item]), np.minimum(ends[own], begin + WINDOW + lengths[item])
                    tried: set[tuple[int, int]] = set()
                    for c in np.flatnonzero(vocabulary.bound(numbers, low, high, item) / lengths[item] >= most[item]).tolist():
                        if (int(item[c]), int(begin[c])) in tried:
                            continue
                        tried.add((int(item[c]), int(begin[c])))
                        span, o = known[item[c]][1], int(own[c])
                        near = words[low[c] : high[c]]
                        found, answered = _shown(span, near)
                        if found >= (cover if len(span) >= LEAST_WORDS else 1.0) and (answered or found >= SURE):
                            pair = (o, int(item[c]))
                            best[pair] = max(best.get(pair, (0.0, 0.0)), (found, float(close[passage[c], which[c]])))
                if best:
                    pairs = list(best)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(1).take(pa.array([base + own for own, _ in pairs])),
                            pa.array([known[item][0] for _, item in pairs], pa.int64()),
                            pa.array([min(1.0, best[p][1]) for p in pairs], pa.float64()),
                            pa.array([best[p][0] for p in pairs], pa.float64()),
                        ],
                        names=["doc_id", "item_id", "cosine", "cover"],
                    )

    found = texts.mapInArrow(run, f"doc_id {kind}, item_id long, cosine double, cover double")
    top = F.max(F.struct("cover", "cosine")).alias("top")
    return found.groupBy("doc_id", "item_id").agg(top).select("doc_id", "item_id", "top.cosine", "top.cover")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all their columns, that hold no benchmark item. A row without doc_id is known by its text."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2("text", 256)))
    found = _pairs(docs.select("text", key.alias("doc_id")), benchmark).where("doc_id IS NOT NULL").select("doc_id").distinct()
    # A row without id and text has no key: it matches nothing and stays.
    return docs.join(found.withColumnRenamed("doc_id", "_"), key == F.col("_"), "left_anti").select(*docs.columns)

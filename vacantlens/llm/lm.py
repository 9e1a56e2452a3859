"""Masked pseudo-likelihood: a bidirectional window network scores documents.

The network sees the ``SIDE`` words on both sides of a masked word and gives every word of the
vocabulary a conditional probability: position-wise embeddings are added up, pass through tanh,
and a softmax over classes and one over the words of a class share the output. A document's
score is the sum over all its words of the log-probability given both sides.

Words outside the vocabulary share one entry; each of them is charged that entry's probability times
that of its spelling, by a model of byte pairs, so that rare and random words are not likely ones.

Everything is learnt from all documents: the byte pairs from every outside word, the vocabulary from word counts of the whole corpus
(added up in the shuffle), the weights in one pass over every window of every text. Each task
trains in numpy from the same start on its own texts; the weights are averaged by trained
windows, added up in the shuffle.

Defined cases: a null or wordless text has 0 words, log-likelihood 0 and a null mean; rows that
repeat a doc_id are separate documents; beyond a text's ends stands a boundary word; words
outside the vocabulary are spelt out; an empty corpus scores nothing and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantlens.llm.sums import BLOCKS, PARTIAL, add_up, partial
from vacantlens.llm.text import _LOWER, _SPACE, PIECE, _cut, bounded_batches, utf8, word_hashes
from vacantlens.session import ship

SIDE = 2
CLASSES = 64
#: Vocabulary with the entry for other words; entry v is word v % CLASSES of class v // CLASSES.
VOCABULARY = CLASSES * CLASSES
WIDTH = 16
BATCH, RATE = 4096, 0.3
#: Distinct words a task counts before it sends them on.
COUNTED = 1 << 19
#: Stands before and after a word's bytes; what every byte pair counts at least.
EDGE, LEAST_PAIR = 0x20, 0.01
PAIRS = 256 * 256


@dataclass
class Network:
    """Embeddings (2 SIDE, VOCABULARY + 1, WIDTH), class weights, word weights by class."""

    embed: np.ndarray
    classes: np.ndarray
    words: np.ndarray

    @staticmethod
    def start(seed: int = 42) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        return Network(draw(2 * SIDE, VOCABULARY + 1, WIDTH), draw(WIDTH + 1, CLASSES), draw(CLASSES, WIDTH + 1, CLASSES))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.embed.ravel(), self.classes.ravel(), self.words.ravel()])

    @staticmethod
    def of(flat: np.ndarray) -> Network:
        shapes = [(2 * SIDE, VOCABULARY + 1, WIDTH), (WIDTH + 1, CLASSES), (CLASSES, WIDTH + 1, CLASSES)]
        parts = np.split(flat.astype(np.float32), np.cumsum([np.prod(s) for s in shapes])[:-1])
        return Network(*[p.reshape(s) for p, s in zip(parts, shapes)])

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """Hidden layer of windows (n, 2 SIDE), with a constant 1 at the end."""
        total = self.embed[0].take(around[:, 0], axis=0)
        for k in range(1, 2 * SIDE):
            total += self.embed[k].take(around[:, k], axis=0)
        out = np.ones((len(around), WIDTH + 1), np.float32)
        np.tanh(total, out=out[:, :WIDTH])
        return out

    def inner(self, hidden: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Logits of the words of every window's class; ``group`` sorted."""
        out = np.empty((len(group), CLASSES), np.float32)
        for low, high, c in _runs(group):
            np.matmul(hidden[low:high], self.words[c], out=out[low:high])
        return out

    def log_probabilities(self, around: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Of each window's masked word; ``centre`` sorted by class."""
        hidden = self.hidden(around)
        group, word = centre // CLASSES, centre % CLASSES
        return _log_chosen(hidden @ self.classes, group) + _log_chosen(self.inner(hidden, group), word)

    def train(self, around: np.ndarray, centre: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the mean log-loss; ``centre`` sorted by class."""
        n = len(centre)
        hidden = self.hidden(around)
        group, word = centre // CLASSES, centre % CLASSES
        outer, inner = _softmax(hidden @ self.classes), _softmax(self.inner(hidden, group))
        outer[np.arange(n), group] -= 1
        inner[np.arange(n), word] -= 1
        step = rate / n
        back = np.empty((n, WIDTH + 1), np.float32)
        for low, high, c in _runs(group):
            own = inner[low:high]
            np.matmul(own, self.words[c].T, out=back[low:high])
            # A rare class takes a larger share of the step, up to that of its own mean.
            self.words[c] -= hidden[low:high].T @ own * (rate / max(high - low, n // CLASSES))
        back += outer @ self.classes.T
        self.classes -= step * CLASSES**0.5 * (hidden.T @ outer)
        slope = back[:, :WIDTH] * (1 - hidden[:, :WIDTH] ** 2)
        for k in range(2 * SIDE):
            order = np.argsort(around[:, k].astype(np.uint16), kind="stable")  # by radix
            ids = around[order, k]
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            counts = np.diff(np.append(first, n))
            # Per word a step by the root of how often it stood there.
            scale = (rate / np.sqrt(counts * (n / VOCABULARY + 1)))[:, None].astype(np.float32)
            self.embed[k][ids[first]] -= scale * np.add.reduceat(slope[order], first, axis=0)


#: Logits that differ by less are moved by one number: none of their exponentials vanishes.
SPREAD = 60


def _shift(logits: np.ndarray) -> None:
    """Moves every row so that its exponentials neither overflow nor all vanish."""
    if len(logits):
        top = logits.max()
        logits -= top if top - logits.min() < SPREAD else logits.max(axis=1, keepdims=True)


def _sums(values: np.ndarray) -> np.ndarray:
    return values @ np.ones(values.shape[1], values.dtype)


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Of every row, in place."""
    _shift(logits)
    np.exp(logits, out=logits)
    logits /= _sums(logits)[:, None]
    return logits


def _log_chosen(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Every row's log-softmax at one column; the rows are used up."""
    _shift(logits)
    out = logits[np.arange(len(chosen)), chosen]
    np.exp(logits, out=logits)
    return out - np.log(_sums(logits))


def _by_class(entries: np.ndarray) -> np.ndarray:
    """Order of the entries by class, by radix."""
    return np.argsort((entries // CLASSES).astype(np.uint8), kind="stable")


assert CLASSES <= 256 and VOCABULARY < 1 << 16


def _runs(group: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, end, value) of the runs of a sorted array."""
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    for low, high in zip(edges, np.append(edges[1:], len(group))):
        yield int(low), int(high), int(group[low])


def _bytes_of(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(byte before, byte, whether it begins its word, whether it ends it) of all bytes in words."""
    solid, letters = ~_SPACE[data], _LOWER[data].astype(np.int64)
    before, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    before[1:], after[:-1] = solid, solid
    before[breaks] = False
    after[breaks] = False
    at = np.flatnonzero(solid)
    first, last = ~before[at], ~after[at + 1]
    return np.where(first, EDGE, letters[at - 1]), letters[at], first, last


def _spelt(data: np.ndarray, offsets: np.ndarray, first: int, texts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``_bytes_of`` the words of a run of texts, in the words' order, a bounded piece at a time."""
    low, high = int(offsets[first]), int(offsets[first + texts])
    if texts > 1 or high - low <= PIECE:
        yield _bytes_of(data[low:high], offsets[first + 1 : first + texts] - low)
        return
    while low < high:
        stop = _cut(data, low, high)
        yield _bytes_of(data[low:stop], np.zeros(0, np.int64))
        low = stop


def spelling(pairs: np.ndarray) -> np.ndarray:
    """Log-probabilities of a byte after another, from the counts of pairs."""
    counts = np.maximum(pairs.reshape(256, 256), 0) + LEAST_PAIR
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _count_pairs(pairs: np.ndarray, data: np.ndarray, offsets: np.ndarray, first: int, texts: int, outside: np.ndarray) -> None:
    """Adds the byte pairs of a run's words for which ``outside`` holds."""
    done = 0
    for before, byte, begins, ends in _spelt(data, offsets, first, texts):
        word = np.cumsum(begins) - 1
        own = outside[done + word] if len(word) else np.zeros(0, bool)
        pairs += np.bincount((before * 256 + byte)[own], minlength=PAIRS)
        pairs += np.bincount((byte * 256 + EDGE)[own & ends], minlength=PAIRS)
        done += int(begins.sum())


def _spelling_costs(letters: np.ndarray, data: np.ndarray, offsets: np.ndarray, first: int, texts: int) -> np.ndarray:
    """Log-probability of every word's spelling in a run of texts."""
    out = [np.zeros(0)]
    for before, byte, begins, ends in _spelt(data, offsets, first, texts):
        if len(byte):
            out.append(np.add.reduceat(letters[before, byte] + np.where(ends, letters[byte, EDGE], 0.0), np.flatnonzero(begins)))
    return np.concatenate(out)


class Vocabulary:
    """Word hashes to entries, by a sorted table; 0 is every other word, spelt by ``letters``."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.letters = spelling(np.zeros(PAIRS))
        order = np.argsort(hashes)
        self.hashes, self.entries = hashes[order], (order + 1).astype(np.int32)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(words), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.entries[at], 0)


def windows(entries: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The 2 SIDE entries around every word; VOCABULARY beyond a text's ends."""
    owner = np.repeat(np.arange(len(counts)), counts)
    out = np.full((len(entries), 2 * SIDE), VOCABULARY, np.int32)
    for k in range(SIDE):
        gap = k + 1
        if len(entries) > gap:
            same = owner[gap:] == owner[:-gap]
            out[gap:, k][same] = entries[:-gap][same]
            out[:-gap, SIDE + k][same] = entries[gap:][same]
    return out


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): the corpus's words by hash and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([words, *held])
            weight = np.concatenate([counts, np.ones(len(every) - len(words), np.int64)])
            order = np.argsort(every)
            every = every[order]
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
            return every[first], np.add.reduceat(weight[order], first) if len(first) else np.zeros(0, np.int64)

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])

        for batch in batches:
            for _, _, own in word_hashes(*utf8(batch.column(0))):
                held.append(own)
                size += len(own)
                if size >= 2 * COUNTED:
                    words, counts = merged()
                    held, size = [], 0
                    if len(words) >= COUNTED:
                        yield sent()
                        words, counts = words[:0], counts[:0]
        words, counts = merged()
        yield sent()

    return texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text: str = "text", seed: int = 42) -> tuple[Vocabulary, Network]:
    """The vocabulary and the network of the whole corpus."""
    spark = bounded_batches(ship(docs.sparkSession))
    texts = docs.select(F.col(text).alias("text"))
    top = count_words(texts).orderBy(F.col("n").desc(), "word").limit(VOCABULARY - 1).toArrow()
    vocabulary = Vocabulary(top.column("word").to_numpy().view(np.uint64))
    begin = Network.start(seed)
    shipped = spark.sparkContext.broadcast((vocabulary, begin.flat()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = shipped.value
        network, trained, steps = Network.of(flat), 0, 0
        pairs = np.zeros(PAIRS, np.int64)
        for batch in batches:
            for around, centre in _examples(batch.column(0), known, pairs):
                for at in range(0, len(centre), BATCH):
                    own = centre[at : at + BATCH]
                    order = _by_class(own)
                    network.train(around[at : at + BATCH][order], own[order], RATE / (1 + steps / 2000))
                    trained, steps = trained + len(own), steps + 1
        if trained:
            weights = network.flat().astype(np.float64) * (trained / 1e6)
            yield from partial(_grid(np.concatenate([pairs, weights, [trained / 1e6]])))

    size = PAIRS + len(begin.flat()) + 1
    total = add_up(texts.mapInArrow(run, PARTIAL), (-(-size // ROW), ROW)).ravel()[:size]
    shipped.destroy()
    vocabulary.letters = spelling(total[:PAIRS])
    return vocabulary, Network.of(total[PAIRS:-1] / total[-1]) if total[-1] > 0 else begin


ROW = 256


def _grid(flat: np.ndarray) -> np.ndarray:
    out = np.zeros(-(-len(flat) // ROW) * ROW)
    out[: len(flat)] = flat
    return out.reshape(-1, ROW)


assert VOCABULARY * WIDTH // ROW >= BLOCKS


def _examples(column: pa.Array, known: Vocabulary, pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows and masked words; adds the byte pairs of outside words to ``pairs``."""
    data, offsets = utf8(column)
    for first, counts, words in word_hashes(data, offsets):
        if len(words):
            entries = known(words)
            _count_pairs(pairs, data, offsets, first, len(counts), entries == 0)
            yield windows(entries, counts), entries


def score(docs: DataFrame, model: tuple[Vocabulary, Network], columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every row with n_words, log_likelihood (of all words given both sides) and
    mean_log_likelihood."""
    spark = bounded_batches(ship(docs.sparkSession))
    shipped = spark.sparkContext.broadcast(model)
    schema = docs.select(*columns).schema.add("n_words", "long").add("log_likelihood", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, network = shipped.value
        for batch in batches:
            sizes, sums = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            data, offsets = utf8(batch.column(0))
            for first, counts, words in word_hashes(data, offsets):
                entries = known(words)
                around = windows(entries, counts)
                owner = np.repeat(np.arange(len(counts)), counts)
                sizes[first : first + len(counts)] = counts
                spelt = np.where(entries == 0, _spelling_costs(known.letters, data, offsets, first, len(counts)), 0.0)
                sums[first : first + len(counts)] += np.bincount(owner, spelt, len(counts))
                for at in range(0, len(entries), 2 * BATCH):
                    own = entries[at : at + 2 * BATCH]
                    order = _by_class(own)
                    logs = network.log_probabilities(around[at : at + 2 * BATCH][order], own[order])
                    sums[first : first + len(counts)] += np.bincount(owner[at : at + 2 * BATCH][order], logs, len(counts))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes), pa.array(sums)], names=[*columns, "n_words", "log_likelihood"])

    out = docs.select(F.col(text).alias("_scored_text"), *columns).mapInArrow(run, schema)
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def scored_documents(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Learn from ``docs`` and score them."""
    return score(docs, learn(docs), columns or ["doc_id"])

"""Phrases whose words stand together more often than apart, by vertical partitioning.

The suffix tree of all texts, cut at ``most_words`` words, is never whole anywhere. Its suffixes
are split by the words they begin with:

1. Words are counted; a word's count is the size of its subtree. A word whose subtree would pass
   ``budget`` suffixes is heavy and its prefix is lengthened by a word, as often as needed. A
   prefix can only be heavy if the shorter ones in it are, so the passes that count longer
   prefixes touch few of them. The heavy prefixes of one length are at most the corpus' words
   divided by the budget; that is what is sent to the tasks.
2. Prefixes that fit are put into groups of about ``budget`` suffixes by a hash. Every task sorts
   its own suffixes, counts equal ones, and sends each group one packed share, so a phrase that a
   third of all rows hold is one entry per task.
3. A group's task merges the shares into sorted subtrees and reads each phrase's count from the
   total of the leaves below it.

Cuts, the phrases inside longer ones and the ranking are joins and groupings of the few phrases
that are frequent enough. A word is kept as a 64-bit hash of language and word until the end.

Defined cases: a null or empty text has no words; a null language is ``und``; rows that repeat a
doc_id count each; phrases that tie in score and count are in order of their UTF-8 bytes; an empty
table, or none with frequent phrases, gives no rows; other columns are ignored, whatever they are
called. A text is held whole by one task with about 60 bytes of scratch per word. Products of
counts are exact to 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantlens.llm import stream
from vacantlens.llm.text import bounded_batches, mix, utf8
from vacantlens.session import stored

#: Suffixes of a group, bytes of text a task sorts at a time.
BUDGET, CHUNK = 1_000_000, 8 << 20
#: What ends a piece, and with blanks what ends a word.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

_BLANK, _BREAK = stream.byte_table(BREAKS + BLANKS), stream.byte_table(BREAKS)
_END = np.uint64(0)


class _Chunk:
    """The words of some texts: hashes that tell languages apart, and where pieces end."""

    def __init__(self, batches: Sequence[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(batches)
        self.data, offsets = utf8(rows.column(1))
        langs = rows.column(0).combine_chunks().dictionary_encode()
        if isinstance(langs, pa.ChunkedArray):
            langs = langs.combine_chunks()
        self.langs = langs.dictionary
        self.words = stream.words_of(self.data, offsets, _BLANK, stream.lower_bytes())
        owner = np.repeat(np.arange(len(offsets) - 1), self.words.counts)
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[owner]
        data, at = utf8(self.langs)
        salt = mix(np.array([int.from_bytes(data[a:b].tobytes(), "big") % ((1 << 61) - 1) for a, b in zip(at[:-1], at[1:])], np.uint64) + np.uint64(1))
        #: By word; never the mark of an ended piece.
        self.hashes = mix(self.words.hashes + salt[self.lang]) | np.uint64(1) if len(owner) else self.words.hashes
        breaks = np.searchsorted(np.flatnonzero(_BREAK[self.data]), self.words.starts)
        #: Whether a word goes on in the piece of the word before it.
        self.goes_on = np.zeros(len(owner) + 1, bool)
        self.goes_on[1:-1] = (owner[1:] == owner[:-1]) & (breaks[1:] == breaks[:-1])

    def suffixes(self, depth: int) -> list[np.ndarray]:
        """By word: it and the next words of its piece, ``depth`` columns; then the end mark."""
        columns, alive = [self.hashes], np.ones(len(self.hashes), bool)
        for k in range(1, depth):
            alive = alive & np.append(self.goes_on[k:-1], np.zeros(min(k, len(alive)), bool))[: len(alive)]
            ahead = np.append(self.hashes[k:], np.zeros(min(k, len(alive)), np.uint64))
            columns.append(np.where(alive, ahead, _END))
        return columns

    def word(self, i: int) -> str:
        raw = self.data[self.words.starts[i] : self.words.ends[i]].tobytes()
        return raw.lower().decode() if raw.isascii() else raw.translate(_LOWER).decode()


_LOWER = bytes(stream.lower_bytes())


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK:
            yield _Chunk(held)
            held, size = [], 0
    if held:
        yield _Chunk(held)


def _prefixes(columns: list[np.ndarray]) -> list[np.ndarray]:
    """One hash for each length of prefix of every suffix."""
    out = [columns[0]]
    for column in columns[1:]:
        out.append(mix(out[-1] * np.uint64(0x9E3779B97F4A7C15) + column))
    return out


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


# --- 1. prefixes ------------------------------------------------------------------------------------


def vocabulary(texts: DataFrame) -> DataFrame:
    """(h, lang, word, n): every word of (lang, text) with its count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            found, first, n = np.unique(chunk.hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found.view(np.int64)),
                    chunk.langs.take(pa.array(chunk.lang[first])) if len(first) else pa.array([], pa.string()),
                    pa.array([chunk.word(i) for i in first.tolist()], pa.string()),
                    pa.array(n.astype(np.int64)),
                ],
                names=["h", "lang", "word", "n"],
            )

    rows = texts.mapInArrow(count, "h long, lang string, word string, n long")
    return rows.groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))


def _longer(texts: DataFrame, heavy: list[np.ndarray], budget: int) -> list:
    """Heavy prefixes, one word longer than the last known ones: rows (words, n)."""
    size = len(heavy) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            columns = chunk.suffixes(size)
            last = _prefixes(columns[: size - 1])[-1], _prefixes(columns[1:])[-1]
            keep = np.flatnonzero(_among(last[0], heavy[-1]) & _among(last[1], heavy[-1]))
            found, first, n = np.unique(_prefixes(columns)[-1][keep], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([_lists([c[keep[first]] for c in columns]), pa.array(n.astype(np.int64))], names=["words", "n"])

    counted = texts.mapInArrow(count, "words array<long>, n long").groupBy("words").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") > budget).collect()  # at most words of the corpus / budget


def _lists(columns: list[np.ndarray]) -> pa.ListArray:
    n = len(columns[0])
    values = np.stack(columns, axis=1).reshape(-1).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(columns)), pa.array(values))


# --- 2. shares of the groups --------------------------------------------------------------------------


def _order(columns: list[np.ndarray]) -> np.ndarray:
    """Sorting order of the suffixes by all their columns."""
    found, ids = np.unique(np.concatenate(columns), return_inverse=True)
    parts = np.split(ids, len(columns))
    code, size = parts[0], len(found)
    for part in parts[1:]:
        if size * len(found) >= 1 << 63:
            known, code = np.unique(code, return_inverse=True)
            size = len(known)
        code, size = code * len(found) + part, size * len(found)
    return np.argsort(code)


def _fresh(columns: list[np.ndarray]) -> list[np.ndarray]:
    """For each length of prefix, where in the sorted suffixes a new one begins."""
    out, new = [], np.zeros(len(columns[0]), bool)
    new[:1] = True
    for column in columns:
        new = new.copy()
        new[1:] |= column[1:] != column[:-1]
        out.append(new)
    return out


def _share(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Sorted suffixes without their repeated prefixes."""
    n = len(counts)
    parts = [np.array([n], np.uint32).tobytes(), counts.astype(np.uint32).tobytes()]
    for column, new in zip(columns[:-1], _fresh(columns)):
        parts += [np.packbits(new).tobytes(), column[new].tobytes()]
    return b"".join([*parts, columns[-1].tobytes()])


def _unshared(share: memoryview, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    n = int(np.frombuffer(share, np.uint32, 1)[0])
    counts, at = np.frombuffer(share, np.uint32, n, 4), 4 + 4 * n
    columns = []
    for _ in range(depth - 1):
        bits = (n + 7) // 8
        new = np.unpackbits(np.frombuffer(share, np.uint8, bits, at), count=n).astype(bool)
        at += bits
        some = int(new.sum())
        columns.append(np.frombuffer(share, np.uint64, some, at)[np.cumsum(new) - 1])
        at += 8 * some
    return [*columns, np.frombuffer(share, np.uint64, n, at)], counts


def _shares(texts: DataFrame, depth: int, heavy: list[np.ndarray], groups: int) -> DataFrame:
    """(grp, level, share): level is how many words a group's prefixes have."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            columns = chunk.suffixes(depth)
            order = _order(columns)
            columns = [c[order] for c in columns]
            firsts = np.flatnonzero(_fresh(columns)[-1])
            counts = np.diff(np.append(firsts, len(order)))
            columns = [c[firsts] for c in columns]
            prefixes = _prefixes(columns)
            level, still = np.zeros(len(firsts), np.int64), np.ones(len(firsts), bool)
            for prefix, known in zip(prefixes, heavy):
                still &= _among(prefix, known)
                level += still
            key = np.choose(level, prefixes[: len(heavy) + 1])
            lane = (mix(key) % np.uint64(groups)).astype(np.int64) * depth + level
            by_lane = np.argsort(lane, kind="stable")
            cuts = np.flatnonzero(np.diff(lane[by_lane])) + 1
            parts = [p for p in np.split(by_lane, cuts) if len(p)]
            lanes = np.array([lane[p[0]] for p in parts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lanes // depth),
                    pa.array(lanes % depth + 1),
                    pa.array([_share([c[p] for c in columns], counts[p]) for p in parts], pa.binary()),
                ],
                names=["grp", "level", "share"],
            )

    return texts.mapInArrow(deal, "grp long, level long, share binary")


# --- 3. subtrees ----------------------------------------------------------------------------------------


def _subtrees(depth: int, least: int):
    def build(shares: pa.Table) -> pa.Table:
        level = shares.column("level")[0].as_py()
        read = [_unshared(memoryview(s.as_buffer()), depth) for s in shares.column("share")]
        columns = [np.concatenate([r[0][k] for r in read]) for k in range(depth)]
        counts = np.concatenate([r[1] for r in read]).astype(np.int64)
        del read
        order = np.lexsort(columns[::-1])
        columns, counts = [c[order] for c in columns], counts[order]
        words, totals = [pa.array([], pa.list_(pa.int64()))], [pa.array([], pa.int64())]
        for length, new in enumerate(_fresh(columns), 1):
            if length < max(level, 2):
                continue
            at = np.flatnonzero(new)
            leaves = np.add.reduceat(counts, at)
            keep = (leaves >= least) & (columns[length - 1][at] != _END)
            words.append(_lists([c[at[keep]] for c in columns[:length]]))
            totals.append(pa.array(leaves[keep]))
        return pa.table({"words": pa.concat_arrays(words), "f": pa.concat_arrays(totals)})

    return build


def frequent_phrases(texts: DataFrame, words: DataFrame, most_words: int, least: int, budget: int = BUDGET) -> DataFrame:
    """(words, f): the phrases of 2 to ``most_words`` words that (lang, text) holds ``least`` times
    or more, as word hashes. ``words`` is the stored vocabulary."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = words.where(F.col("n") > budget).select("h").collect()  # at most total / budget
    heavy, known = [], []
    while found and len(heavy) < most_words - 1:
        columns = [np.array(c, np.int64).view(np.uint64) for c in zip(*[r["words"] if heavy else (r["h"],) for r in found])]
        heavy.append(np.sort(_prefixes(columns)[-1]))
        if len(heavy) > 1:
            known += [(r["words"], r["n"]) for r in found]
        if len(heavy) < most_words - 1:
            found = _longer(texts, heavy, budget)
    shares = _shares(texts, most_words, heavy, max(1, ceil(total / budget)))
    out = shares.groupBy("grp", "level").applyInArrow(_subtrees(most_words, least), "words array<long>, f long")
    if not known:
        return out
    # Prefixes that are spread over groups have their counts already.
    return out.unionByName(texts.sparkSession.createDataFrame(known, "words array<long>, f long").where(F.col("f") >= least))


def collocations(
    docs: DataFrame, least_words: int = 2, most_words: int = 3, least: int = 10, percent: int = 50, per_lang: int = 2000,
    lang: str = "lang", text: str = "text", budget: int = BUDGET,
) -> DataFrame:
    """Each language's ``per_lang`` best phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase of count a cut in two parts of counts l and r scores floor(10^6 a² / (l r)); its lowest
    cut counts. A phrase inside a longer one with at least ``percent`` of its count is left out.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    words = stored(vocabulary(texts), "words")
    single = words.where(F.col("n") >= least)
    phrases = stored(frequent_phrases(texts, words, most_words, least, budget), "phrases")
    counted = phrases.select("words", "f", F.lit(None).cast("string").alias("lang")).unionByName(
        single.select(F.array("h").alias("words"), F.col("n").alias("f"), "lang")
    )
    left = counted.select(F.col("words").alias("_left"), F.col("f").alias("l"), "lang")
    right = counted.select(F.col("words").alias("_right"), F.col("f").alias("r"))
    cuts = (
        phrases.where(F.size("words") >= least_words)
        .select("words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
        .withColumn("_left", F.expr("slice(words, 1, k)"))
        .withColumn("_right", F.expr("slice(words, k + 1, size(words) - k)"))
        .join(left, "_left")
        .join(right, "_right")
    )
    wide = "CAST({} AS DECIMAL(19, 0))"
    score = F.expr(f"({wide.format('a')} * {wide.format('a')} * 1000000) div ({wide.format('l')} * {wide.format('r')})")
    scored = cuts.select("words", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"), "lang", F.lit(0).cast("long").alias("longer"))
    inner = phrases.select("words", "f", F.explode(F.expr("filter(sequence(2, size(words)), s -> s < size(words))")).alias("s")).select(
        F.explode(F.expr("transform(sequence(1, size(words) - s + 1), i -> slice(words, i, s))")).alias("words"), "f"
    )
    inside = inner.select(
        "words", F.lit(None).cast("long").alias("a"), F.lit(None).cast(scored.schema["cut"].dataType).alias("cut"),
        F.lit(None).cast("string").alias("lang"), F.col("f").alias("longer"),
    )
    best = (
        scored.unionByName(inside)
        .groupBy("words")
        .agg(F.max("a").alias("a"), F.min("cut").alias("cut"), F.max("lang").alias("lang"), F.max("longer").alias("longer"))
        .where(F.col("cut").isNotNull() & (100 * F.col("longer") < percent * F.col("a")))
        .select("words", "lang", "a", "cut.score", "cut.l", "cut.r")
    )
    # Ties at the end of a list all stay until their words are known.
    first = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    top = best.withColumn("_place", F.rank().over(first)).where(F.col("_place") <= per_lang).drop("_place")
    spelt = (
        top.select("*", F.posexplode("words").alias("pos", "h"))
        .join(single.select("h", "word"), "h")
        .groupBy("words", "lang", "a", "score", "l", "r")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("spelt"))
        .withColumn("phrase", F.array_join(F.col("spelt.word"), " "))
    )
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        spelt.withColumn("rank", F.row_number().over(ranked).cast("long"))
        .where(F.col("rank") <= per_lang)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )

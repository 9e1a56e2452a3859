"""Similar names without scoring all pairs: an exact filter join on words and letter runs.

Token-set similarity of two texts is the best of three ratios. Two compare the shared words with one
whole text: for a score of t or more they need shared words of at least t / (2 - t) of that text's
length. The third compares both texts letter by letter, and then so many letters differ at most.
Both conditions become equi joins:

* words are ordered by how many texts hold them, rarest first. Shared words of that length include one
  of the first words, those without which the rest is too short. Only pairs of texts that share such a
  word meet;
* a text is cut into one piece more than the letters that may differ, so one piece at least stands
  unbroken inside a word of any similar text that is not longer. Of more pieces the rarest are looked
  up. Lengths must allow the score as well.

Where words or pieces are common (few words or letter runs make up all texts), the joins would hold far more pairs than
there are texts. A sample of the texts tells; then chunks of keys meet blocks of entries instead, each pair of them in one
task, which looks for pairs by the same conditions (``alike``) and scores them there. That is a test of every pair, but a cheap one: memory is
bounded by the blocks, a text is a row for every block it meets, and no pair is a row before it is a result.

What the joins let through is scored in Arrow batches, from the shared words first; letters are aligned
only for pairs whose bound still reaches the threshold. The result is that of scoring every pair.
A text that is frequent is joined once: equal word sets are one class until the end (in a block, one text). The pieces are
about 1 / (2 - 2t) letters long, so the join is worth its while from a threshold of about 75.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from vacantlens.operators import alike
from vacantlens.operators.alike import COUNTED, LEVELS
from vacantlens.operators.scoring import common_length, comparable
from vacantlens.session import spread, stored

#: Letters of a piece beyond which it is cut off: rare enough, and fewer runs to look up.
LONGEST_PIECE = 6
#: Texts of each side whose words and pieces are joined to tell how many candidates there are.
SAMPLE = 2000
#: Share of all pairs, and candidates per text, from which blocks cost less time or less disk than rows.
COMMON, PER_TEXT = 1 / 4000, 4
#: Texts of both sides that meet in one block, bytes of their texts, and results handed on at once.
BLOCK_KEYS, BLOCK_ENTRIES, BLOCK_BYTES, BATCH = 1 << 18, 1 << 18, 32 << 20, 1 << 16


@pandas_udf(T.StringType())
def _distinct_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: " ".join(sorted(set(comparable(text).split()))))


@pandas_udf(T.BinaryType())
def _letters(words: pd.Series) -> pd.Series:
    """How often each of 32 groups of letters stands in the words, and the blanks between them."""
    return words.map(lambda w: np.minimum(np.bincount([ord(c) % 32 for c in " ".join(w)], minlength=32), COUNTED).astype(np.uint16).tobytes())


@pandas_udf(T.BooleanType())
def _enough_letters(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series, share: pd.Series) -> pd.Series:
    """Whether the letters of both texts, in any order, could make up the share that must be common."""
    both = [np.frombuffer(b"".join(side), np.uint16).reshape(-1, 32) for side in (a, b)]
    common = np.minimum(*both).sum(axis=1, dtype=np.int64)
    return (2 * common >= share * (na + nb) - 1e-6) | (na > COUNTED) | (nb > COUNTED)


def word_rows(df: DataFrame, item: str, text: str) -> DataFrame:
    """(row, item, text): a number, and the sorted distinct comparable words joined by blanks; rows without words are left out."""
    worded = df.select(F.col(item).alias("item"), _distinct_words(text).alias("text")).where(F.col("text") != "")
    return worded.withColumn("row", F.monotonically_increasing_id())


def word_classes(rows: DataFrame) -> DataFrame:
    """(item, words, class): ``class`` is a digest of the words."""
    return rows.select("item", F.split("text", " ").alias("words"), F.sha2("text", 256).alias("class"))


def _length(words: Column) -> Column:
    """Length of words joined by blanks."""
    return F.char_length(F.array_join(words, " "))


def _by_words(classes: DataFrame, share: float) -> DataFrame:
    """(a, b): pairs whose shared words can make up enough of one of both texts."""
    words = classes.select("side", "class", "n", F.explode("words").alias("e"))
    words = words.join(words.groupBy("e").agg(F.count(F.lit(1)).alias("seen")), "e")
    order = W.partitionBy("side", "class").orderBy("seen", "e")
    # Letters of this and all more frequent words, as one text.
    rest = F.sum(F.char_length("e") + 1).over(order.rowsBetween(0, W.unboundedFollowing)) - 1
    marked = words.withColumn("is_first", rest >= F.col("n") * (share / (2 - share)) - 1e-9)
    left = marked.where("side = 0").select("e", F.col("class").alias("a"), F.col("is_first").alias("first_a"))
    right = marked.where("side = 1").select("e", F.col("class").alias("b"), F.col("is_first").alias("first_b"))
    # Two joins, so that a word that is no first word of one side never meets its copies there.
    both = left.where("first_a").join(right, "e"), left.where("NOT first_a").join(right.where("first_b"), "e")
    return both[0].select("a", "b").unionByName(both[1].select("a", "b"))


def _with_needed(texts: DataFrame, share: float) -> DataFrame:
    """Adds ``need``, one piece more than a similar text that is not longer can break, and ``cut``, how many there are.

    So many letters differ at most; each breaks one piece. Where a text has fewer letters than that,
    its pieces are all its single letters, which only letters it lacks in the other text can break.
    """
    edits = F.floor(F.col("n") * (2 * (1 - share)) + 1e-9)
    missing = F.floor(F.col("n") * (2 * (1 - share) / (2 - share)) + 1e-9)
    fits = edits <= F.col("n")
    return texts.withColumn("need", (F.when(fits, edits).otherwise(missing) + 1).cast("int")).withColumn(
        "cut", F.when(fits, F.col("need")).otherwise(F.col("n") + 1).cast("int")
    )


def cut_words(words: list[str], need: int) -> list[str]:
    """The words, a blank before each, in ``need`` pieces or one per word, the shortest as long as can be.

    Uneven pieces begin with the longer ones: a blank and one letter would be the commonest.
    """
    letters = [len(w) + 1 for w in words]
    parts = [1] * len(words)
    heap = [(-(n // 2), -n, i) for i, n in enumerate(letters)]
    heapq.heapify(heap)
    for _ in range(need - len(words)):
        _, _, i = heapq.heappop(heap)
        parts[i] += 1
        heapq.heappush(heap, (-(letters[i] // (parts[i] + 1)), -letters[i] / parts[i], i))
    return [(" " + w)[-(-k * n // p) : -(-(k + 1) * n // p)][:LONGEST_PIECE] for w, n, p in zip(words, letters, parts) for k in range(p)]


@pandas_udf(T.ArrayType(T.StringType()))
def _pieces(words: pd.Series, cut: pd.Series) -> pd.Series:
    return pd.Series([cut_words(list(w), int(n)) for w, n in zip(words, cut)])


def _runs(classes: DataFrame, lengths: list[int]) -> DataFrame:
    """(class, n, e): every run of so many letters inside the words of a text, a blank before each word."""
    words = classes.select("class", "n", F.explode("words").alias("w"))
    fits = words.withColumn("q", F.explode(F.array(*[F.lit(q) for q in lengths]))).where(F.col("q") <= F.char_length("w") + 1)
    at = fits.withColumn("i", F.explode(F.sequence(F.lit(1), F.char_length("w") + 2 - F.col("q"))))
    return at.select("class", "n", F.concat(F.lit(" "), F.col("w")).substr(F.col("i"), F.col("q")).alias("e")).distinct()


def _by_letters(classes: DataFrame, share: float) -> DataFrame:
    """(a, b): pairs whose letters can be alike enough.

    The longer text is cut into one piece more than its partner can break, so one piece stands in the
    partner as it is. Of more pieces the rarest are kept.
    """
    out = []
    for side, names in ((0, ("a", "b")), (1, ("b", "a"))):
        own, other = classes.where(F.col("side") == side), classes.where(F.col("side") != side)
        pieces = stored(
            _with_needed(own, share).select("class", "n", "need", F.explode(_pieces("words", "cut")).alias("e")), "pieces"
        )
        lengths = [r[0] for r in pieces.select(F.char_length("e")).distinct().collect()]  # at most LONGEST_PIECE
        if not lengths:
            continue
        runs = stored(_runs(other, lengths).join(pieces.select("e").distinct(), "e", "left_semi"), "runs")
        seen = runs.groupBy("e").agg(F.count(F.lit(1)).alias("seen"))
        # A piece that no text holds is as good as met: it comes first and joins nothing.
        place = F.row_number().over(W.partitionBy("class").orderBy(F.coalesce("seen", F.lit(0)), "e"))
        kept = pieces.join(seen, "e", "left").withColumn("place", place).where(F.col("place") <= F.col("need"))
        left = kept.select("e", F.col("class").alias(names[0]), F.col("n").alias("longer"))
        right = runs.select("e", F.col("class").alias(names[1]), F.col("n").alias("shorter"))
        sizes = (F.col("shorter") <= F.col("longer")) & (F.col("shorter") >= F.col("longer") * (share / (2 - share)) - 1e-9)
        out.append(left.join(right, "e").where(sizes).select("a", "b"))
    return reduce(DataFrame.unionByName, out) if out else classes.select(F.col("class").alias("a"), F.col("class").alias("b")).limit(0)


def _sample(rows: DataFrame, size: int, side: int) -> DataFrame:
    """Up to ``SAMPLE`` distinct texts, the same for the same texts of a side; both sides are sampled independently."""
    digest, parts = F.xxhash64("text", F.lit(side)), 1 << 40
    some = rows.where(F.pmod(digest, F.lit(parts)) < ceil(parts * min(1.0, 4 * SAMPLE / max(1, size))))
    return some.select("text").distinct().orderBy(digest, "text").limit(SAMPLE)


def _many_candidates(sides: tuple[DataFrame, DataFrame], sizes: list[int], share: float) -> bool:
    """Whether a sample of the texts meets so often by words or pieces that blocks cost less. Both ways find the same pairs."""
    texts = [_sample(rows, size, i).withColumn("side", F.lit(i)) for i, (rows, size) in enumerate(zip(sides, sizes))]
    numbered = texts[0].unionByName(texts[1]).select("side", F.monotonically_increasing_id().alias("class"), F.split("text", " ").alias("words"))
    classes = stored(numbered.withColumn("n", _length(F.col("words"))), "sample")
    seen = {r["side"]: r["count"] for r in classes.groupBy("side").count().collect()}
    if len(seen) < 2:
        return False
    met = _by_words(classes, share).unionByName(_by_letters(classes, share)).distinct().count()
    at_least = max(0.0, met - 3 * sqrt(met)) / (seen[0] * seen[1])  # a few pairs may have met by chance
    return at_least > COMMON or at_least * sizes[0] * sizes[1] > PER_TEXT * sum(sizes)


def alike_in_block(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and of ``b`` (letter counts, lengths) that have enough letters in common."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *alike.alike_slices(a, b, na, nb, share, LEVELS)]
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _expanded(i: np.ndarray, j: np.ndarray, scores: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of rows for pairs of distinct texts, ``BATCH`` at once; ``rows`` has the order, starts and numbers of a text's rows."""
    (order_a, start_a, size_a), (order_b, start_b, size_b) = rows
    times = size_a[i] * size_b[j]
    total = np.cumsum(times)
    for at in range(0, int(total[-1]) if len(total) else 0, BATCH):
        place = np.arange(at, min(at + BATCH, int(total[-1])))
        of = np.searchsorted(total, place, "right")
        copy = place - (total[of] - times[of])
        yield order_a[start_a[i[of]] + copy // size_b[j[of]]], order_b[start_b[j[of]] + copy % size_b[j[of]]], scores[of]


def _met(keys: pa.Table, entries: pa.Table, share: float, threshold: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of two tables (text, and an item each) whose texts score ``threshold`` or more."""
    sides, rows = [], []
    for table in (keys, entries):
        coded = table["text"].combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        size = np.bincount(codes, minlength=len(coded.dictionary))
        rows.append((order, np.cumsum(size) - size, size))
        sides.append(alike.Texts(coded.dictionary))
    a, b = sides
    left, right = keys["item"].combine_chunks(), entries["entry"].combine_chunks()
    for i, j in alike.candidates(a, b, share):
        scored = [score_from(a.texts[x], b.texts[y], threshold) for x, y in zip(i.tolist(), j.tolist())]
        kept = np.flatnonzero([score is not None for score in scored])
        scores = np.array([scored[k] for k in kept.tolist()], np.int64)
        for x, y, score in _expanded(i[kept], j[kept], scores, rows):
            yield pa.RecordBatch.from_arrays([left.take(pa.array(x)), right.take(pa.array(y)), pa.array(score)], names=names)


def _packed(rows: DataFrame, pieces: int) -> DataFrame:
    """(piece, pack): rows dealt in turn into pieces; those of a task and piece are packed once, however often they are sent."""

    def pack(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(tables)
        piece = pa.array(table["row"].to_numpy() % pieces, pa.int32())
        order = pc.sort_indices(pa.table({"piece": piece, "text": table["text"]}), [("piece", "ascending"), ("text", "ascending")])
        piece, table = piece.take(order).to_numpy(), table.drop_columns("row").take(order)
        starts = np.flatnonzero(np.diff(piece, prepend=-1))
        packs = []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(piece)]):
            sink = pa.BufferOutputStream()
            with pa.CompressedOutputStream(sink, "zstd") as out, pa.ipc.new_stream(out, table.schema) as writer:
                writer.write_table(table.slice(start, end - start).combine_chunks())
            packs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(piece[starts]), pa.array(packs, pa.binary())], names=["piece", "pack"])

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if len(batch):
                held, size = [*held, batch], size + batch.nbytes
            if size >= BLOCK_BYTES:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return rows.mapInArrow(packs, "piece int, pack binary")


def _unpacked(pack: pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(pa.CompressedInputStream(pa.BufferReader(pack), "zstd")).read_all()


def _by_blocks(keys: DataFrame, entries: DataFrame, sizes: list[int], share: float, threshold: int) -> DataFrame:
    """(item, entry, score): all rows (row, item, text) of two tables that score ``threshold`` or more.

    Rows are dealt in turn into chunks of keys and blocks of entries of bounded size. Every chunk meets every block in a task of its own.
    """

    def pieces(rows: DataFrame, size: int, most: int) -> int:
        letters = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        return max(1, ceil(size / most), ceil(letters / BLOCK_BYTES))

    chunks, blocks = pieces(keys, sizes[0], BLOCK_KEYS), pieces(entries, sizes[1], BLOCK_ENTRIES)
    # Smaller pieces where cores would be idle.
    finer = max(1.0, sqrt(4 * keys.sparkSession.sparkContext.defaultParallelism / (chunks * blocks)))
    chunks, blocks = ceil(chunks * finer), ceil(blocks * finer)

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = _packed(keys, chunks).select(F.lit(True).alias("is_key"), "pack", F.col("piece").alias("chunk"), every(blocks).alias("block"))
    right = _packed(entries.withColumnRenamed("item", "entry"), blocks).select(F.lit(False).alias("is_key"), "pack", F.col("piece").alias("block"), every(chunks).alias("chunk"))
    met = left.unionByName(right).select((F.col("chunk") * blocks + F.col("block")).alias("pair"), "is_key", "pack")
    names = ["item", "entry", "score"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, tuple[list[pa.Table], list[pa.Table]]] = {}
        for batch in batches:
            for pair, is_key, pack in zip(batch["pair"].to_pylist(), batch["is_key"].to_pylist(), batch["pack"]):
                parts.setdefault(pair, ([], []))[0 if is_key else 1].append(_unpacked(pack.as_buffer()))
        while parts:
            own = parts.popitem()[1]
            if all(own):
                yield from _met(pa.concat_tables(own[0]), pa.concat_tables(own[1]), share, threshold, names)

    kinds = [keys.schema["item"].dataType, entries.schema["item"].dataType, T.LongType()]
    # Costly tasks of few bytes: each pair of pieces is a task, whatever adaptive execution would merge.
    return met.repartitionById(chunks * blocks, F.col("pair")).mapInArrow(meet, T.StructType([T.StructField(n, kind) for n, kind in zip(names, kinds)]))


def _alike(classes: DataFrame, share: float) -> DataFrame:
    """(a, b): pairs whose letters can be alike enough, by pieces."""
    left = classes.where("side = 0").select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("letters").alias("ca"))
    right = classes.where("side = 1").select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("letters").alias("cb"))
    met = spread(_by_letters(classes, share).distinct()).join(left, "a").join(right, "b")
    return met.where(_enough_letters("ca", "cb", "na", "nb", F.lit(share))).select("a", "b")


def _share(threshold: int) -> float:
    return (threshold - 0.5) / 100  # scores are rounded


def similar_classes(keys: DataFrame, catalog: DataFrame, threshold: int) -> DataFrame:
    """(a, b, score) of the word classes (class, words) of two tables that score ``threshold`` or more."""
    share = _share(threshold)
    tagged = [t.groupBy("class").agg(F.first("words").alias("words")).withColumn("side", F.lit(side)) for side, t in enumerate((keys, catalog))]
    named = stored(
        tagged[0].unionByName(tagged[1]).withColumns({"n": _length(F.col("words")), "id": F.monotonically_increasing_id(), "letters": _letters("words")}), "classes"
    )
    classes = named.drop("class").withColumnRenamed("id", "class")
    pairs = spread(_by_words(classes, share).unionByName(_alike(classes, share)).distinct())
    left = named.where("side = 0").select(F.col("id").alias("a"), F.col("class").alias("key_class"), F.col("words").alias("wa"))
    right = named.where("side = 1").select(F.col("id").alias("b"), F.col("class").alias("entry_class"), F.col("words").alias("wb"))
    found = scored_pairs(pairs.join(left, "a").join(right, "b"), threshold)
    return found.select(F.col("key_class").alias("a"), F.col("entry_class").alias("b"), "score")


def _score_from(threshold: int):
    """Scores of pairs of texts (sorted distinct words joined by blanks); null below the threshold."""

    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in parts:
            yield pd.Series([score_from(a, b, threshold) for a, b in zip(left, right)], dtype="Int64")

    return pandas_udf(score, T.LongType())


def score_from(a: str, b: str, threshold: int) -> int | None:
    """Token-set score of two texts of distinct words if it is ``threshold`` or more; letters are
    aligned only where they can still raise the score that far."""
    left, right = set(a.split()), set(b.split())
    shared = left & right
    if shared and (len(shared) == len(left) or len(shared) == len(right)):
        return 100
    gap = 1 if shared else 0
    s = sum(map(len, shared)) + len(shared) - gap
    la, lb = (sum(map(len, words)) + len(words) - 1 - (s + gap) for words in (left, right))
    whole = 2 * (s + gap) + la + lb
    sides = max(100 - 100 * (gap + la) / (2 * s + gap + la), 100 - 100 * (gap + lb) / (2 * s + gap + lb)) if shared else 0.0
    if round(max(sides, 100 - 100 * abs(la - lb) / whole)) < threshold:
        return None
    common = common_length(" ".join(sorted(left - shared)), " ".join(sorted(right - shared)))
    best = round(max(sides, 100 - 100 * (la + lb - 2 * common) / whole))
    return best if best >= threshold else None


def scored_pairs(pairs: DataFrame, threshold: int) -> DataFrame:
    """Pairs of sorted distinct words (wa, wb) with ``score`` of ``threshold`` or more."""
    scored = pairs.withColumn("score", _score_from(threshold)(F.array_join("wa", " "), F.array_join("wb", " ")))
    return scored.where(F.col("score").isNotNull()).select(*pairs.columns, "score")


def similarity_join(keys: DataFrame, catalog: DataFrame, key: str, code: str, key_text: str, catalog_text: str, threshold: int) -> DataFrame:
    """(key, code, score) of every key and entry whose texts score ``threshold`` (1 to 100) or more.

    Texts that are null or without words match nothing. Rows that repeat a key or code count each.
    """
    if not 0 < threshold <= 100:
        raise ValueError("a filter join needs a threshold from 1 to 100")
    left, right = stored(word_rows(keys, key, key_text), "keys"), stored(word_rows(catalog, code, catalog_text), "entries")
    sizes = [left.count(), right.count()]
    if _many_candidates((left, right), sizes, _share(threshold)):
        found = _by_blocks(left, right, sizes, _share(threshold), threshold)
    else:
        left, right = word_classes(left), word_classes(right)
        classes = similar_classes(left, right, threshold)
        found = classes.join(left.select(F.col("class").alias("a"), "item"), "a").join(right.select(F.col("class").alias("b"), F.col("item").alias("entry")), "b")
    return found.select(F.col("item").alias(key), F.col("entry").alias(code), "score")

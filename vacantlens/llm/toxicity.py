"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed runs of 3 to 5 characters of it in lower case, white
space as one blank. Each is scaled by the log ratio of its smoothed shares in toxic and other
training rows; a logistic regression with an L2 penalty is fitted to the scaled features in
numpy in one task. The classifier is fitted on a bounded sample (``SAMPLE`` labelled rows, by
hash of their id); scoring is one pass over whole texts that ships only the weights.

Defined cases: a null or empty text has no feature and scores the fitted bias; a row without
label, or with a null one, trains nothing; a doc_id labelled both ways trains with each label;
without training rows of both labels every score is the smoothed share of the label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantlens.llm.columns import free_name
from vacantlens.llm.text import bounded_batches, mix
from vacantlens.session import ship, stored

SIZES = (3, 4, 5)
FEATURE_BITS = 18
#: Labelled rows the classifier is fitted on, at most.
SAMPLE = 4000
PIECE = 1 << 16
#: Training rows the fit works on at a time.
CHUNK = 128
THRESHOLD = 0.7

_SPACE = np.zeros(128, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WEIGHTS = mix(np.arange(11, 11 + max(SIZES), dtype=np.uint64)) | np.uint64(1)


def _codes(text: str) -> np.ndarray:
    """Code points in lower case with runs of blanks as one."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (codes < 128) & _SPACE[np.minimum(codes, 127)]
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return np.where(blank, np.uint32(32), codes)[keep].astype(np.uint64)


def _runs(codes: np.ndarray) -> np.ndarray:
    """Feature numbers of all runs in ``codes``, repeats included."""
    found = []
    sums = np.zeros(len(codes), np.uint64)
    for size in range(1, max(SIZES) + 1):
        n = len(codes) - size + 1
        if n <= 0:
            break
        sums = sums[:n] + codes[size - 1 :] * _WEIGHTS[size - 1]
        if size in SIZES:
            found.append(((sums * np.uint64(0x9E3779B97F4A7C15 + 2 * size)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


class Features:
    """Distinct features of one text after another, in pieces of bounded size. Every feature
    remembers where it was last seen, so no table is cleared between texts."""

    def __init__(self) -> None:
        self.seen = np.full(1 << FEATURE_BITS, -1, np.int64)
        self.clock = 0

    def pieces(self, text: str) -> Iterator[np.ndarray]:
        began = self.clock
        codes = _codes(text)
        for at in range(0, max(len(codes), 1), PIECE):
            runs = _runs(codes[at : at + PIECE + max(SIZES) - 1])
            fresh = runs[self.seen[runs] < began]
            self.seen[fresh] = np.arange(self.clock, self.clock + len(fresh))
            own = fresh[self.seen[fresh] == np.arange(self.clock, self.clock + len(fresh))]
            self.clock += len(fresh)
            yield own

    def of(self, text: str) -> np.ndarray:
        return np.concatenate(list(self.pieces(text)))


def fit(parts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, penalty: float = 0.02, rounds: int = 80) -> tuple[np.ndarray, float]:
    """(weight of every feature, bias) of rows given in parts: (features of all its rows in turn, how many each has).
    Scaled features are divided by the root of how many a text has, so long texts do not saturate."""
    size = 1 << FEATURE_BITS
    positive = float((labels == 1).sum())
    bias = float(np.log((positive + 1) / (len(labels) - positive + 1)))
    if not len(labels) or positive in (0, len(labels)):
        return np.zeros(size, np.float32), bias
    # Rows are worked on a part at a time: no array of all features of all rows as floats.
    counts = np.concatenate([own for _, own in parts])
    starts = np.cumsum([0, *[len(own) for _, own in parts]])

    def score(w: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(labels))
        for at, (index, own) in zip(starts, parts):
            sums[at : at + len(own)] = np.where(own > 0, np.add.reduceat(np.append(w[index], 0.0), np.cumsum(own) - own), 0)
        return sums * norm

    def by_feature(values: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for at, (index, own) in zip(starts, parts):
            out += np.bincount(index, np.repeat(values[at : at + len(own)], own), size)
        return out

    p = by_feature((labels == 1).astype(float)) + 1
    q = by_feature((labels == 0).astype(float)) + 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    norm = 1 / np.sqrt(np.maximum(counts, 1))
    weight, momentum, moment = np.zeros(size), np.zeros(size), np.zeros(size)
    target = (labels == 1).astype(float)
    for t in range(1, rounds + 1):  # Adam on the full batch
        wrong = 1 / (1 + np.exp(-(score(weight * ratio) + bias))) - target
        slope = by_feature(wrong * norm) * ratio / len(labels) + penalty * weight / len(labels)
        momentum = 0.9 * momentum + 0.1 * slope
        moment = 0.99 * moment + 0.01 * slope**2
        weight -= 0.2 * (momentum / (1 - 0.9**t)) / (np.sqrt(moment / (1 - 0.99**t)) + 1e-9)
        bias -= 0.2 * float(wrong.mean())
    return (weight * ratio).astype(np.float32), bias


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit on at most ``sample`` labelled rows of (doc_id, ``label``), the lowest by hash."""
    spark = bounded_batches(ship(docs.sparkSession))
    # A sample of bounded size: its ids are broadcast, its features go to one task.
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
        .distinct()
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(sample)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "_label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [np.sort(features.of(t or "")).astype(np.int32).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "label", "features"])

    rows = texts.mapInArrow(run, "doc_id long, label int, features binary")
    # Rows are ordered and cut by narrow columns: only the features of chosen rows go to the task that fits, once.
    once = stored(rows.dropDuplicates(["doc_id", "label", "features"]), "features")
    place = [F.xxhash64("doc_id", "label"), F.col("doc_id"), F.col("label"), F.xxhash64("features")]
    if once.count() > sample:
        last = once.select(F.struct(*place).alias("place")).orderBy("place").limit(sample).agg(F.max("place").alias("last"))
        once = once.join(F.broadcast(last), F.struct(*place) <= F.col("last")).drop("last")  # one row
    found = once.select("label", "features").repartition(1).mapInArrow(_fitted, "weights binary, bias double").first()
    return (np.frombuffer(found["weights"], np.float32), found["bias"]) if found else fit([], np.zeros(0, np.int64))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(weights, bias) of all rows (label, features) of the task; the driver holds none of them."""
    held = [batch for batch in batches if batch.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        weights, bias = fit(_parts(table), table.column("label").to_numpy().astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["weights", "bias"])


def _parts(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """The features as they lie in the table's buffers, CHUNK rows at a time."""
    out = []
    for batch in table.to_batches(max_chunksize=CHUNK):
        column = batch.column(batch.schema.get_field_index("features"))
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        index = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.int32) if ends[-1] > ends[0] else np.zeros(0, np.int32)
        out.append((index, np.diff(ends) // 4))
    return out


def scored(docs: DataFrame, model: tuple[np.ndarray, float], columns: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """``columns`` of every row with ``name``, the probability of label 1 for its whole text."""
    spark = bounded_batches(ship(docs.sparkSession))
    shipped = spark.sparkContext.broadcast(model)
    schema = docs.select(*columns).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shipped.value
        features = Features()
        for batch in batches:
            scores = []
            for value in batch.column(0).to_pylist():
                total, count = 0.0, 0
                for own in features.pieces(value or ""):
                    total += float(weights[own].sum(dtype=np.float64))
                    count += len(own)
                scores.append(1 / (1 + np.exp(-(total / np.sqrt(max(count, 1)) + bias))))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], names=[*columns, name])

    return docs.select(F.col(text).alias(free_name("_scored_text", columns)), *columns).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows never used to learn: the CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))

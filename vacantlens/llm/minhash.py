"""Near-duplicate documents by min-max hashing.

Every permutation of the shingle space gives two signature values, its minimum and its
maximum, so a signature of 2K values costs K hash evaluations per shingle. Both extremes agree
with probability equal to the Jaccard similarity, and their joint estimate varies less than that
of two independent minima. Bands of ``ROWS`` values put documents into buckets.

Links are confirmed on full shingle sets. No bucket emits its pairs:

1. Documents with the same word sequence form one class (map-side combine, any group size).
2. Every class is compared with ``HUBS`` hubs per bucket, drawn by hash for each bucket anew.
3. Buckets whose members are still in several components hold every link not yet found. There,
   each class outside the bucket's largest component meets all others by an exact join on its
   rarest shingles: sets with a similarity of t or more share one of the first
   n - ceil(t n) + 1 shingles in order of rising frequency, at places that leave room for the
   overlap they need.

Defined cases: a null or wordless text has no shingle, links with nothing and is kept; a row
without doc_id links with nothing, gets a null component and is kept; rows that share a doc_id
are one node, so all of them carry one component; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vacantlens.llm.columns import free_name
from vacantlens.llm.graph import components
from vacantlens.llm.text import bounded_batches, distinct_per_text, mix, shingle_hashes, utf8, word_hashes
from vacantlens.session import ship, stored

BANDS, ROWS = 24, 4
PERMUTATIONS = BANDS * ROWS // 2
#: Hubs drawn per bucket.
HUBS = 2
#: Sketch agreement below which a pair of bucket mates is not confirmed on full sets: 0.2 under
#: the 0.8 threshold, five standard deviations of the estimate over 2 * PERMUTATIONS values.
SKETCH_MARGIN = 20

_MULTIPLY = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1001, PERMUTATIONS + 1001, dtype=np.uint64))


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """2K signature values of every set: K minima, then K maxima. All sets must be non-empty."""
    out = np.empty((len(counts), 2 * PERMUTATIONS), np.uint64)
    starts = np.cumsum(counts) - counts
    for k in range(PERMUTATIONS):
        hashed = values * _MULTIPLY[k] + _ADD[k]
        out[:, k] = np.minimum.reduceat(hashed, starts)
        out[:, PERMUTATIONS + k] = np.maximum.reduceat(hashed, starts)
    return out


def bands_of(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; half of a band's values are minima, half maxima."""
    half = ROWS // 2
    parts = np.concatenate(
        [signature[:, :PERMUTATIONS].reshape(-1, BANDS, half), signature[:, PERMUTATIONS:].reshape(-1, BANDS, half)], axis=2
    )
    keys = np.tile(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(signature), 1))
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys


def _lists(values: np.ndarray, per_row: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _described(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for first, counts, words in word_hashes(data, offsets):
                ends = np.cumsum(counts)
                weighted = words * mix(np.arange(1, len(words) + 1, dtype=np.uint64) - np.repeat(ends - counts, counts).astype(np.uint64))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)])
                second = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(weighted), dtype=np.uint64)])
                values, sizes = distinct_per_text(*shingle_hashes(words, counts, shingle))
                some = sizes > 0
                bands = np.zeros((len(counts), BANDS), np.uint64)
                sketch = np.zeros((len(counts), 2 * PERMUTATIONS), np.uint16)
                if some.any():
                    signature = signatures(values, sizes[some])
                    bands[some] = bands_of(signature)
                    sketch[some] = mix(signature).astype(np.uint16)
                rows = some.astype(np.int64) * BANDS
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(counts)),
                        pa.array((sums[ends] - sums[ends - counts]).view(np.int64)),
                        pa.array((second[ends] - second[ends - counts]).view(np.int64)),
                        pa.array(sizes.astype(np.int64)),
                        _lists(bands[some].ravel().view(np.int64), rows),
                        pa.array([row.tobytes() for row in sketch], pa.binary()),
                    ],
                    names=["doc_id", "_k1", "_k2", "n_shingles", "_bands", "_sketch"],
                )

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for first, counts, words in word_hashes(data, offsets):
                values, sizes = distinct_per_text(*shingle_hashes(words, counts, shingle))
                values = values.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(counts)),
                        pa.array([own.tobytes() for own in np.split(values, np.cumsum(sizes)[:-1])], pa.binary()),
                    ],
                    names=["id", "set"],
                )

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                a = np.frombuffer(left.as_buffer(), np.int64)
                b = np.frombuffer(right.as_buffer(), np.int64)
                both = np.concatenate([a, b])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return run


def _agreeing(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, 2 * PERMUTATIONS) for k in (2, 3))
        keep = (left == right).mean(axis=1) >= least
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])


def _pairs_with(pairs: DataFrame, side: DataFrame, column: str) -> DataFrame:
    """(a, b, _left, _right) with the given column of both ends."""
    left = side.select(F.col("id").alias("a"), F.col(column).alias("_left"))
    right = side.select(F.col("id").alias("b"), F.col(column).alias("_right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "_left", "_right")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, comp, minor, set) to a row (id, comp, minor, n, s) per shingle."""
    for batch in batches:
        own = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(3)]
        sizes = np.array([len(v) for v in own], np.int64)
        owner = np.repeat(np.arange(len(own)), sizes)
        kept = [batch.column(k).take(pa.array(owner)) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes[owner]), pa.array(np.concatenate([*own, np.zeros(0, np.int64)]))], names=["id", "comp", "minor", "n", "s"])


def _rare_pairs(pool: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``pool`` (id, comp, minor) in different components, one of them minor,
    that share one of their rarest shingles early enough: what comes before the first shared
    shingle on either side is not shared, so its place bounds the overlap. Holds every such pair
    at the threshold or above."""
    items = pool.join(sets, "id").select("id", "comp", "minor", "set").mapInArrow(_unpacked, "id long, comp long, minor boolean, n long, s long")
    frequency = items.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    ranked = items.join(frequency, "s").withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("df", "s")))
    first = F.col("n") - F.floor((F.lit(percent) * F.col("n") + 99) / 100) + 1
    rare = stored(ranked.where(F.col("place") <= first).select("id", "comp", "minor", "n", "s", "place"), "rare")
    own = rare.where("minor").select(F.col("id").alias("a"), F.col("comp").alias("_ca"), F.col("n").alias("_na"), F.col("place").alias("_pa"), "s")
    other = rare.select(F.col("id").alias("b"), F.col("comp").alias("_cb"), F.col("minor").alias("_mb"), F.col("n").alias("_nb"), F.col("place").alias("_pb"), "s")
    overlap = 1 + F.least(F.col("_na") - F.col("_pa"), F.col("_nb") - F.col("_pb"))
    enough = (F.lit(100 + percent) * overlap >= F.lit(percent) * (F.col("_na") + F.col("_nb"))) & (F.lit(100) * F.least("_na", "_nb") >= F.lit(percent) * F.greatest("_na", "_nb"))
    apart = (F.col("_ca") != F.col("_cb")) & (~F.col("_mb") | (F.col("a") < F.col("b")))
    return own.alias("x").join(other.alias("y"), (F.col("x.s") == F.col("y.s")) & apart & enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's doc_id with n_shingles, component_id and kept.

    Two documents are linked when 100 * |A and B| >= percent * |A or B| over their distinct
    shingles; a component is what links reach, named by its smallest doc_id.
    """
    spark = bounded_batches(ship(docs.sparkSession))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, _k1 long, _k2 long, n_shingles long, _bands array<long>, _sketch binary"
    described = stored(texts.mapInArrow(_described(shingle), schema), "described")
    classes = (
        described.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        .groupBy("_k1", "_k2")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("_bands").alias("_bands"), F.first("_sketch").alias("_sketch"))
    )
    classes = stored(classes, "classes")
    # One row per class and band; only buckets of several classes go on.
    entries = classes.select(F.explode("_bands").alias("key"), "id", "n")
    drawn = [F.min(F.struct(F.xxhash64("id", "key", F.lit(k)).alias("draw"), F.col("id"), F.col("n"))).alias(f"hub{k}") for k in range(HUBS)]
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *drawn).where("size > 1")
    hubs = F.array_distinct(F.array(*[F.struct(F.col(f"hub{k}.id").alias("id"), F.col(f"hub{k}.n").alias("n")) for k in range(HUBS)]))
    members = stored(entries.join(buckets, "key").select("key", "id", "n", hubs.alias("hubs")), "members")
    met = members.select("id", "n", F.explode("hubs").alias("hub"))
    fits = (F.lit(100) * F.least("n", "hub.n") >= F.lit(percent) * F.greatest("n", "hub.n")) & (F.col("id") != F.col("hub.id"))
    pairs = met.where(fits).select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()
    least = (percent - SKETCH_MARGIN) / 100
    sketched = _pairs_with(pairs, classes.select("id", F.col("_sketch")), "_sketch")
    likely = sketched.mapInArrow(lambda batches: _agreeing(batches, least), "a long, b long")
    active = members.select("id").distinct()
    sets = stored(
        texts.join(active.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
        .withColumn("_h", F.xxhash64("text"))
        .dropDuplicates(["doc_id", "_h"])
        .select("doc_id", "text")
        .mapInArrow(_sets(shingle), "id long, set binary"),
        "sets",
    )
    links = stored(_pairs_with(likely, sets, "set").mapInArrow(_confirmed(percent), "a long, b long"), "links")
    found = components(links)
    # Where a bucket's members are still apart, every remaining link has an end outside its
    # largest component.
    sized = found.join(found.groupBy("component").agg(F.count(F.lit(1)).alias("weight")), "component")
    placed = members.join(sized, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"), F.coalesce("weight", F.lit(1)).alias("weight"))
    apart = placed.groupBy("key").agg(F.max(F.struct("weight", "comp")).alias("major"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high")
    residue = stored(placed.join(apart.select("key", F.col("major.comp").alias("major")), "key").select("id", "comp", (F.col("comp") != F.col("major")).alias("minor")).groupBy("id", "comp").agg(F.max("minor").alias("minor")), "residue")
    late = _pairs_with(_rare_pairs(residue, sets, percent), sets, "set")
    more = stored(late.mapInArrow(_confirmed(percent), "a long, b long"), "late")
    # The components found so far stand for their links.
    reached = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = classes.select("_k1", "_k2", "id").join(reached, "id", "left").select("_k1", "_k2", F.coalesce("component", "id").alias("_named"))
    lonely = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = described.select("doc_id", "_k1", "_k2", "n_shingles")
    linked = out.where(~lonely).join(named, ["_k1", "_k2"]).select("doc_id", "n_shingles", F.col("_named").alias("component_id"))
    alone = out.where(lonely).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all their columns, of which one per component stays.

    Rows that repeat a doc_id and its text are copies too: one of them stays. Rows that share a doc_id
    but not their text are judged by their doc_id and stay or go together.
    """
    verdict = near_duplicates(docs, shingle, percent)
    gone = verdict.where(~F.col("kept")).select("doc_id").distinct()
    # The digest is a column of the rows' own: names of documents stay apart from it.
    known = docs.where(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti")
    digest = free_name("_digest", docs.columns)
    once = known.withColumn(digest, F.sha2("text", 256)).dropDuplicates(["doc_id", digest])
    return once.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))

"""Best entries by cosine without scoring all pairs: exact, with blocks skipped on proof.

Some catalog vectors, drawn by a hash, are pivots; every entry belongs to its nearest one, and each
such cluster knows its least and largest angle to its pivot. A key's angle to a cluster's entries is then at
least what the triangle inequality leaves of its angle to the pivot, so a cluster whose best possible score is
below what a key already has cannot matter to it:

1. a key is scored against its nearest clusters, as many as hold ``k`` entries;
2. its k-th score there is its bar, and it meets only further clusters that could reach it.

Small clusters of a level share a block. A key is one row, with a bit per cluster it asks for, and is sent once to each
block that holds one of them, so what is written grows with the blocks and not with the clusters.
Keys and blocks meet in pieces of bounded size, so neither a block nor the keys that ask for
it are ever one task's work. Pivots and cluster figures are at most ``MAX_PIVOTS`` per level and all that is
sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantlens.operators.scoring import as_matrix
from vacantlens.session import stored

MAX_PIVOTS = 256
#: Most bytes of the vectors of a piece.
PIECE_BYTES = 64 << 20
#: Angles are rounded; a bound this much too low never skips a pair that counts.
_SLACK = 1e-6


def _unit(vectors: list, width: int) -> np.ndarray:
    matrix = as_matrix(vectors, width)
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def _angles(vectors: list, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(vectors, pivots.shape[1]) @ pivots.T, -1, 1))


def _clustered(catalog: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds each entry's _cluster and its _angle to the pivot; no direction, no angle: cluster -1."""
    schema = T.StructType([*catalog.schema.fields, T.StructField("_cluster", T.IntegerType()), T.StructField("_angle", T.DoubleType())])

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            angles = _angles(list(batch["_vector"]), pivots)
            none = ~as_matrix(list(batch["_vector"]), pivots.shape[1]).any(axis=1)
            cluster = np.where(none, -1, angles.argmin(axis=1)).astype(np.int32)
            yield batch.assign(_cluster=cluster, _angle=angles.min(axis=1))

    return stored(catalog.mapInPandas(nearest, schema), "clustered")


def _best_possible(angles: np.ndarray, figures: pd.DataFrame) -> np.ndarray:
    """By key and cluster: the largest score the cluster's entries could have."""
    own = angles[:, figures["_cluster"].to_numpy().clip(0)]
    least = np.maximum(own - figures["high"].to_numpy(), figures["low"].to_numpy() - own)
    best = np.trunc(100 * (np.cos(np.maximum(least, 0)) + _SLACK))
    best[:, figures["_cluster"].to_numpy() < 0] = 0  # a zero vector scores 0 with all
    return best


def _in_blocks(figures: pd.DataFrame, rows: int) -> pd.DataFrame:
    """Adds _block: clusters of a level in the order given, as many as hold ``rows`` entries; and _of, the pieces of a block."""
    blocks, block, held, level = [], -1, 0, None
    for own, n in zip(figures["_level"], figures["n"]):
        if block < 0 or own != level or held + n > rows:
            block, held, level = block + 1, 0, own
        held += n
        blocks.append(block)
    out = figures.assign(_block=np.array(blocks, np.int32))
    return out.assign(_of=np.ceil(out.groupby("_block")["n"].transform("sum") / rows).astype(np.int32))


def _asked(part: pd.DataFrame, wanted: np.ndarray, own: pd.DataFrame, bars: np.ndarray) -> pd.DataFrame:
    """The keys that want a cluster of their level, with the bits of those clusters and the blocks that hold them."""
    bits = np.zeros((len(part), MAX_PIVOTS + 8), bool)
    bits[:, own["_cluster"].to_numpy() + 1] = wanted
    blocks = own["_block"].to_numpy()
    asks = [np.unique(blocks[row]) for row in wanted]
    out = part.assign(_wanted=[row.tobytes() for row in np.packbits(bits, axis=1)], _blocks=asks, _bar=bars, _n=wanted.sum(axis=1))
    return out[wanted.any(axis=1)]


def _asking(keys: DataFrame) -> T.StructType:
    own = [f for f in keys.schema.fields if f.name in ("_key", "_vector", "_level")]
    return T.StructType([*own, *[
        T.StructField("_wanted", T.BinaryType()), T.StructField("_blocks", T.ArrayType(T.IntegerType())),
        T.StructField("_bar", T.LongType()), T.StructField("_n", T.LongType()),
    ]])


def _nearest_clusters(keys: DataFrame, pivots: np.ndarray, figures: pd.DataFrame, k: int, threshold: int) -> DataFrame:
    """A key asks for the nearest clusters of its level, as many as hold ``k`` entries."""
    schema = _asking(keys)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_level = dict(list(figures.groupby("_level")))
        for batch in batches:
            for level, part in batch.groupby("_level"):
                if level not in by_level:
                    continue
                own = by_level[level]
                order = np.argsort(-_best_possible(_angles(list(part["_vector"]), pivots), own), axis=1, kind="stable")
                held = np.cumsum(own["n"].to_numpy()[order], axis=1)
                # All before the one that makes k, and it.
                first = np.concatenate([np.ones((len(part), 1), bool), held[:, :-1] < k], axis=1)
                wanted = np.zeros_like(first)
                np.put_along_axis(wanted, order, first, axis=1)
                yield _asked(part, wanted, own, np.full(len(part), threshold))[schema.names]

    return keys.mapInPandas(route, schema)


def _further_clusters(keys: DataFrame, pivots: np.ndarray, figures: pd.DataFrame) -> DataFrame:
    """A key asks for each other cluster that could reach its bar; ``keys`` have asked before."""
    schema = _asking(keys)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_level = dict(list(figures.groupby("_level")))
        for batch in batches:
            for level, part in batch.groupby("_level"):
                own, bars = by_level[level], part["_bar"].to_numpy()
                wanted = _best_possible(_angles(list(part["_vector"]), pivots), own) >= bars[:, None]
                yield _asked(part, wanted & ~_bits(part)[:, own["_cluster"].to_numpy() + 1], own, bars)[schema.names]

    return keys.mapInPandas(route, schema)


def _bits(part: pd.DataFrame) -> np.ndarray:
    """By key and cluster (from -1 on): whether it is asked for."""
    packed = np.frombuffer(b"".join(part["_wanted"]), np.uint8).reshape(len(part), -1)
    return np.unpackbits(packed, axis=1).astype(bool)


def _top(cosines: np.ndarray, bars: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(key, entry, score) of the best ``k`` entries of each key that reach its bar; ties go to the earlier entry.

    Scores are those of ``Catalog.cosines``; only what could be among the best is rounded.
    """
    if cosines.shape[1] > k:
        kth = np.partition(cosines, cosines.shape[1] - k, axis=1)[:, cosines.shape[1] - k]
        bars = np.maximum(bars, np.trunc(100 * np.round(kth, 9)))
    rows, places = np.nonzero(cosines >= ((bars - (bars <= 0)) / 100 - 1e-8)[:, None])
    scores = np.trunc(100 * np.round(cosines[rows, places], 9)).astype(np.int64)
    order = np.lexsort((places, -scores, rows))
    rows, places, scores = rows[order], places[order], scores[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    kept = (nth < k) & (scores >= bars[rows])
    yield from zip(rows[kept].tolist(), places[kept].tolist(), scores[kept].tolist())


def _scored(asked: DataFrame, entries: DataFrame, k: int, rows: int, schema: T.StructType) -> DataFrame:
    """The best ``k`` entries in each cluster that a key asks for, in pieces of at most about ``rows`` rows."""
    group = ["_level", "_block"]
    meets = asked.withColumn("_block", F.explode("_blocks"))
    key_pieces = meets.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_keys"))
    both = key_pieces.join(entries.groupBy(*group).agg(F.first("_of").alias("_entries")), group)
    left = meets.drop("_blocks", "_n").join(both, group).withColumn("_kp", F.pmod(F.xxhash64("_key"), F.col("_keys")).cast("int")).withColumn(
        "_ep", F.explode(F.sequence(F.lit(0), F.col("_entries") - 1))
    ).drop("_keys", "_entries")
    same = both.select(*group, F.col("_keys").alias("_key_pieces"))
    right = entries.join(same, group).withColumn("_ep", F.pmod(F.xxhash64("_code", "_position"), F.col("_of")).cast("int")).withColumn(
        "_kp", F.explode(F.sequence(F.lit(0), F.col("_key_pieces") - 1))
    ).drop("_of", "_key_pieces")
    cell = [*group, "_kp", "_ep"]
    names = [*[f.name for f in schema.fields], "_level"]

    def score(key_part: pd.DataFrame, entry_part: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(key_part) and len(entry_part):
            width = max((len(v) for v in entry_part["_vector"] if v is not None), default=0)
            level, bits, keys = key_part["_level"].iloc[0], _bits(key_part), key_part["_key"].tolist()
            units, bars = _unit(list(key_part["_vector"]), width), key_part["_bar"].to_numpy()
            entry_part = entry_part.sort_values(["_position", "_code"], kind="stable")
            for cluster, part in entry_part.groupby("_cluster"):
                vectors, codes, positions = _unit(list(part["_vector"]), width), part["_code"].tolist(), part["_position"].tolist()
                asking = np.flatnonzero(bits[:, cluster + 1])
                for start in range(0, len(asking), 512):
                    at = asking[start : start + 512]
                    for row, i, sem in _top(units[at] @ vectors.T, bars[at], k):
                        out.append((keys[at[row]], codes[i], positions[i], sem, 0, sem, level))
        return pd.DataFrame(out, columns=names)

    full = T.StructType([*schema.fields, T.StructField("_level", T.StringType())])
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(score, full)


def pruned_cosine(
    keys: DataFrame, catalog: DataFrame, schema: T.StructType, k: int, threshold: int, rows: int, report: dict | None = None
) -> DataFrame:
    """The best ``k`` entries of each key and level, and some worse ones, as rows of ``schema``.

    ``keys`` have _key, _vector, _level, ``catalog`` _code, _position, _vector, _level. ``report`` gets how many
    (key, cluster) pairs there are and how many were met.
    """
    names = ["_key", "_vector", "_level"]
    keys, catalog = keys.select(*names), catalog.select("_code", "_position", "_vector", "_level")
    # A row of the catalog is counted before; the drawn ones are few.
    total = catalog.count()
    drawn = catalog.where(F.exists("_vector", lambda x: x != 0)).orderBy(F.xxhash64("_code", "_level")).limit(min(MAX_PIVOTS, max(8, ceil(sqrt(total))))).collect()
    width = max((len(r["_vector"]) for r in drawn), default=1)
    pivots = _unit([r["_vector"] for r in drawn], width) if drawn else np.zeros((1, width))
    rows = max(1, min(rows, PIECE_BYTES // (8 * max(width, 1))))
    entries = _clustered(catalog, pivots)
    figures = entries.groupBy("_level", "_cluster").agg(F.count(F.lit(1)).alias("n"), F.min("_angle").alias("low"), F.max("_angle").alias("high")).toPandas()
    figures = _in_blocks(figures.sort_values(["_level", "_cluster"], ignore_index=True), rows)
    placed = keys.sparkSession.createDataFrame(
        figures[["_level", "_cluster", "_block", "_of"]].values.tolist(), "_level string, _cluster int, _block int, _of int"
    )
    entries = entries.drop("_angle").join(placed, ["_level", "_cluster"])
    asked = stored(_nearest_clusters(keys, pivots, figures, k, threshold), "asked")
    first = stored(_scored(asked, entries, k, rows, schema), "nearest")
    # A key's bar in a level is its k-th score there, or the threshold.
    place = F.row_number().over(W.partitionBy("_key", "_level").orderBy(F.desc("best_confidence")))
    bars = first.withColumn("_place", place).where(F.col("_place") == k).select("_key", "_level", F.col("best_confidence").alias("_kth"))
    waiting = asked.join(bars, ["_key", "_level"], "left").withColumn("_bar", F.greatest("_bar", "_kth"))
    more = stored(_further_clusters(waiting.select(*names, "_wanted", "_bar"), pivots, figures), "further")
    if report is not None:
        levels = figures.groupby("_level").size().to_dict()
        report["all"] = sum(levels.get(r["_level"], 0) * r["count"] for r in keys.groupBy("_level").count().collect())
        report["met"] = sum(df.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0] for df in (asked, more))
        report["rows"] = sum(df.agg(F.coalesce(F.sum(F.size("_blocks")), F.lit(0))).first()[0] for df in (asked, more))
    found = first.unionByName(_scored(more, entries, k, rows, schema))
    return found.select(*[f.name for f in schema.fields])

"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors become integers floor(64 x). A shard of the index holds its vectors' components as
posting segments by descending quantised impact: segment 0 has the components of the largest
absolute value, the last those near zero, each a list of (vector, impact) per dimension.
A block of queries adds the postings of a shard segment by segment to integer accumulators. After each, what the segments to come
can still add to a vector is bounded by the product of the norms of the query and of the
vector's unprocessed components. Processing stops for a query only on proof, when few vectors can
still be among its k best; those are scored again from the shard's vectors, exactly.

Queries meet shards in a grid of blocks; every cell is a task's group of bounded size, and
gives k rows per query that are merged by (score, smaller vec_id).

Defined cases: vectors that are null, empty or hold null or non-finite components take no part;
rows that repeat a vec_id count once, with the smallest of its vectors; vectors of another
length than the most common one take no part; a component beyond 2^56 counts as 2^56 and a score
beyond 63 bits as the largest of 63 bits, with their signs; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantlens.session import ship, stored

SCALE = 64
#: Largest size of a component, of a score.
WIDEST, LARGEST = float(1 << 56), (1 << 63) - 1
#: Vectors per index shard, queries per block.
SHARD, QUERIES = 8192, 1024
#: Least absolute impacts of the segments, descending; the last takes the rest.
EDGES = (16, 8, 4, 0)
#: A query's shard is finished by exact scores when at most this share of it can be among the best.
FEW = 0.02


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): one row per vec_id with its integer components."""
    wide = F.lit(WIDEST)
    v = F.transform(F.col(embedding), lambda x: F.floor(F.lit(float(scale)) * F.greatest(-wide, F.least(x.cast("double"), wide))).cast("long"))
    whole = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & (F.size(F.col(embedding)) > 0)).where(whole)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def segments(matrix: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Posting segments of a shard (vectors x dimensions) by descending impact: (vector,
    dimension, impact) of the components between two edges, a list of vectors per dimension."""
    out, above = [], np.zeros(matrix.shape, bool)
    size = np.abs(matrix)
    for edge in EDGES:
        part = (size >= edge) & ~above & (matrix != 0)
        above |= part
        dims, rows = np.nonzero(part.T)
        out.append((rows.astype(np.int32), dims.astype(np.int16), matrix[rows, dims]))
    return out


def _rest(parts, n: int) -> list[np.ndarray]:
    """After each segment, the norm of every vector's components in the segments to come, rounded up."""
    out, squares = [], np.zeros(n)
    for rows, _, impact in reversed(parts):
        out.append(np.sqrt(squares) * (1 + 1e-9))
        squares = squares + np.bincount(rows, impact.astype(float) ** 2, n)
    return out[::-1]


def search(queries: np.ndarray, query_ids: np.ndarray, parts, forward: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of the k best of a shard for every query, ties to the
    smaller id, the query's own id left out. ``forward`` holds the shard's vectors."""
    n, dims = forward.shape
    largest = max((int(np.abs(p[2]).max()) for p in parts if len(p[2])), default=0) * int(np.abs(queries).max(initial=0)) * dims
    if largest >= 1 << 52:  # the bounds are floating point
        return _in_full(queries, query_ids, forward, ids, k)
    # Integer accumulators, a row per vector and a column per query still open.
    number = np.int32 if largest < 1 << 31 else np.int64
    scores = np.zeros((n, len(queries)), number)
    asked = np.ascontiguousarray(queries.T.astype(number))
    norms = np.sqrt((queries.astype(float) ** 2).sum(axis=1)) * (1 + 1e-9)
    place = np.argsort(ids, kind="stable")
    at = np.minimum(np.searchsorted(ids, query_ids, sorter=place), n - 1)
    own = np.where(ids[place[at]] == query_ids, place[at], -1)
    open_rows = np.arange(len(queries))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for step, ((rows, d, impact), rest) in enumerate(zip(parts, _rest(parts, n))):
        impact = impact.astype(number)
        ends = np.searchsorted(d, np.arange(dims + 1))
        for dim in np.flatnonzero(np.diff(ends)):
            listed = slice(ends[dim], ends[dim + 1])
            scores[rows[listed]] += impact[listed, None] * asked[dim]
        if step == len(parts) - 1:
            for row, whole in zip(open_rows, np.ascontiguousarray(scores.T)):
                others = np.delete(np.arange(n), own[row]) if own[row] >= 0 else np.arange(n)
                if len(others):
                    best = others[_best(whole[others], ids[others], min(k, len(others)))]
                    found.append((np.full(len(best), row), best, whole[best].astype(np.int64)))
            break
        slack = rest[:, None] * norms[open_rows]
        low = scores - slack
        has_own = np.flatnonzero(own[open_rows] >= 0)
        low[own[open_rows][has_own], has_own] = -np.inf
        take = min(k, n)
        # The k-th largest lower bound: whatever cannot reach it is out for certain.
        possible = scores + slack >= np.partition(low, n - take, axis=0)[n - take] - 0.5
        possible[own[open_rows][has_own], has_own] = False
        few = possible.sum(axis=0) <= max(FEW * n, 2 * take)
        for i in np.flatnonzero(few):
            row, members = open_rows[i], np.flatnonzero(possible[:, i])
            if len(members):
                exact = forward[members] @ queries[row]
                best = _best(exact, ids[members], min(k, len(members)))
                found.append((np.full(len(best), row), members[best], exact[best]))
        if few.all():
            break
        if few.any():  # a row per vector in memory, too
            open_rows, scores, asked = open_rows[~few], np.ascontiguousarray(scores[:, ~few]), np.ascontiguousarray(asked[:, ~few])
    if not found:
        return (np.zeros(0, np.int64),) * 3
    row, vector, score = (np.concatenate(x) for x in zip(*found))
    return row, vector, score


def _in_full(queries: np.ndarray, query_ids: np.ndarray, forward: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components in 64-bit integers, those of vectors that may pass them in whole numbers."""
    found = []
    dims = forward.shape[1]
    sizes = np.abs(forward).max(axis=1)
    for row, (query, own) in enumerate(zip(queries, query_ids)):
        others = np.flatnonzero(ids != own)
        scores = forward[others] @ query
        most = int(np.abs(query).max()) * dims
        wide = np.flatnonzero(sizes[others] > ((1 << 62) // most if most else 1 << 62))
        exact = {int(i): sum(int(x) * int(y) for x, y in zip(forward[others[i]], query)) for i in wide}
        for i, value in exact.items():
            scores[i] = min(max(value, -LARGEST), LARGEST)
        best = np.lexsort((ids[others], -scores))[:k]
        found.append((np.full(len(best), row), others[best], scores[best]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _best(scores: np.ndarray, ids: np.ndarray, take: int) -> np.ndarray:
    """Places of the ``take`` best by (score, smaller id)."""
    edge = np.partition(scores, len(scores) - take)[len(scores) - take]
    places = np.flatnonzero(scores >= edge)
    return places[np.lexsort((ids[places], -scores[places].astype(np.int64)))[:take]]


def _packed(name: str):
    """Group function: the vectors of a block as one row of bytes."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        matrix = np.vstack(rows["v"].to_numpy()).astype(np.int64)
        return pd.DataFrame({name: [key[0]], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "data": [matrix.tobytes()]})

    return run


def _indexed(key, rows: pd.DataFrame) -> pd.DataFrame:
    matrix = np.vstack(rows["v"].to_numpy()).astype(np.int64)
    parts = segments(matrix)
    return pd.DataFrame(
        {
            "shard": key[0],
            "segment": np.arange(len(parts), dtype=np.int32),
            "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()] + [b""] * (len(parts) - 1),
            "forward": [matrix.tobytes()] + [b""] * (len(parts) - 1),
            "vectors": [p[0].tobytes() for p in parts],
            "dims": [p[1].tobytes() for p in parts],
            "impacts": [p[2].astype(np.int64).tobytes() for p in parts],
        }
    )


def _dealt(vectors: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """The vectors with the number of their block, and how many blocks there are."""
    blocks = max(1, -(-vectors.count() // size))
    return vectors.withColumn(name, F.pmod(F.xxhash64(F.lit(name), "vec_id"), F.lit(blocks)).cast("int")), blocks


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every row of
    ``queries`` with the rows of ``vectors`` but its own; both as ``quantised`` gives them."""
    ship(vectors.sparkSession)
    most = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    dims = most["d"] if most else 0
    vectors, queries = (x.where(F.size("v") == dims) for x in (vectors, queries))
    placed, shards = _dealt(vectors, SHARD, "shard")
    index = stored(placed.groupBy("shard").applyInPandas(_indexed, "shard int, segment int, ids binary, forward binary, vectors binary, dims binary, impacts binary"), "index")
    asked, blocks = _dealt(queries, QUERIES, "block")
    packed = asked.groupBy("block").applyInPandas(_packed("block"), "block int, ids binary, data binary")
    # A stated query set against all rows, in blocks.
    left = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def cell(key, ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if ours.empty or theirs.empty:
            return pd.DataFrame({n: np.zeros(0, np.int64) for n in names})
        theirs = theirs.sort_values("segment")
        ids = np.frombuffer(theirs["ids"].iloc[0], np.int64)
        forward = np.frombuffer(theirs["forward"].iloc[0], np.int64).reshape(len(ids), dims)
        parts = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.int16), np.frombuffer(c, np.int64)) for a, b, c in zip(theirs["vectors"], theirs["dims"], theirs["impacts"])]
        query_ids = np.frombuffer(ours["ids"].iloc[0], np.int64)
        q = np.frombuffer(ours["data"].iloc[0], np.int64).reshape(len(query_ids), dims)
        got = [[], [], []]
        for at in range(0, len(q), 128):  # bounds the accumulators
            row, vector, score = search(q[at : at + 128], query_ids[at : at + 128], parts, forward, ids, k)
            for out, part in zip(got, (query_ids[at + row], ids[vector], score)):
                out.append(part)
        return pd.DataFrame({n: np.concatenate(g) for n, g in zip(names, got)})

    cells = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(cell, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = cells.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

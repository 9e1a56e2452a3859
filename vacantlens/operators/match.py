"""Top-k matches of distinct keys against a reference catalog.

Scoring every key against every entry is what the operator means, but no pair is ever a
row: each task scores its keys against a block of the catalog and hands on at most ``k``
rows per key. A catalog within ``max_broadcast`` rows and ``MAX_BLOCK_BYTES`` (measured, not
assumed) is one block, sent to every task. A larger catalog is split into blocks and the
keys into chunks of such sizes; chunk and block meet in a co-group and a final top-k merges
the blocks. Both ways are exact. Names of a larger catalog are first looked up by a filter join
(``similarity``), which never meets most entries; only keys with fewer than ``k`` entries of
``SIMILAR_FROM`` or more meet the blocks, and none does if the threshold is that high. Vectors of a
larger catalog meet only the clusters of entries that could still count (``cosine``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantlens.operators.cosine import pruned_cosine
from vacantlens.operators.scoring import as_matrix, comparable, prepare_catalog
from vacantlens.operators.similarity import similarity_join
from vacantlens.session import stored

MAX_BROADCAST_ROWS = 20_000
KEY_CHUNK_ROWS = 20_000
MAX_BLOCK_BYTES = 128 << 20
#: Scores from which the filter join is selective.
SIMILAR_FROM = 75
_SCORE_ROWS = 512  # keys scored per matrix product, bounds memory in the task


def _score(keys: pd.DataFrame, catalog, codes: Sequence, positions: Sequence, fuzzy: bool, semantic: bool, k: int, threshold: int, width: int) -> pd.DataFrame:
    """Best ``k`` entries of one prepared block for each key."""
    out = []
    for start in range(0, len(keys), _SCORE_ROWS):
        part = keys.iloc[start : start + _SCORE_ROWS]
        scores = catalog.cosines(as_matrix(list(part["_vector"]), width)) if semantic else None
        for row, (key, text) in enumerate(zip(part["_key"], part["_text"])):
            found = catalog.top(comparable(text) if fuzzy else None, None if scores is None else scores[row], k, threshold)
            out += [(key, codes[i], positions[i], sem, fuz, max(sem, fuz)) for i, sem, fuz in found]
    return pd.DataFrame(out, columns=["_key", "_code", "_position", "semantic_confidence", "fuzzy_confidence", "best_confidence"])


def _vector_width(catalog: pd.DataFrame) -> int:
    return max((len(v) for v in catalog["_vector"] if v is not None), default=0)


def match_topk(
    keys: DataFrame,
    catalog: DataFrame,
    key: str,
    code: str,
    order: str,
    key_text: str | None = None,
    catalog_text: str | None = None,
    key_vector: str | None = None,
    catalog_vector: str | None = None,
    level: str | None = None,
    search_levels: str | None = None,
    k: int = 3,
    threshold: int = 0,
    max_broadcast: int = MAX_BROADCAST_ROWS,
    key_chunk: int = KEY_CHUNK_ROWS,
) -> DataFrame:
    """(key, code, semantic, fuzzy and best confidence, rank) of the best ``k`` entries per key.

    Texts give the fuzzy score, vectors the semantic one; with both, best is the larger and
    a missing one counts 0. Ties keep the order of the catalog column ``order``. With
    ``level`` and ``search_levels`` a key sees only entries whose level is in its list; a
    key with an empty list has no candidates. ``keys`` and (code, level) must be distinct.
    """
    fuzzy, semantic = key_text is not None, key_vector is not None
    key_type, code_type = keys.schema[key].dataType, catalog.schema[code].dataType
    no_text, no_vector = F.lit(None).cast("string"), F.lit(None).cast("array<double>")
    k_rows = keys.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"),
        (F.col(key_text) if fuzzy else no_text).alias("_text"),
        (F.col(key_vector).cast("array<double>") if semantic else no_vector).alias("_vector"),
        (F.explode(F.array_distinct(search_levels)) if search_levels else F.lit(0)).alias("_level"),
    ).withColumn("_level", F.col("_level").cast("string"))
    c_rows = catalog.where(F.col(code).isNotNull()).select(
        F.col(code).alias("_code"),
        F.col(order).cast("long").alias("_position"),
        (F.col(catalog_text) if fuzzy else no_text).alias("_text"),
        (F.col(catalog_vector).cast("array<double>") if semantic else no_vector).alias("_vector"),
        (F.col(level) if level else F.lit(0)).cast("string").alias("_level"),
    )
    schema = T.StructType(
        [
            T.StructField("_key", key_type),
            T.StructField("_code", code_type),
            T.StructField("_position", T.LongType()),
            T.StructField("semantic_confidence", T.LongType()),
            T.StructField("fuzzy_confidence", T.LongType()),
            T.StructField("best_confidence", T.LongType()),
        ]
    )
    blocks = _pieces(c_rows, max_broadcast)
    if blocks == 1:
        partial = _against_broadcast(k_rows, c_rows.toPandas(), schema, fuzzy, semantic, k, threshold)
    elif not fuzzy:
        partial = pruned_cosine(k_rows, c_rows, schema, k, threshold, min(max_broadcast, key_chunk))
    else:
        # Names that have enough alike are done by the filter join; it is whole at its threshold.
        near = None if semantic else stored(_best(_alike(k_rows, c_rows, max(threshold, SIMILAR_FROM)), k), "alike")
        if near is not None and threshold >= SIMILAR_FROM:
            partial = near.drop("rank")
        else:
            if near is not None:
                done = near.groupBy("_key").agg(F.max("rank").alias("_found")).where(F.col("_found") >= k).select("_key")
                k_rows = stored(k_rows.join(done, "_key", "left_anti"), "rest")
            partial = _against_blocks(k_rows, c_rows, schema, fuzzy, semantic, k, threshold, blocks, _pieces(k_rows, key_chunk))
            if near is not None:
                partial = partial.unionByName(near.join(done, "_key", "left_semi").drop("rank"))
    return _best(partial, k).select(
        F.col("_key").alias(key), F.col("_code").alias(code),
        "semantic_confidence", "fuzzy_confidence", "best_confidence", "rank",
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each key, ranked. A code found on two levels is one candidate, with its better score."""
    own = W.partitionBy("_key", "_code").orderBy(F.desc("best_confidence"), "_position")
    found = found.withColumn("_copy", F.row_number().over(own)).where(F.col("_copy") == 1).drop("_copy")
    best_first = W.partitionBy("_key").orderBy(F.desc("best_confidence"), "_position", "_code")
    return found.withColumn("rank", F.row_number().over(best_first).cast("long")).where(F.col("rank") <= k)


def _alike(keys: DataFrame, catalog: DataFrame, threshold: int) -> DataFrame:
    """All entries of a key's levels whose texts score ``threshold`` or more."""
    entries = catalog.select(F.struct("_code", "_position", "_level").alias("_entry"), "_text")
    pairs = similarity_join(keys.select("_key", "_text").distinct(), entries, "_key", "_entry", "_text", "_text", threshold)
    zero = F.lit(0).cast("long")
    found = pairs.select("_key", "_entry.*", zero.alias("semantic_confidence"), F.col("score").alias("fuzzy_confidence"), F.col("score").alias("best_confidence"))
    return found.join(keys.select("_key", "_level"), ["_key", "_level"]).drop("_level")


def _pieces(rows: DataFrame, max_rows: int) -> int:
    """How many pieces keep each within ``max_rows`` rows and ``MAX_BLOCK_BYTES`` bytes."""
    text_bytes = F.coalesce(F.octet_length("_text"), F.lit(0))
    vector_bytes = F.coalesce(F.size("_vector"), F.lit(0)) * 8
    found = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum((text_bytes + vector_bytes).cast("long")), F.lit(0))).first()
    return max(1, ceil(found[0] / max_rows), ceil(found[1] / MAX_BLOCK_BYTES))


def _blocks_by_level(catalog: pd.DataFrame, width: int, semantic: bool) -> dict:
    """Prepared entries per level, in catalog order."""
    out = {}
    for level, rows in catalog.sort_values(["_position", "_code"], kind="stable").groupby("_level", sort=False):
        vectors = list(rows["_vector"]) if semantic else None
        out[level] = (prepare_catalog(list(rows["_text"]), vectors, width), list(rows["_code"]), list(rows["_position"]))
    return out


def _score_levels(keys: pd.DataFrame, blocks: dict, fuzzy: bool, semantic: bool, k: int, threshold: int, width: int) -> Iterator[pd.DataFrame]:
    for level, part in keys.groupby("_level", sort=False):
        if level in blocks:
            prepared, codes, positions = blocks[level]
            yield _score(part, prepared, codes, positions, fuzzy, semantic, k, threshold, width)


def _against_broadcast(keys: DataFrame, head: pd.DataFrame, schema: T.StructType, fuzzy: bool, semantic: bool, k: int, threshold: int) -> DataFrame:
    width = _vector_width(head)
    shared = keys.sparkSession.sparkContext.broadcast(head)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = _blocks_by_level(shared.value, width, semantic)
        for batch in batches:
            yield from _score_levels(batch, blocks, fuzzy, semantic, k, threshold, width)

    # Keys are few bytes but costly to score, so they are spread over all cores first; the
    # explicit number keeps adaptive execution from merging them back by size.
    spark = keys.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return keys.repartition(tasks, "_key", "_level").mapInPandas(score, schema)


def _against_blocks(
    keys: DataFrame, catalog: DataFrame, schema: T.StructType, fuzzy: bool, semantic: bool, k: int, threshold: int, blocks: int, chunks: int
) -> DataFrame:
    """Chunks of keys meet blocks of the catalog. Chunk and block come from a hash of distinct
    keys, so no chunk is hot; each key goes to each block once."""
    left = keys.withColumn("_chunk", F.pmod(F.xxhash64("_key", "_level"), F.lit(chunks))).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    right = catalog.withColumn("_block", F.pmod(F.xxhash64("_code", "_level"), F.lit(blocks)).cast("int")).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))
    )

    def score(key_part: pd.DataFrame, catalog_part: pd.DataFrame) -> pd.DataFrame:
        width = _vector_width(catalog_part)
        prepared = _blocks_by_level(catalog_part, width, semantic)
        found = list(_score_levels(key_part, prepared, fuzzy, semantic, k, threshold, width))
        return pd.concat(found) if found else pd.DataFrame({f.name: [] for f in schema.fields})

    pair = ["_chunk", "_block"]
    return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(score, schema)


def candidate_table(matches: DataFrame, catalog: DataFrame, code: str, columns: Sequence[str]) -> DataFrame:
    """Matches with catalog attributes and the columns a person fills in while validating."""
    named = matches.join(catalog.select(code, *columns), code, "left")
    return named.withColumns(
        {
            "validated": F.lit(0),
            "validated_code": F.lit(None).cast("string"),
            "validated_name": F.lit(None).cast("string"),
            "notes": F.lit(None).cast("string"),
        }
    )

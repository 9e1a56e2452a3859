"""Pruned cosine matches against brute force, and what is skipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantlens.operators import cosine, match


def clustered(n, seed, centres=12, width=16, spread=0.05):
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(centres, width))
    rng = np.random.default_rng(seed)
    return [[float(x) for x in middle[i % centres] + spread * rng.normal(size=width)] for i in range(n)]


def frames(spark, keys, catalog):
    k = spark.createDataFrame([(i, v, [i % 2, 5]) for i, v in enumerate(keys)], "key int, v array<double>, levels array<int>")
    c = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(catalog)], "code int, v array<double>, level int")
    return k, c


def brute(keys, catalog, k, threshold, leveled):
    def unit(vectors):
        m = np.array([v if v is not None else [0.0] * 16 for v in vectors])
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    scores = np.trunc(100 * np.round(unit(keys) @ unit(catalog).T, 9)).astype(int)
    out = set()
    for i, row in enumerate(scores):
        allowed = [j for j in range(len(catalog)) if not leveled or j % 3 in (i % 2, 5)]
        best = sorted((-row[j], j) for j in allowed if row[j] >= threshold)[:k]
        out |= {(i, j, -s, 0, -s, rank) for rank, (s, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("threshold,leveled", [(0, False), (-100, True), (60, True)])
def test_pruned_equals_brute_force(spark, threshold, leveled):
    rng = np.random.default_rng(1)
    noise = [[float(x) for x in rng.normal(size=16)] for _ in range(40)]
    keys = [*clustered(60, 1), *noise[:20], None, [0.0] * 16]
    # One direction holds a third of the entries; several have none.
    catalog = [*clustered(150, 2), *clustered(90, 3, spread=0.0)[:1] * 90, *noise, None, [0.0] * 16]
    kdf, cdf = frames(spark, keys, catalog)
    levels = {"level": "level", "search_levels": "levels"} if leveled else {}
    got = match.match_topk(kdf, cdf, "key", "code", "code", key_vector="v", catalog_vector="v", k=4, threshold=threshold, max_broadcast=25, key_chunk=30, **levels)
    assert {tuple(r) for r in got.collect()} == brute(keys, catalog, 4, threshold, leveled)


def test_far_clusters_are_skipped(spark):
    kdf, cdf = frames(spark, clustered(200, 4), clustered(600, 5))
    keys = kdf.select(F.col("key").alias("_key"), F.col("v").alias("_vector"), F.lit("0").alias("_level"))
    catalog = cdf.select(F.col("code").alias("_code"), F.col("code").cast("long").alias("_position"), F.col("v").alias("_vector"), F.lit("0").alias("_level"))
    schema = spark.createDataFrame([], "_key int, _code int, _position long, semantic_confidence long, fuzzy_confidence long, best_confidence long").schema
    report = {}
    found = cosine.pruned_cosine(keys, catalog, schema, 3, 0, 100, report)
    assert found.count() >= 600
    assert report["all"] == 200 * 25 and report["met"] < report["all"] // 3


def test_keys_are_sent_to_blocks_not_to_clusters(spark):
    """Directions without clusters, where nothing can be skipped: a key is a row per block and pass."""
    rng = np.random.default_rng(11)
    noise = [[float(x) for x in rng.normal(size=16)] for _ in range(400)]
    kdf, cdf = frames(spark, noise[:100], noise)
    keys = kdf.select(F.col("key").alias("_key"), F.col("v").alias("_vector"), F.lit("0").alias("_level"))
    catalog = cdf.select(F.col("code").alias("_code"), F.col("code").cast("long").alias("_position"), F.col("v").alias("_vector"), F.lit("0").alias("_level"))
    schema = spark.createDataFrame([], "_key int, _code int, _position long, semantic_confidence long, fuzzy_confidence long, best_confidence long").schema
    report = {}
    found = cosine.pruned_cosine(keys, catalog, schema, 3, 0, 200, report)
    assert found.count() >= 300
    assert report["rows"] <= 100 * 2 * 4 < report["met"]

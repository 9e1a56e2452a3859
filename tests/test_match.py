"""Scoring and top-k matching against brute force, both ways of meeting the catalog."""

import difflib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vacantlens.operators import enrich, incremental, maintain, match
from vacantlens.operators.scoring import Catalog, common_length, comparable, prepare_catalog, token_set_score

WORDS = st.lists(st.sampled_from(["tecnico", "en", "salud", "salud2", "abogado", "a", "bc"]), max_size=5).map(" ".join)


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.text("abc ", max_size=20), st.text("abcd ", max_size=20))
def test_common_length(a, b):
    assert common_length(a, b) == slow_common(a, b)


@given(WORDS, WORDS)
def test_score_is_symmetric_order_free_and_bounded(a, b):
    score = token_set_score(a, b)
    assert 0 <= score <= 100
    assert score == token_set_score(b, a) == token_set_score(" ".join(reversed(a.split())), b)


@pytest.mark.parametrize(
    "a,b,score",
    [
        ("fuzzy was a bear", "fuzzy fuzzy was a bear", 100),
        ("new york mets", "new york yankees", 76),
        ("abogado", "", 0),
        ("", "", 0),
        ("abc", "abd", 67),
        ("contador publico", "contador", 100),
        ("ab", "ba", 50),
    ],
)
def test_known_scores(a, b, score):
    assert token_set_score(a, b) == score


def test_comparable_drops_latin1_letters():
    assert comparable("  Técnico, en SALUD-Pública ") == "tcnico  en salud pblica"
    assert comparable(None) == ""


@given(WORDS, st.lists(WORDS, min_size=1, max_size=8))
def test_bounds_hold(key, texts):
    low, high = Catalog(texts).bounds(key)
    for i, text in enumerate(texts):
        score = token_set_score(key, text)
        assert np.floor(low[i] - 1e-9) <= score <= np.ceil(high[i] + 1e-9)


@settings(max_examples=60)
@given(WORDS, st.lists(WORDS, min_size=1, max_size=12), st.integers(1, 4), st.integers(0, 60), st.randoms(use_true_random=False))
def test_top_equals_full_scan(key, texts, k, threshold, rng):
    semantic = np.array([rng.randint(-20, 100) for _ in texts])
    fuzzy = [token_set_score(key, t) for t in texts]
    for sem in (None, semantic):
        base = [0 if sem is None or s < threshold else int(s) for s in semantic]
        exact = [f if f >= threshold else 0 for f in fuzzy]
        want = sorted(range(len(texts)), key=lambda i: (-max(base[i], exact[i]), i))[:k]
        want = [(i, base[i], exact[i]) for i in want if max(base[i], exact[i]) >= threshold]
        assert Catalog(texts).top(key, sem, k, threshold) == want


def test_zero_vectors_score_zero():
    catalog = prepare_catalog(["", ""], [None, [3.0, 4.0]], 2)
    assert catalog.cosines(np.array([[6.0, 8.0], [0.0, 0.0], [-8.0, 6.0]])).tolist() == [[0, 100], [0, 0], [0, 0]]


def frames(spark):
    rng = np.random.default_rng(5)
    words = ["jefe", "tecnico", "salud", "abogado", "de", "finanzas", "archivo", "chofer"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 5))) for _ in range(40)]
    names = [" ".join(rng.choice(words, rng.integers(1, 4))) for _ in range(30)]
    keys = [(f"k{i}", t, [float(x) for x in rng.normal(size=4)] if i % 5 else None, [int(i % 3), 2] if i % 4 else []) for i, t in enumerate(texts)]
    catalog = [(i, n, [float(x) for x in rng.normal(size=4)] if i % 6 else None, int(i % 3)) for i, n in enumerate(names)]
    return (
        keys, catalog,
        spark.createDataFrame(keys, "key string, t string, v array<double>, levels array<int>"),
        spark.createDataFrame(catalog, "code int, name string, v array<double>, level int"),
    )


def brute(keys, catalog, k, fuzzy, semantic, leveled, threshold=0):
    out = set()
    for key, text, vector, levels in keys:
        found = []
        for code, name, other, level in catalog:
            if leveled and level not in levels:
                continue
            sem = 0
            if semantic and vector is not None and other is not None:
                sem = int(100 * round(float(np.dot(vector, other) / np.linalg.norm(vector) / np.linalg.norm(other)), 9))
            if semantic and not fuzzy and sem < threshold:
                continue
            sem = sem if sem >= threshold else 0
            fuz = token_set_score(comparable(text), comparable(name)) if fuzzy else 0
            fuz = fuz if fuz >= threshold else 0
            if max(sem, fuz) >= threshold:
                found.append((-max(sem, fuz), code, sem, fuz))
        out |= {(key, code, sem, fuz, -best, rank) for rank, (best, code, sem, fuz) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.mark.parametrize("fuzzy,semantic", [(True, False), (False, True), (True, True)])
@pytest.mark.parametrize("leveled", [False, True])
@pytest.mark.parametrize("max_broadcast", [1000, 7])
def test_match_equals_brute_force(spark, fuzzy, semantic, leveled, max_broadcast):
    keys, catalog, kdf, cdf = frames(spark)
    got = match.match_topk(
        kdf, cdf, "key", "code", "code",
        key_text="t" if fuzzy else None, catalog_text="name" if fuzzy else None,
        key_vector="v" if semantic else None, catalog_vector="v" if semantic else None,
        level="level" if leveled else None, search_levels="levels" if leveled else None,
        k=4, max_broadcast=max_broadcast, key_chunk=15,
    )
    assert {tuple(r) for r in got.collect()} == brute(keys, catalog, 4, fuzzy, semantic, leveled)


def test_match_threshold(spark):
    keys, catalog, kdf, cdf = frames(spark)
    got = match.match_topk(kdf, cdf, "key", "code", "code", key_text="t", catalog_text="name", k=3, threshold=80)
    assert {tuple(r) for r in got.collect()} == brute(keys, catalog, 3, True, False, False, 80)


def test_headings_against_benchmark_equal_brute_force(spark):
    """The registered query without an SQL check, over its whole small tables."""
    from vacantlens.plans import QUERIES

    root = "/root/testdata/sf0.001"
    got = {(r.title, r.item_id, r.fuzzy_confidence, r["rank"]) for r in QUERIES["pending_title_matches"](spark, root).collect()}
    import re

    seen = {r.text for r in spark.read.parquet(f"{root}/conversations.parquet").collect()}
    titles = {re.search(r"(?is)<h1[^>]*>(.*?)</h1>", r.html).group(1) for r in spark.read.parquet(f"{root}/pages.parquet").collect()} - seen
    items = [(r.item_id, r.text, None, 0) for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    want = brute([(t, t, None, []) for t in titles], items, 2, True, False, False)
    assert got == {(key, code, fuz, rank) for key, code, _, fuz, _, rank in want}


def test_best_candidates_ties_and_validated(spark):
    rows = [("a", "2", 90, 1, 0), ("a", "1", 90, 1, 0), ("a", "0", 90, 2, 0), ("b", "9", 10, 2, 1), ("b", "8", 99, 1, 0)]
    df = spark.createDataFrame(rows, "k string, code string, best_confidence int, rank int, validated int")
    assert {(r.k, r.code) for r in enrich.best_candidates(df, "k", "code", ["code"]).collect()} == {("a", "1"), ("b", "8")}
    preferred = enrich.best_candidates(df, "k", "code", ["code"], prefer_validated=True)
    assert {(r.k, r.code) for r in preferred.collect()} == {("a", "1"), ("b", "9")}
    facts = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "id int, title string")
    best = enrich.best_candidates(df, "k", "code", ["code"])
    assert {(r.id, r.code) for r in enrich.attach_best(facts, "title", best, "k").collect()} == {(1, "1"), (2, None), (3, None)}


def test_refresh_keeps_validated_and_replaces_the_rest(spark):
    schema = "k string, code string, best_confidence int, validated int"
    stored = spark.createDataFrame([("a", "1", 50, 0), ("a", "2", 60, 1), ("b", "3", 70, 0)], schema)
    fresh = spark.createDataFrame([("a", "2", 99, 0), ("a", "4", 80, 0)], schema)
    got = {tuple(r) for r in maintain.refresh_candidates(stored, fresh, "k", "code").collect()}
    assert got == {("a", "2", 60, 1), ("b", "3", 70, 0), ("a", "4", 80, 0)}


def test_patch_and_delete(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, n string, v double")
    patch = spark.createDataFrame([(1, None, 9.0), (7, "x", 0.0)], "id int, n string, v double")
    assert {tuple(r) for r in maintain.apply_patches(base, patch, "id", ["n", "v"]).collect()} == {(1, "a", 9.0), (2, "b", 2.0)}
    assert [r.id for r in maintain.delete_keys(base, patch, "id").collect()] == [2]


def test_insert_or_ignore_is_idempotent(spark):
    target = spark.createDataFrame([(1, "x")], "id int, t string")
    batch = spark.createDataFrame([(1, "y"), (2, "b"), (2, "a"), (3, "c")], "id int, t string")
    added = incremental.insert_or_ignore(target, batch, ["id"], ["t"])
    assert {tuple(r) for r in added.collect()} == {(2, "a"), (3, "c")}
    assert incremental.insert_or_ignore(target.union(added), batch, ["id"], ["t"]).count() == 0


def test_keep_first_bounds_a_hot_key_before_the_shuffle(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    first = incremental.keep_first(df, ["k"], ["id"])
    assert first.where("k = 0").first().id == 0
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_difflib_agrees_on_plain_ratio():
    # A second opinion on the letter part for texts without common words.
    a, b = "contadora", "contador"
    assert token_set_score(a, b) == round(100 * difflib.SequenceMatcher(None, a, b, autojunk=False).ratio())


def test_a_key_is_taken_apart_once_for_many_entries(monkeypatch):
    from vacantlens.operators import scoring

    rng = random.Random(4)
    words = ["ab", "ba", "abc", "c", "dé", "the", "x", "yz", "q"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(5)))
    keys, entries = [text() for _ in range(60)], [text() for _ in range(90)]
    for kept in (scoring.RESTS, 1):
        monkeypatch.setattr(scoring, "RESTS", kept)
        for key in keys:
            scorer = scoring.KeyScorer(key)
            assert [scorer.score(set(e.split())) for e in entries] == [scoring.token_set_score(key, e) for e in entries]
    monkeypatch.setattr(scoring, "token_set_score", None)  # no pair goes through the plain scorer
    long = " ".join(f"word{i}" for i in range(80))
    assert scoring.prepare_catalog(["red tin", "word1 x"], None, 0).top(long, None, 2, 0)[0][0] == 1

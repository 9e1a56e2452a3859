"""The filter join against scoring every pair."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vacantlens.operators import alike, match, similarity
from vacantlens.operators.scoring import comparable, token_set_score

STEMS = ["tecnico", "tecnica", "técnico", "salud", "salubre", "abogado", "abogada", "de", "en", "la", "a", "finanzas", "finanza", "ñ", "archivo", "i", "ii", "jefe"]


def names(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice(STEMS) for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.4:  # a slip of the pen
            w = list(rng.choice(words))
            w.insert(rng.randrange(len(w) + 1), rng.choice("xyz"))
            words.append("".join(w))
        out.append(rng.choice([" ", "-", "  "]).join(words))
    return out


def brute(keys, catalog, threshold):
    return sorted(
        (k, c, score) for k, t in keys for c, u in catalog if (score := token_set_score(comparable(t), comparable(u))) >= threshold
    )


@pytest.fixture(scope="module")
def tables(spark):
    keys = list(enumerate([*names(70, 1), None, "", "--", "ab", "abc", "abcd abcd", "hot de la", *names(5, 2) * 3]))
    catalog = list(enumerate([*names(160, 3), None, "", "?", "abd", "bca", "abcd", "ab ba", *["hot de la"] * 20]))
    return keys, catalog, spark.createDataFrame(keys, "key int, words string"), spark.createDataFrame(catalog, "code int, words string")


@pytest.mark.parametrize("threshold", [30, 60, 75, 82, 90, 100])
def test_filter_join_equals_all_pairs(spark, tables, threshold):
    keys, catalog, kdf, cdf = tables
    got = similarity.similarity_join(kdf, cdf, "key", "code", "words", "words", threshold)
    assert sorted(map(tuple, got.collect())) == brute(keys, catalog, threshold)


def test_filter_join_scores_few_of_all_pairs(spark):
    """Candidates grow with what is alike, not with keys x catalog."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 10))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(4)) for _ in range(1500)]
    catalog = spark.createDataFrame([(t, sorted(set(t.split()))) for t in texts], "class string, words array<string>").withColumn("n", F.char_length("class"))
    both = catalog.withColumn("side", F.lit(0)).unionByName(catalog.withColumn("side", F.lit(1)))
    for share, most in ((0.845, 0.06), (0.895, 0.01)):
        pairs = similarity._by_words(both, share).unionByName(similarity._by_letters(both, share)).distinct()
        assert 1500 <= pairs.count() < 1500 * 1500 * most
    assert "CartesianProduct" not in (plan := pairs._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


@pytest.mark.parametrize("need", [3, 5, 9, 13])
def test_pieces_cover_their_words(need):
    pieces = similarity.cut_words(["a", "bcd", "efghij"], need)
    assert len(pieces) == need and all(0 < len(p) <= similarity.LONGEST_PIECE for p in pieces)
    assert "".join(pieces) == (" a bcd efghij" if need > 3 else " a bcd efghi")


def test_no_threshold_is_refused(spark, tables):
    with pytest.raises(ValueError):
        similarity.similarity_join(tables[2], tables[3], "key", "code", "words", "words", 0)


@pytest.mark.parametrize("threshold", [0, 60, 85])
@pytest.mark.parametrize("leveled", [False, True])
def test_top_matches_of_a_large_catalog(spark, tables, threshold, leveled):
    """Beyond ``max_broadcast`` names, by the filter join as far as it reaches, as by scoring all pairs."""
    keys, catalog, kdf, cdf = tables
    kdf = kdf.withColumn("levels", F.array(F.col("key") % 3, F.lit(1)))
    cdf = cdf.withColumn("level", F.col("code") % 3)
    levels = {"level": "level", "search_levels": "levels"} if leveled else {}
    got = match.match_topk(kdf, cdf, "key", "code", "code", key_text="words", catalog_text="words", k=3, threshold=threshold, max_broadcast=20, key_chunk=30, **levels)
    want = set()
    for k, t in keys:
        found = []
        for c, u in catalog:
            if leveled and c % 3 not in (k % 3, 1):
                continue
            score = token_set_score(comparable(t), comparable(u))
            if score >= threshold:
                found.append((-score, c))
        want |= {(k, c, 0, -s, -s, rank) for rank, (s, c) in enumerate(sorted(found)[:3], 1)}
    assert {tuple(r) for r in got.collect()} == want


def syllables(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "ti", "on", "the", "re", "ha", "in"]) for _ in range(rng.randrange(1, 4)))
    return [" ".join(word() for _ in range(rng.randrange(2, 6))) for _ in range(n)]


def test_common_pieces_meet_block_by_block(spark, monkeypatch):
    """Texts of few syllables share most pieces: no pair of them is a row before its letters are alike enough."""
    monkeypatch.setattr(similarity, "BLOCK_KEYS", 40)  # several blocks of a length
    monkeypatch.setattr(similarity, "BLOCK_ENTRIES", 50)
    keys, catalog = list(enumerate(syllables(300, 1))), list(enumerate(syllables(500, 2)))
    kdf, cdf = spark.createDataFrame(keys, "key int, words string"), spark.createDataFrame(catalog, "code int, words string")
    found = []
    blocks = similarity._by_blocks
    monkeypatch.setattr(similarity, "_by_blocks", lambda *args: found.append(blocks(*args)) or found[0])
    got = similarity.similarity_join(kdf, cdf, "key", "code", "words", "words", 90)
    assert sorted(map(tuple, got.collect())) == brute(keys, catalog, 90)
    assert found and found[0].count() < 300 * 500 * 0.1


def test_letters_in_common_of_short_and_long_texts(monkeypatch):
    rng = random.Random(3)
    texts = [sorted(("".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 30))) for _ in range(60)), key=len) for _ in range(2)]
    counts = [similarity.np.array([similarity.np.bincount([ord(c) % 32 for c in t], minlength=32) for t in side], "uint16") for side in texts]
    sizes = [similarity.np.array([len(t) for t in side]) for side in texts]
    want = {(i, j) for i in range(60) for j in range(60) if 2 * int(similarity.np.minimum(counts[0][i], counts[1][j]).sum()) >= 0.8 * (sizes[0][i] + sizes[1][j])}
    for levels in (similarity.LEVELS, 0):
        monkeypatch.setattr(similarity, "LEVELS", levels)
        assert set(zip(*map(list, similarity.alike_in_block(*counts, *sizes, 0.8)))) == want


def few_words(n, seed, most=7):
    rng = random.Random(seed)
    return [" ".join(rng.choice(STEMS + ["licenciado", "contador", "principal", "del", "area"]) for _ in range(rng.randrange(2, most))) for _ in range(n)]


def test_candidates_of_common_words_are_no_rows(spark, monkeypatch):
    """Texts of few words: nearly every pair shares words, but only results become rows."""
    keys, catalog = list(enumerate(few_words(250, 1))), list(enumerate(few_words(900, 2)))
    kdf, cdf = spark.createDataFrame(keys, "key int, words string"), spark.createDataFrame(catalog, "code int, words string")
    rows, spread = [], similarity.spread
    monkeypatch.setattr(similarity, "spread", lambda df: rows.append(df.count()) or spread(df))
    got = similarity.similarity_join(kdf, cdf, "key", "code", "words", "words", 90)
    assert sorted(map(tuple, got.collect())) == brute(keys, catalog, 90)
    assert sum(rows) <= 4 * (250 + 900)


@pytest.mark.parametrize("often", [True, False])
def test_rows_and_blocks_agree(spark, tables, monkeypatch, often):
    """Keys without code, copies on both sides, items that are no strings."""
    monkeypatch.setattr(similarity, "_many_candidates", lambda *args: often)
    keys, catalog, kdf, cdf = tables
    cdf = cdf.withColumn("code", F.when(F.col("code") != 3, F.struct("code", F.col("words").alias("w"))))
    got = similarity.similarity_join(kdf, cdf, "key", "code", "words", "words", 82)
    assert sorted((r[0], -1 if r[1] is None else r[1][0], r[2]) for r in got.collect()) == sorted((k, -1 if c == 3 else c, s) for k, c, s in brute(keys, catalog, 82))


def test_texts_in_both_tables_are_no_common_pieces(spark):
    """Every text has its copy and hardly anything else that is alike: that is what the joins are for."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    texts = spark.createDataFrame([(i, " ".join(sorted({word() for _ in range(4)})), 0) for i in range(9000)], "row long, text string, item int")
    assert not similarity._many_candidates((texts, texts), [9000, 9000], 0.975)


@pytest.mark.parametrize("share", [0.295, 0.745, 0.895, 0.995])
@pytest.mark.parametrize("at_once", [None, 64])
def test_candidates_of_a_block_miss_no_pair(monkeypatch, share, at_once):
    """Also texts of many words, letters beyond the counted groups, and pieces of every size."""
    if at_once:
        for name in ("AT_ONCE", "FOUND", "LETTERS", "APART"):
            monkeypatch.setattr(alike, name, at_once if name != "APART" else 1)
    rng = random.Random(11)
    long = [" ".join(rng.choice(STEMS) + str(rng.randrange(30)) for _ in range(rng.randrange(40, 90))) for _ in range(12)]
    long += [t + " uno" for t in long[:6]] + [t[: len(t) * 9 // 10] for t in long[6:]]
    sides = [sorted({" ".join(sorted(set(comparable(t).split()))) for t in few_words(60, s, 9) + names(60, s + 2) + syllables(60, s + 4) + long + ["𝕏𝕐 ñandú", "x"]} - {""}) for s in (21, 22)]
    a, b = (alike.Texts(pa.array(side)) for side in sides)
    found = [p for i, j in alike.candidates(a, b, share) for p in zip(i.tolist(), j.tolist())]
    least = round(100 * share + 0.5)
    want = {(i, j) for i, t in enumerate(sides[0]) for j, u in enumerate(sides[1]) if token_set_score(t, u) >= least}
    assert len(found) == len(set(found)) and want <= set(found)

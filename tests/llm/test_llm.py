"""The training-data operators against brute force, on literal rows with odd cases."""

import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import check
import corpus_pipeline
from vacantlens.llm import decontam, idcodec, licenses, linededup, lm, minhash, mixing, text, tokenids, topk, toxicity, warc
from vacantlens.llm.graph import components
from vacantlens.llm.queries import ORACLES, QUERIES
from vacantlens.session import stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
ROOT = "/root/testdata/sf0.001"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("w%d" % rng.randrange(4000) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = words(60, 1).split()
    near = base[:]
    near[30] = "changed"
    rows = [
        (1, " ".join(base), "en", "a", 1, "x"),
        (2, " ".join(base).upper(), "en", "a", 1, "x"),
        (3, " ".join(near), "en", "b", 1, "x"),
        (4, None, "en", "b", None, None),
        (5, "", None, None, 0, "x"),
        (6, " \n\t ", "en", None, 3, "x"),
        (7, "two words", "en", "c", 9, "x"),
        (8, "Two  words", "en", "c", 10, "x"),
        (None, words(30, 3), "en", "c", 1, "x"),
        (9, words(30000, 4), "en", "a", 1, "x"),
        (10, "x" * 200_000, "en", "a", 1, "x"),
        (11, words(50, 5), "en", "a", 1, "x"),
        (11, words(50, 5), "en", "a", 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert check.compare(QUERIES[name](spark, ROOT), check.connect(ROOT), ORACLES[name]) == ""


def test_word_hashes_follow_python_words():
    texts = ["a b  c", "", None, "ab c", "A\x0bB", "x" * 70000 + " y", words(20000, 2), " lead"]
    plain = {}
    data, offsets = text.utf8(pa.array(texts))
    got = []
    for _, counts, hashes in text.word_hashes(data, offsets):
        got += [h.tolist() for h in np.split(hashes, np.cumsum(counts)[:-1])]
    assert len(got) == len(texts)
    for t, hashes in zip(texts, got):
        own = (t or "").encode().lower().split()
        assert len(own) == len(hashes)
        for w, h in zip(own, hashes):
            assert plain.setdefault(w, h) == h
    assert len(set(plain.values())) == len(plain)


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_equal_brute_force(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, 4).collect()}
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None], 4, 80)
    assert {i: v[:2] for i, v in got.items() if i is not None} == want
    assert got[None][1:] == (None, True) and all(v[2] == (i == v[1]) for i, v in got.items() if i is not None)
    kept = [r["doc_id"] for r in minhash.drop_near_duplicates(docs, 4).collect()]
    assert sorted(i for i in kept if i is not None) == [1, 4, 5, 6, 7, 9, 10, 11] and kept.count(None) == 1
    assert minhash.near_duplicates(docs.limit(0), 4).count() == 0


def test_loose_group_is_linked_like_brute_force(spark):
    rng = random.Random(5)
    base, rows = words(150, 7).split(), []
    for i in range(160):
        own = base[:]
        for _ in range(rng.randrange(10)):
            own[rng.randrange(len(own))] = "e%d" % rng.randrange(10**6)
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, 4).collect()}
    assert got == brute_components(rows, 4, 80)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (201, 200), (200, 201)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 150)}, 200: 200, 201: 200}


def test_warc_cases(spark):
    rows = [(1, "u", "<p>a\r\n\r\nWARC/1.1\r\n</p>"), (2, None, None), (3, "v", ""), (4, "v", "<p>é</p>"), (4, "v", "<p>é</p>"), (None, "v", "z"), (9, "w", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter(tuple(r) for r in warc.archived_pages(pages).select("page_id", "payload_bytes", "record_type", "refers_to").collect())
    assert got == Counter(
        [(1, 22, "response", None), (2, 0, "revisit", 3), (3, 0, "response", None), (4, 9, "revisit", 9), (4, 9, "revisit", 9), (None, 1, "response", None), (9, 9, "response", None)]
    )
    assert set(Counter(r["record_type"] for r in warc.captures(pages, least_bytes=10).collect())) == {"response"}
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


def test_mix_is_near_its_targets(spark):
    rows = [(i, words(40 + i % 90, i), "en", ["a", "b", "c", None][i % 7 % 4], 1, "x") for i in range(700)]
    rows += [(None, None, None, "zz", None, None), (5, words(10, 5), "en", "a", 1, "x")]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.plan_mix(df, ["doc_id", "source"], shard_rows=200).collect()
    again = mixing.plan_mix(df, ["doc_id", "source"], shard_rows=200).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    order = sorted(s for s in size if s is not None) + [None]
    weight, full = {s: k % 3 + 1 for k, s in enumerate(order)}, set()
    while True:  # the excess is shared again until no target is above
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        share = {s: weight[s] * left / sum(weight[x] for x in order if x not in full) for s in order if s not in full}
        over = {s for s in share if share[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    want = {s: 3.0 * size[s] if s in full else share[s] for s in order}
    assert all(abs(target[s] - want[s]) < 1e-6 * (1 + want[s]) for s in order)
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + 64 for s in order)
    whole = mixing.mixed_documents(df)
    assert whole.columns == df.columns
    mixed = sum(len((r["text"] or "").split()) for r in whole.collect())
    assert mixed == mixing.plan_mix(df, ["doc_id"]).agg(F.sum("taken")).first()[0]
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_small_source_of_a_large_corpus_meets_its_target(spark):
    rows = [(i, words(20, i), "big") for i in range(3000)] + [(9000 + i, words(20, i), "a") for i in range(30)] + [(9900, words(20, 1), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan_mix(df, ["source"], shard_rows=50).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert {r["source"]: r["target"] for r in got}["a"] == 1800
    assert all(abs(r["taken"] - r["target"]) <= 0.02 * r["target"] for r in got)


def test_line_dedup_cases(spark):
    rows = [(i, f"own {i}\n \tCommon é Line \n\nlast") for i in range(12)] + [(50, None), (51, ""), (51, ""), (52, "common é line"), (53, "COMMON É LINE")]
    got = {r["doc_id"]: r for r in linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3]["text"] == "own 3\n" and (got[3]["_lines"], got[3]["_dropped"]) == (4, 2)
    assert got[50]["text"] == "" and (got[50]["_lines"], got[50]["_dropped"]) == (1, 0)
    assert got[52]["_dropped"] == 1 and got[53]["text"] == "COMMON É LINE"


def test_codec_round_trip_and_damage():
    rng = np.random.default_rng(3)
    for n in (1, 63, 65, 5000, 70000):
        for ids in (rng.integers(0, 49408, n), np.full(n, 7), np.minimum(rng.zipf(1.4, n), 49407)):
            block = idcodec.encode_block(ids, 49408)
            assert (idcodec.decode_block(block) == ids).all()
    damaged = bytearray(block)
    damaged[len(block) // 2] ^= 1
    with pytest.raises(ValueError):
        idcodec.decode_block(bytes(damaged))
    with pytest.raises(ValueError):
        idcodec.decode_block(block[:-2])


def test_token_files_equal_direct_tokenising(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(docs.collect(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"])
    start, want = 0, []
    for r in rows:
        ids = np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    tokenids.write_ids(docs, str(tmp_path / "ids"), block_ids=5000)  # documents go on over blocks
    assert Counter(map(tuple, tokenids.id_digests(spark, str(tmp_path / "ids")).collect())) == Counter(want)
    assert sum(len(r["ids"]) for r in tokenids.read_ids(spark, str(tmp_path / "ids")).collect()) == start


def test_toxicity_separates_and_scores_every_row(spark, docs):
    rows = [(i, words(40, i) + (" you idiot moron" if i % 3 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(201, None), (None, 1)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(df, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(df, model, ["doc_id"]).collect()}
    assert min(got[i] for i in range(200, 300) if i % 3 == 0) > max(got[i] for i in range(200, 300) if i % 3)
    assert all(0 <= r["score"] <= 1 for r in toxicity.scored(docs, model, ["doc_id"]).collect())
    blank = toxicity.train(df, labels.limit(0))
    assert {round(r["score"], 3) for r in toxicity.scored(docs, blank, ["doc_id"]).collect()} == {0.5}


def test_top_k_equals_brute_force_with_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(60)]
    rows += [(900, None), (901, [None] + [0.0] * 15), (902, [float("nan")] * 16), (903, [float("inf")] * 16), (5, rows[5][1]), (905, [1.0] * 3)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()}
    whole = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows[:460]}
    for q in range(0, 460, 20):
        best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:20]
        assert [got[q, k + 1] for k in range(20)] == [(i, -s) for s, i in best]


def test_leaks_are_found_and_clean_documents_kept(spark, docs):
    items = [(k, words(20 + k, 900 + k)) for k in range(6)] + [(90, None), (91, "")]
    rows = [(i, words(300, 5000 + i)) for i in range(60)]
    for k in range(5):
        own = rows[k][1].split()
        rows[k] = (k, " ".join(own[:100] + items[k][1].split() + own[100:]))
    changed = items[5][1].split()
    changed[4] = changed[11] = "other"
    rows[5] = (5, words(200, 77) + " " + " ".join(changed) + " " + words(50, 78))
    rows += [(None, items[0][1]), (70, None), (71, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, bench).collect()}
    assert got == {(k, k) for k in range(6)}
    assert decontam.contaminated(df, bench.limit(0)).count() == 0
    # The row without doc_id is an item word for word: it goes with the six.
    assert decontam.drop_contaminated(df, bench).count() == len(rows) - 7
    assert decontam.common_subsequence(np.array([1, 2, 3, 4]), np.array([9, 1, 3, 2, 4])) == 3


def altered(item, by):
    """The item with every fifth word another one: no run of six words is left."""
    return " ".join(f"other{by}" if i % 5 == 3 else w for i, w in enumerate(item.split()))


def planted(text, item):
    own = text.split()
    return " ".join(own[: len(own) // 2] + item.split() + own[len(own) // 2 :])


def test_leaks_in_long_documents_do_not_drown_in_shared_columns(spark):
    rng = random.Random(8)
    items = [(k, " ".join(f"i{rng.randrange(10**6)}" for _ in range(30))) for k in range(4)]
    common = [(10 + k, " ".join(f"c{rng.randrange(400)}" for _ in range(30))) for k in range(2)]
    # 400 documents of 4,400 words: about 100 documents per column of the space.
    rows = [(i, " ".join([f"r{rng.randrange(10**7)}" for _ in range(4000)] + [f"c{k}" for k in rng.sample(range(400), 400)])) for i in range(400)]
    want = set()
    for d, (k, item) in enumerate(items[:2] + common):
        rows[d] = (d, planted(rows[d][1], item))
        want.add((d, k))
    for d, (k, item) in enumerate(items[2:], 100):
        rows[d] = (d, planted(rows[d][1], altered(item, d)))
        want.add((d, k))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items + common, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, bench).collect()} == want


def test_leaks_held_by_many_documents_are_found(spark):
    items = [(k, words(30, 700 + k)) for k in range(3)]
    rows, want = [], set()
    for i in range(1100):
        held = [k for k, share in enumerate((20, 3)) if i % share == 0] + [2] * (i % 20 == 1)
        for k in held:
            want.add((i, k))
        own = words(60, 20_000 + i)
        for k in held:
            own = planted(own, altered(items[k][1], i) if k == 2 else items[k][1])
        rows.append((i, own))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {p for p in got if p[1] < 2} == {p for p in want if p[1] < 2}
    assert got <= want and sum(k == 2 for _, k in got) >= 0.9 * sum(k == 2 for _, k in want)


def test_words_weigh_by_the_documents_that_hold_them(spark):
    texts = [f"all {'some' if i < 10 else 'else'} own{i} all" for i in range(40)] + [None, " "]
    hashed = lambda *w: next(text.word_hashes(*text.utf8(pa.array([" ".join(w)]))))[2]
    weights = decontam.word_weights(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), hashed("own3", "never"))
    want = [np.log(41 / (1 + n)) + 0.1 for n in (40, 10, 30, 1, 0, 1)]
    assert np.allclose(weights(hashed("all", "some", "else", "own3", "never", "own5")), want, atol=1e-5)


def test_masked_scores_are_log_probabilities(spark, docs):
    vocabulary, network = lm.learn(docs)
    around = np.full((lm.VOCABULARY, 2 * lm.SIDE), 3, np.int32)
    total = np.exp(network.log_probabilities(around, np.arange(lm.VOCABULARY))).sum()
    assert abs(total - 1) < 1e-3
    got = {r["doc_id"]: r for r in lm.score(docs, (vocabulary, network), ["doc_id"]).collect()}
    assert got[4]["n_words"] == 0 and got[4]["log_likelihood"] == 0 and got[4]["mean_log_likelihood"] is None
    assert got[9]["n_words"] == 30000 and got[9]["log_likelihood"] < 0
    hashes = next(text.word_hashes(*text.utf8(pa.array(["two words"]))))[2]
    a, b = vocabulary(hashes)
    edge = lm.VOCABULARY
    want = sum(
        float(network.log_probabilities(np.array([w], np.int32), np.array([c]))[0]) for w, c in (([edge, edge, b, edge], a), ([a, edge, edge, edge], b))
    )
    assert abs(got[7]["log_likelihood"] - want) < 1e-3


def test_licence_lines_are_found(spark):
    rows = [(i, words(20, i) + "\n" + words(9, i + 500)) for i in range(40)]
    rows += [(100, words(8, 1) + "\nReleased under the MIT License.\n"), (101, "This work is licensed under the GNU General Public License, version 3."), (102, None), (103, "")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("confirmed").collect()
    assert {(r["doc_id"], r["paragraph_no"], r["family"]) for r in found} == {(100, 1, "MIT"), (101, 0, "GPL")}


def test_frequent_lines_take_one_place_of_the_sample(spark):
    distinct = spark.createDataFrame([([f"w{i}", "of", "it"],) for i in range(100)], "words array<string>")
    first = distinct.orderBy(F.xxhash64("words")).limit(1)
    lines = distinct.union(first.crossJoin(spark.range(500)).select("words"))
    got = [tuple(r["words"]) for r in licenses._sampled(lines, 40).collect()]
    want = [tuple(r["words"]) for r in distinct.orderBy(F.xxhash64("words")).limit(40).collect()]
    assert sorted(got) == sorted(want)


def test_words_get_the_ids_of_the_whole_text():
    tok, rng = tokenids.tokenizer(), random.Random(3)
    signs = "'''stremvldSTREMVLD019.,-<|>!~abZÀÉÿßÞöØ×÷ªµ€́̌JjΣσİıК中‍😀²½"
    assert tok.splits
    for k in range(600):
        text = " ".join("".join(rng.choices(signs, k=rng.randint(1, 12))) for _ in range(rng.randint(0, 20)))
        text = [text, text.replace(" ", rng.choice("\n\t\x0b\xa0\x85\x1c")), "<|endoftext|>" + text, text + " <|EndOfText|>a"][k % 4]
        assert tok(text).tolist() == tok.tokenizer.encode(text, add_special_tokens=False).ids
    long = "x" * 5000
    assert tok(long + " " + long).tolist() == tok.tokenizer.encode(long + " " + long, add_special_tokens=False).ids
    assert not any(len(w) > tokenids.LONGEST for w in [*tok.known, *tok.pieces])


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    documents = spark.read.parquet(f"{ROOT}/documents.parquet")
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, ROOT), name)
        assert docs.columns == documents.columns
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    classes = brute_components(list(seen[0].items()), 5, 80)
    assert sorted(seen[1]) == sorted(i for i, v in classes.items() if v[1] == i) and set(seen[2]) <= set(seen[1])
    got = sorted(corpus_pipeline.STAGES[-1][1](spark, docs, ROOT).collect(), key=lambda r: r["doc_id"])
    at, tok = 0, tokenids.tokenizer().tokenizer
    for row, (doc_id, text) in zip(got, sorted(seen[3].items()), strict=True):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_random_strings_score_below_the_corpus(spark):
    """Most words of this corpus lie outside the vocabulary; strings of random letters are no likelier than they."""
    rng = np.random.default_rng(3)
    parts = ["ba", "ren", "to", "li", "mas", "ku", "ver", "an", "so", "din"]
    lexicon = ["".join(rng.choice(parts, 4)) for _ in range(9000)]
    rows = [(i, " ".join(rng.choice(lexicon, 120))) for i in range(300)]
    noise = [(1000 + i, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(120))) for i in range(2)]
    docs = spark.createDataFrame([*rows, *noise, (2000, None), (2001, " ")], "doc_id long, text string")
    got = {r.doc_id: r.mean_log_likelihood for r in lm.scored_documents(docs).collect()}
    assert got[2000] is None and got[2001] is None
    assert max(got[1000], got[1001]) < np.quantile([got[i] for i, _ in rows], 0.05)


def test_spelling_costs_equal_a_loop():
    texts = ["Ab a", None, "", "\u00e9ab  b\tAB", "x" * 70000 + " " + "ab " * 30000]
    data, offsets = text.utf8(pa.array(texts, pa.string()))
    pairs = np.zeros(lm.PAIRS, np.int64)
    runs = [(first, len(counts), len(words)) for first, counts, words in text.word_hashes(data, offsets)]
    for first, n, words in runs:
        lm._count_pairs(pairs, data, offsets, first, n, np.ones(words, bool))
    want = np.zeros((256, 256), np.int64)
    words = [w.lower().encode() for t in texts for w in (t or "").split()]
    for w in words:
        for a, b in zip(b" " + w, w + b" "):
            want[a, b] += 1
    assert (pairs.reshape(256, 256) == want).all()
    letters = lm.spelling(pairs)
    got = np.concatenate([lm._spelling_costs(letters, data, offsets, first, n) for first, n, _ in runs])
    assert np.allclose(got, [sum(letters[a, b] for a, b in zip(b" " + w, w + b" ")) for w in words])


def test_top_k_keeps_huge_components(spark):
    rows = [(0, [1e12, 0.0]), (20, [3e12, 1.0]), (3, [-2e12, 0.5]), (4, [0.25, 0.25]), (5, [1e300, -1e300]), (6, [float("inf"), 0.0])]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole = {i: [int(np.floor(64 * min(max(x, -(2.0**56)), 2.0**56))) for x in v] for i, v in rows[:5]}
    most = 2**63 - 1
    got = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()
    for q in (0, 20):
        scores = {i: min(max(sum(a * b for a, b in zip(whole[q], v)), -most), most) for i, v in whole.items() if i != q}
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == best


def test_postings_stop_early_and_agree_with_products():
    rng = np.random.default_rng(4)
    matrix = np.floor(64 * rng.normal(0, 0.1, (3000, 16))).astype(np.int64)
    matrix[:2500] //= 12  # most vectors are short: few can be among the best of a long query
    ids, queries = np.arange(3000) * 7 + 1, matrix[2400:2600]
    row, vector, score = topk.search(queries, ids[2400:2600], topk.segments(matrix), matrix, ids, 20)
    whole = queries @ matrix.T
    whole[np.arange(200), np.arange(2400, 2600)] = -(10**9)
    for i in range(200):
        own = np.flatnonzero(row == i)
        own = own[np.lexsort((ids[vector[own]], -score[own]))]
        best = np.lexsort((ids, -whole[i]))[:20]
        assert vector[own].tolist() == best.tolist() and score[own].tolist() == whole[i][best].tolist()


def test_lines_of_long_documents_and_clashing_names(spark):
    long = "\n".join(f"line {i}" for i in range(20_000))
    rows = [(i, long + f"\nown {i}", i, i, i, i) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, r1 int, _gone int, row int, lines int")
    linededup.drop_repeated_lines(df.limit(1).withColumn("text", F.lit("a\nb"))).collect()  # the time of the JVM's first run is not meant
    start = time.perf_counter()
    got = linededup.drop_repeated_lines(df).collect()
    assert time.perf_counter() - start < 20
    assert sorted((r["doc_id"], r["text"], r["r1"], r["_gone"], r["row"], r["lines"], r["_lines"], r["_dropped"]) for r in got) == [
        (i, f"own {i}", i, i, i, i, 20_001, 20_000) for i in range(10)
    ]


def test_stages_accept_columns_of_any_name(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, taken string, target string, _start string, _digest string"
    rows = [(i, words(30, i), "en", "a", 1, *"stuvwx") for i in range(30)]
    df = spark.createDataFrame(rows, names)
    for stage in (corpus_pipeline.toxic, corpus_pipeline.near_duplicates, corpus_pipeline.mixed):
        got = stage(spark, df, ROOT)
        assert got.columns == df.columns
        assert {tuple(r)[5:] for r in got.collect()} == {tuple("stuvwx")}


def test_rows_that_share_an_id_but_not_their_text_stay(spark):
    rows = [(1, words(40, 1)), (1, words(40, 2)), (1, words(40, 2)), (2, words(40, 3)), (None, words(40, 4))]
    got = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in got) == sorted({r[1] for r in rows})


def test_items_of_several_passes_and_rows_without_id(spark):
    items = [(k, words(20 + k, 700 + k)) for k in range(8)]
    rows = [(k, words(80, 800 + k) + " " + items[k][1] + " " + words(80, 900 + k)) for k in range(8)] + [(None, items[3][1]), (None, words(60, 5)), (None, None)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam._pairs(df, bench, at_once=3).where("doc_id IS NOT NULL").collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(k, k) for k in range(8)]
    assert sorted(map(str, (r["text"] for r in decontam.drop_contaminated(df, bench).collect()))) == sorted(["None", words(60, 5)])


def test_item_words_bound_every_common_subsequence():
    """Shared words and the bound equal plain counts, and only the leak's place is left to align."""
    rng = np.random.default_rng(5)
    common, rare = rng.integers(0, 1 << 63, 12).astype(np.uint64), rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    words = np.where(rng.random(4000) < 0.6, rng.choice(common, 4000), rng.choice(rare, 4000))
    items = [(k, np.where(rng.random(n) < 0.5, rng.choice(common, n), rng.choice(rare, n))) for k, n in enumerate([1, 4, 9, 30, 70] * 40)]
    items.append((len(items), words[1000:1030].copy()))
    own = decontam.ItemWords(items)
    numbers = own.number(words)
    begin, item = np.tile(np.arange(0, 4000, 40), len(items)), np.repeat(np.arange(len(items)), 100)
    end = np.minimum(begin + 90, 4000)
    shared, bound = own.shared(numbers, begin, end, item), own.bound(numbers, begin, end, item)
    assert own.entry.direct
    own.entry = decontam.Places(np.flatnonzero(own.entry.held >= 0).astype(np.uint64))
    assert (own.shared(numbers, begin, end, item) == shared).all() and (own.bound(numbers, begin, end, item) == bound).all()
    for c in rng.choice(len(item), 1500, replace=False).tolist():
        span, text = items[item[c]][1], words[begin[c] : end[c]]
        assert shared[c] == np.isin(text[: decontam.WINDOW], span).sum()
        assert bound[c] == sum((Counter(span.tolist()) & Counter(text.tolist())).values()) >= decontam.common_subsequence(span, text)
    lengths = np.array([len(w) for _, w in items])[item]
    left = (bound >= decontam.COVER * lengths) & (lengths >= decontam.LEAST_WORDS)
    assert left[(item == len(items) - 1) & (begin <= 1000) & (end >= 1030)].all()
    assert left.sum() < len(left) / 2


def test_places_of_crowded_slots():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64))
    places = decontam.Places(keys)
    assert len(places.rest)
    assert (places(keys) == np.arange(len(keys))).all()
    assert (places(keys + np.uint64(1)) == np.where(np.isin(keys + np.uint64(1), keys), np.searchsorted(keys, keys + np.uint64(1)), -1)).all()


def test_batches_of_texts_have_the_ids_of_each_text(monkeypatch):
    monkeypatch.setattr(tokenids, "AT_ONCE", 200)
    tok, rng = tokenids.WordTokenizer(pytest.importorskip("public_tokenizers").path(tokenids.TOKENIZER)), random.Random(4)
    kinds = ["the", "The,", "don't", "ñandú", "ÀÉß", "x" * 70, "1234", "日本", "a b", "<|ENDOFTEXT|>", "<|endoftext|>", "ﬁ", "-'ll-"]
    texts = [None, "", " \t\n", *("".join(rng.choice(kinds) + rng.choice(" \t\n\x0b\x0c\r ") for _ in range(rng.randrange(40))) for _ in range(60))]
    rows = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    sizes = [b.num_rows for b in tokenids._together(iter([rows.slice(0, 20), rows.slice(20)]))]
    assert len(sizes) > 5 and sum(sizes) == len(texts)
    for _ in range(2):
        got = [ids.tolist() for _, ids in tokenids._tokenised(iter([rows.slice(0, 20), rows.slice(20)]), tok)]
        assert got == [tok.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not any(len(w) > tokenids.LONGEST for w in [*tok.known, *tok.pieces])


def test_plain_words_are_taken_apart_together_and_lanes_are_many():
    tok, rng = tokenids.WordTokenizer(pytest.importorskip("public_tokenizers").path(tokenids.TOKENIZER)), random.Random(5)
    texts = [" ".join("".join(rng.choices("abÀéZ09.,-<|", k=rng.randint(1, 9))) for _ in range(rng.randrange(30))) for _ in range(200)]
    ids, ends = tok.batch(pa.array([*texts, None, "don't", "日本"], pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [tok.tokenizer.encode(t, add_special_tokens=False).ids for t in [*texts, "", "don't", "日本"]]
    assert set(tok.known) == {"don't", "日本"}  # no word of letters, digits and signs is looked up by itself
    ids = np.random.default_rng(5).zipf(1.3, 1 << 20).clip(1, 49000).astype(np.uint32)
    block = idcodec.encode_block(ids, 49408)
    assert int.from_bytes(block[8:12], "little") == 8192  # numpy's calls are per step of all lanes
    assert (idcodec.decode_block(block) == ids).all()
    assert (idcodec.decode_block(idcodec.encode_block(ids[:90000], 49408, 2048)) == ids[:90000]).all()


def test_the_driver_never_fits_the_classifier_nor_holds_features(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"{'awful' if k % 2 else 'lovely'} thing {k}") for k in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    monkeypatch.setattr(toxicity, "fit", lambda *args: pytest.fail("fitted on the driver"))
    weights, bias = toxicity.train(docs, labels)
    assert weights.shape == (1 << toxicity.FEATURE_BITS,) and weights.any()
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, (weights, bias), ["doc_id"]).collect()}
    assert min(scores[k] for k in range(1, 60, 2)) > max(scores[k] for k in range(0, 60, 2))


def test_a_batch_of_windows_works_on_all_classes_together(monkeypatch):
    rng = np.random.default_rng(6)
    around = rng.integers(0, lm.VOCABULARY + 1, (lm.BATCH, 2 * lm.SIDE)).astype(np.int32)
    centre = np.sort(rng.integers(0, lm.VOCABULARY, lm.BATCH)).astype(np.int32)
    exps = []
    exp = np.exp
    monkeypatch.setattr(lm.np, "exp", lambda *args, **named: exps.append(1) or exp(*args, **named))
    net = lm.Network.start()
    net.train(around, centre, 0.3)
    net.embed *= 30  # also logits that differ by more than SPREAD
    net.words[:, -1] += np.linspace(-90, 90, lm.CLASSES, dtype=np.float32)
    got = net.log_probabilities(around, centre)
    assert len(exps) == 4  # classes and words, for training and for scores; not once per class
    hidden = net.hidden(around).astype(np.float64)
    want = np.zeros(len(centre))
    for k, c in enumerate(centre):
        for logits, at in ((hidden[k] @ net.classes, c // lm.CLASSES), (hidden[k] @ net.words[c // lm.CLASSES], c % lm.CLASSES)):
            want[k] += logits[at] - logits.max() - np.log(exp(logits - logits.max()).sum())
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)

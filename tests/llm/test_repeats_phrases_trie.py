"""Repeated windows, phrases and the prefix trie against brute force, on literal rows with odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vacantlens.llm import collocations, prefixtrie, repeats, stream
from vacantlens.llm.text import utf8


def prose(n, seed, vocabulary=3000):
    rng = random.Random(seed)
    return " ".join("w%d" % rng.randrange(vocabulary) for _ in range(n))


def test_words_are_python_words_and_hash_alike():
    texts = ["a b  c", "", None, "ab c", "A\x0bb", "x" * (stream.SLICE + 5) + " y", prose(300_000, 2), " lead ", "é é e"]
    data, offsets = utf8(pa.array(texts))
    got = stream.words_of(data, offsets, repeats.BLANK, stream.same_bytes())
    own = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    assert [data[a:b].tobytes() for a, b in zip(got.starts, got.ends)] == own
    assert got.counts.tolist() == [len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for t in texts]
    by_word = dict(zip(own, got.hashes.tolist()))
    assert [by_word[w] for w in own] == got.hashes.tolist() and len(set(by_word.values())) == len(by_word)


# --- repeated windows ---------------------------------------------------------------------------


def brute_kept(texts, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.fixture(scope="module")
def repeated():
    shared = prose(60, 1)
    hot = prose(45, 2)
    texts = [
        shared, "A " + shared + " end", "a " + shared.upper() + " end", None, "", " \n\t ", "too few words",
        prose(50, 3) + "\n" + shared[: len(shared) // 2] + " x " + shared[len(shared) // 2 :],
        # Repeats inside one document, overlapping ones among them.
        " ".join(["again"] * 90), prose(40, 4) + " " + prose(40, 4), ("p q r " * 30).strip(),
        prose(20000, 5), "z" * 300_000, "É é " * 40,
    ]
    texts += [f"{hot} tail{i}" for i in range(150)] + [prose(34, 6)] * 3 + [prose(35, 7)] * 2
    return texts


@pytest.mark.parametrize("pack,parts", [(4 << 20, 1), (3000, 5)])
@pytest.mark.parametrize("size", [35, 5])
def test_repeats_equal_brute_force(spark, repeated, monkeypatch, size, pack, parts):
    monkeypatch.setattr(repeats, "PACK", pack)
    rows = [(i % 40 or None, t, "kept", "a", i) for i, t in enumerate(repeated)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk string, body string, _words long").repartition(parts)
    got = repeats.remove_repeats(docs.withColumnRenamed("_words", "place"), size=size)
    expected = brute_kept(repeated, size)
    found = {r["place"]: r for r in got.collect()}
    assert len(found) == len(repeated)
    for i, (n, removed, kept) in enumerate(expected):
        assert (found[i]["_words"], found[i]["_removed"], found[i]["text"]) == (n, removed, kept), i
        assert found[i]["chunk"] == "kept" and found[i]["doc_id"] == (i % 40 or None)


def test_repeats_replace_a_clashing_count_and_take_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 9), (2, None, 9)], "doc_id long, text string, _words long")
    assert sorted(map(tuple, repeats.remove_repeats(docs).select("doc_id", "_words", "_removed").collect())) == [(1, 2, 0), (2, 0, 0)]
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 50, 400).astype(np.uint32))
    shares = [np.unique(part, return_counts=True) for part in np.array_split(rng.permutation(keys), 7)]
    table = pa.concat_tables([repeats._shares(i, np.zeros(len(k), np.int64), [k], n > 1) for i, (k, n) in enumerate(shares)])
    answers = repeats._answer(table, np.uint32, 1)
    times = Counter(keys.tolist())
    for i, (k, _) in enumerate(shares):
        bits = repeats._answered(answers.slice(i, 1), np.zeros(len(k), np.int64))
        assert bits.tolist() == [times[x] > 1 for x in k.tolist()]


# --- phrases --------------------------------------------------------------------------------------


def brute_phrases(rows, least, most_words, percent, per_lang):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most_words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for q, a in frequent.items():
            for size in range(2, len(q)):
                for i in range(len(q) - size + 1):
                    longer[q[i : i + size]] = max(longer[q[i : i + size]], a)
        found = []
        for p, a in frequent.items():
            if 100 * longer[p] >= percent * a:
                continue
            score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:per_lang], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def phrased():
    rng = random.Random(4)
    rows = [("en", None), (None, ""), (None, "Red, green blue. red  Green\tblue\nred green\x0bblue" * 9), ("", "a b a b a b"), ("en", " . , ;")]
    for i in range(120):
        words = [f"w{int(rng.paretovariate(0.8)) % 40}" for _ in range(rng.randrange(1, 60))]
        words = [w + rng.choice(["", "", "", "", ",", ".", "\n"]) for w in words]
        rows.append((rng.choice(["en", "de", None]), " ".join(words).replace("w1 ", "É1 ").replace("w2 ", "É1 ")))
    return rows + [("de", "hot pair here")] * 200 + [("de", "tie%d tie%d" % (i, i) + " x" * 3) for i in range(5) for _ in range(10)]


@pytest.mark.parametrize("most_words,budget,per_lang", [(3, 10**6, 2000), (3, 60, 7), (4, 25, 50), (2, 40, 3)])
def test_phrases_equal_brute_force(spark, phrased, monkeypatch, most_words, budget, per_lang):
    monkeypatch.setattr(collocations, "CHUNK", 2000)
    docs = spark.createDataFrame([(*r, 1, 1, "x") for r in phrased], "lang string, text string, h long, n long, words string").repartition(3)
    got = collocations.collocations(docs, 2, most_words, least=5, percent=50, per_lang=per_lang, budget=budget)
    assert sorted(map(tuple, got.collect())) == brute_phrases(phrased, 5, most_words, 50, per_lang)


def test_phrases_of_empty_tables(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(docs).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    row = spark.sql(
        "SELECT (CAST(a AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)) * 1000000) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0))) AS s "
        "FROM VALUES (3000000000001L, 3000000000007L, 3000000000011L) AS t(a, l, r)"
    ).first()
    assert row["s"] == 10**6 * 3000000000001**2 // (3000000000007 * 3000000000011)


# --- prefix trie ------------------------------------------------------------------------------------


def brute_trie(rows):
    kept = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            kept[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    plain = {c: [t[2:] for t in sorted(turns)] for c, turns in kept.items()}
    built = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(plain.get(base, [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)

    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if built[c] == p)))
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else -1, len(members), len(children[p]),
            sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(9)
    rows = [(None, 0, "user", "lost"), (-5, 0, "user", "minus"), (7, 0, None, None), (7, None, "user", "first"), (7, 0, "", ""), (1 << 60, 0, "user", "far away")]
    # One opening that most share, long talks, and one talk that many repeat whole.
    for c in range(20, 140):
        if c == 60:
            continue
        rows += [(c, t, "user", f"say {rng.randrange(3)} \n more" if t < 4 else f"x{rng.randrange(2)}") for t in range(rng.randrange(1, 6))]
    for c in range(200, 260):
        rows += [(c, t, "assistant", f"same {t}") for t in range(6)]
    for c in (300, 301, 302):
        rows += [(c, t, "user", f"long {t if t < 37 else c * t}") for t in range(60)]
    return rows


@pytest.mark.parametrize("last,stretch,block,run", [(2000, 1024, 65536, 4096), (5, 8, 16, 7)])
def test_trie_equals_brute_force(spark, talks, monkeypatch, last, stretch, block, run):
    for name, value in (("STRETCH", stretch), ("BLOCK", block), ("RUN", run)):
        monkeypatch.setattr(prefixtrie, name, value)
    rows = talks[:]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, c long, pos long")
    members, turns = prefixtrie.shared_heads(prefixtrie.ordered_turns(table.repartition(4)))
    got = prefixtrie.prefix_trie(members, turns, last=last).collect()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == brute_trie(talks)


def test_trie_of_turnless_and_missing_conversations(spark):
    # 21 takes its first turns from 20, which is absent, and may be left without any.
    rows = [(c, 0, "user", "only") for c in range(21, 40)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    members, turns = prefixtrie.shared_heads(prefixtrie.ordered_turns(table))
    got = sorted(tuple(-1 if v is None else v for v in r) for r in prefixtrie.prefix_trie(members, turns).collect())
    assert got == brute_trie(rows) and got[0][3] == 19
    members, turns = prefixtrie.shared_heads(prefixtrie.ordered_turns(table.limit(0)))
    assert prefixtrie.prefix_trie(members, turns).count() == 0


def test_ranking_a_plain_list(spark):
    rng = random.Random(3)
    order = [(rng.randrange(10**15), i) for i in range(700)]
    lengths = [rng.randrange(1, 5) for _ in order]
    rows = [(*order[i], *(order[i + 1] if i < 699 else (None, None)), lengths[i]) for i in range(700)]
    rng.shuffle(rows)
    got = prefixtrie.ranked(spark.createDataFrame(rows, "c long, z long, nc long, nz long, len long"), last=20).collect()
    starts = [0, *np.cumsum(lengths)[:-1].tolist()]
    assert {(r["c"], r["z"]): r["pos"] for r in got} == dict(zip(order, starts))

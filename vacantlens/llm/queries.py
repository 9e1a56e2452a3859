"""One query per operator over its whole table, with production parameters, and SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantlens.llm import collocations, decontam, licenses, linededup, lm, minhash, mixing, prefixtrie, repeats, tokenids, topk, toxicity, warc
from vacantlens.session import ship


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{root}/{name}.parquet")


def op1_warc(spark: SparkSession, root: str) -> DataFrame:
    """Every page through WARC archives: its payload's size, digest and kind of record."""
    return warc.archived_pages(_table(spark, root, "pages"), least_bytes=0)


def op2_minhash(spark: SparkSession, root: str) -> DataFrame:
    """Near-duplicate components over distinct 4-word shingles at 80 percent."""
    return minhash.near_duplicates(_table(spark, root, "documents"), shingle=4, percent=80)


def op3_lm_scores(spark: SparkSession, root: str) -> DataFrame:
    """Masked pseudo-likelihood of every document."""
    return lm.scored_documents(_table(spark, root, "documents"))


def op4_licenses(spark: SparkSession, root: str) -> DataFrame:
    """Every licence paragraph with its family."""
    return licenses.scan(_table(spark, root, "documents"))


def op5_mix(spark: SparkSession, root: str) -> DataFrame:
    """The words the mix takes of every document."""
    return mixing.plan_mix(_table(spark, root, "documents"), ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op6_topk(spark: SparkSession, root: str) -> DataFrame:
    """The 20 highest inner products of every 20th vector."""
    vectors = topk.quantised(_table(spark, root, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op7_toxicity(spark: SparkSession, root: str) -> DataFrame:
    """Every document's toxicity, learnt from rows that are not held out."""
    docs, labels = _table(spark, root, "documents"), _table(spark, root, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    scores = toxicity.scored(docs, model, ["doc_id"])
    return scores.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_token_ids(spark: SparkSession, root: str) -> DataFrame:
    """Every document's place and checksum in the token-id files."""
    return tokenids.encoded_documents(_table(spark, root, "documents"))


def op9_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Lines found in 10 documents or more leave every document."""
    kept = linededup.drop_repeated_lines(_table(spark, root, "documents").select("doc_id", "text"), least_docs=10, least_chars=1)
    return kept.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op10_decontaminate(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return decontam.contaminated(_table(spark, root, "documents"), _table(spark, root, "benchmark"))


def op11_prefix_trie(spark: SparkSession, root: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations with its subtree's leaves and savings."""
    turns = prefixtrie.ordered_turns(_table(spark, root, "conversations"))
    return prefixtrie.prefix_trie(*prefixtrie.shared_heads(turns, every=20, most=4))


def op12_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Words of 35-word windows that stand elsewhere too leave every document."""
    kept = repeats.remove_repeats(_table(spark, root, "documents").select("doc_id", "text"), size=35)
    return kept.select("doc_id", F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, root: str) -> DataFrame:
    """Each language's 2,000 strongest phrases of two or three words."""
    return collocations.collocations(_table(spark, root, "documents"), 2, 3, least=10, percent=50, per_lang=2000)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_minhash": op2_minhash,
    "op3_lm_scores": op3_lm_scores,
    "op4_licenses": op4_licenses,
    "op5_mix": op5_mix,
    "op6_topk": op6_topk,
    "op7_toxicity": op7_toxicity,
    "op8_token_ids": op8_token_ids,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_collocations": op13_collocations,
}

_UPPER, _LOWER = linededup.UPPER, linededup.LOWER

ORACLES = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        s AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex,
                     max(page_id) OVER (PARTITION BY sha1(html), strlen(html)) AS last FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 CAST(((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM s
    """,
    "op2_minhash": f"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
          FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS sh FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS s FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        c AS (SELECT doc_id AS id, doc_id AS reached FROM documents UNION SELECT c.id, l.b FROM c JOIN l ON c.reached = l.a),
        m AS (SELECT id, min(reached) AS component_id FROM c GROUP BY id)
        SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
        FROM s JOIN m ON m.id = s.doc_id
    """,
    "op6_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op9_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM
                     (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
        f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN f.key IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN f ON f.key = k.key GROUP BY doc_id
    """,
    "op11_prefix_trie": """
        WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS pos,
                     length(role) || ':' || role || text AS one, len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS w FROM t),
        -- CRC-32 of the decimal id: a byte is added, then eight shifts.
        z AS (SELECT c, n, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
                       lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                       lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295) % 4 AS h
              FROM (SELECT c, max(pos) AS n FROM o GROUP BY c)),
        m AS (SELECT a.c, a.base, a.h, least(a.h, coalesce(b.n, 0)) AS taken FROM z a LEFT JOIN z b ON b.c = a.base),
        r AS (SELECT m.c, pos AS k, one, w FROM m JOIN o ON o.c = m.base AND pos <= taken
              UNION ALL SELECT m.c, pos - h + taken, one, w FROM m JOIN o ON o.c = m.c AND pos > h),
        s AS (SELECT m.c, coalesce(l, []) AS l, coalesce(ws, []) AS ws FROM m LEFT JOIN (SELECT c, list(one ORDER BY k) AS l, list(w ORDER BY k) AS ws FROM r GROUP BY c) USING (c)),
        p AS (SELECT c, d, l[1:d] AS key, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, d = len(l) AS here FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM s)),
        n AS (SELECT key, d, min(c) AS c, count(*) AS n, max(w) AS w, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (here), '') AS ids FROM p GROUP BY key, d),
        b AS (SELECT p.c AS member, p.d, n.c FROM p JOIN n ON n.key = p.key AND n.d = p.d),
        u AS (SELECT n.c, n.d, b.c AS parent FROM n JOIN b ON b.member = n.c AND b.d = n.d - 1),
        k AS (SELECT parent AS c, d - 1 AS d, count(*) AS children FROM u GROUP BY parent, d),
        v AS (SELECT b.c, b.d, count(*) FILTER (k.children IS NULL) AS leaves, sum((n.n - 1) * n.w) AS saved
              FROM n JOIN b ON b.member = n.c AND b.d <= n.d LEFT JOIN k ON k.c = n.c AND k.d = n.d GROUP BY b.c, b.d)
        SELECT n.c AS conv_id, n.d AS depth, u.parent AS parent_conv_id, n.n AS n_convs, coalesce(k.children, 0) AS n_children,
               v.leaves AS n_leaves, CAST(v.saved AS BIGINT) AS saved_tokens, sha256(n.ids) AS ends_sha256
        FROM n JOIN v ON v.c = n.c AND v.d = n.d LEFT JOIN u ON u.c = n.c AND u.d = n.d LEFT JOIN k ON k.c = n.c AND k.d = n.d
    """,
    "op12_substring_dedup": """
        WITH w AS (SELECT doc_id, row_number() OVER () AS r,
                          list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        p AS (SELECT r, unnest(range(1, len(ws) - 33)) AS i, ws FROM w WHERE len(ws) >= 35),
        k AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS key FROM p),
        d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY key) AS n FROM k) WHERE n > 1),
        g AS (SELECT r, list(DISTINCT place) AS gone FROM (SELECT r, unnest(range(i, i + 35)) AS place FROM d) GROUP BY r)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1),
                 lambda i: NOT list_contains(gone, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
        FROM w LEFT JOIN g USING (r)
    """,
    "op13_collocations": """
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
        g AS (SELECT lang, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS ph, k FROM w, (VALUES (1), (2), (3)) v(k)),
        f AS (SELECT lang, ph, k, count(*) AS f FROM g GROUP BY lang, ph, k),
        c AS (SELECT lang, ph, k, f AS a, string_split(ph, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
        cut AS (SELECT lang, ph, a, k, ws, unnest(range(1, k)) AS j FROM c),
        s AS (SELECT cut.lang, cut.ph, cut.a, j, l.f AS l, r.f AS r,
                     CAST((CAST(1000000 AS HUGEINT) * cut.a * cut.a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
              FROM cut JOIN f l ON l.lang = cut.lang AND l.ph = array_to_string(ws[1:j], ' ') JOIN f r ON r.lang = cut.lang AND r.ph = array_to_string(ws[j + 1:], ' ')),
        best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, j) = 1),
        longer AS (SELECT lang, ph, max(a) AS a FROM (SELECT lang, array_to_string(ws[1:2], ' ') AS ph, a FROM c WHERE k = 3
                     UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE k = 3) GROUP BY lang, ph),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        r AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.ph) AS rank, b.ph AS phrase, b.a, b.l, b.r, n.n, b.score
              FROM best b JOIN n ON n.lang = b.lang LEFT JOIN longer o ON o.lang = b.lang AND o.ph = b.ph
              WHERE o.a IS NULL OR 100 * o.a < 50 * b.a)
        SELECT * FROM r WHERE rank <= 2000
    """,
}

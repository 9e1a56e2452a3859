"""Fuzzy, vector, combined and level-restricted top-k matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantlens.operators.incremental import distinct_keys, pending_keys
from vacantlens.operators.match import candidate_table, match_topk
from vacantlens.operators.similarity import similarity_join
from vacantlens.sources.tables import table, text_table


def part_names(spark: SparkSession, root: str) -> DataFrame:
    """Catalog of distinct part names; the code is the first part that has the name."""
    return table(spark, root, "part").groupBy("p_name").agg(F.min("p_partkey").alias("code"))


def token_set_topk(spark: SparkSession, root: str) -> DataFrame:
    """Three most similar part names of every distinct conversation turn."""
    keys = distinct_keys(text_table(spark, root, "conversations"), "text")
    return match_topk(keys, part_names(spark, root), "text", "code", "code", key_text="text", catalog_text="p_name", k=3)


def pending_title_matches(spark: SparkSession, root: str) -> DataFrame:
    """Candidate rows for page headings not matched before, against the benchmark texts."""
    titles = text_table(spark, root, "pages").select(
        F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1).alias("title")
    )
    seen = text_table(spark, root, "conversations").select(F.col("text").alias("title"))
    catalog = table(spark, root, "benchmark")
    matches = match_topk(
        pending_keys(titles, seen, "title"), catalog, "title", "item_id", "item_id", key_text="title", catalog_text="text", k=2
    )
    return candidate_table(matches, catalog, "item_id", ["text"])


def cosine_topk(spark: SparkSession, root: str) -> DataFrame:
    """Three nearest vectors of every vector, itself among them."""
    vectors = table(spark, root, "embeddings")
    keys = vectors.select(F.col("vec_id").alias("key"), "embedding")
    return match_topk(keys, vectors, "key", "vec_id", "vec_id", key_vector="embedding", catalog_vector="embedding", k=3)


def combined_best(spark: SparkSession, root: str) -> DataFrame:
    """Best part names of every benchmark item by the larger of text and vector score."""
    vectors = table(spark, root, "embeddings").select("vec_id", "embedding")
    keys = table(spark, root, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id"), "left")
    catalog = part_names(spark, root).join(vectors, F.col("code") == F.col("vec_id"), "left")
    return match_topk(
        keys, catalog, "item_id", "code", "code", key_text="text", catalog_text="p_name",
        key_vector="embedding", catalog_vector="embedding", k=5,
    )


def level_restricted_match(spark: SparkSession, root: str) -> DataFrame:
    """Nearest vectors among the levels a key asks for; keys of label 0 ask for none."""
    vectors = table(spark, root, "embeddings")
    wanted = F.when(F.col("label") == 0, F.array().cast("array<int>")).otherwise(
        F.array(F.col("label"), (F.col("label") * 3).cast("int"), F.col("label") - 1)
    )
    keys = vectors.select(F.col("vec_id").alias("key"), "embedding", wanted.alias("levels"))
    return match_topk(
        keys, vectors, "key", "vec_id", "vec_id", key_vector="embedding", catalog_vector="embedding",
        level="label", search_levels="levels", k=3,
    )


def sentences(spark: SparkSession, root: str, name: str, most: int) -> DataFrame:
    """Distinct sentences of a table's texts with 12 to ``most`` characters. Telling texts apart deals them out, so whole texts needn't be."""
    parts = F.transform(F.split(F.coalesce("text", F.lit("")), r"[.\n]"), lambda part: F.trim(part))
    found = table(spark, root, name).select(F.explode(parts).alias("sentence"))
    return found.where(F.char_length("sentence").between(12, most)).distinct()


def similar_sentences(spark: SparkSession, root: str) -> DataFrame:
    """Every pair of a short sentence of a conversation and one of a document that score 90 or more."""
    keys, names = sentences(spark, root, "conversations", 40), sentences(spark, root, "documents", 55)
    return similarity_join(
        keys, names.withColumnRenamed("sentence", "name"), "sentence", "name", "sentence", "name", threshold=90
    )


QUERIES = {
    "similar_sentences": similar_sentences,
    "token_set_topk": token_set_topk,
    "pending_title_matches": pending_title_matches,
    "cosine_topk": cosine_topk,
    "combined_best": combined_best,
    "level_restricted_match": level_restricted_match,
}


# --- SQL checks -------------------------------------------------------------------------

_PART_NAMES = "SELECT p_name, min(p_partkey) AS code FROM part GROUP BY p_name"


def _comparable(x: str) -> str:
    plain = rf"regexp_replace(lower(trim({x}, ' ' || chr(10) || chr(9))), '[\x{{80}}-\x{{ff}}]', '', 'g')"
    return rf"trim(regexp_replace({plain}, '[^\p{{L}}\p{{N}}_]', ' ', 'g'))"


def token_set_sql(keys: str, catalog: str) -> str:
    """CTEs up to ``fuzzy(kid, cid, score)`` for keys(kid, kt) and catalog(cid, ct).

    The longest common subsequence runs over the letters of the key with one bit per letter
    of the catalog rest, so catalog texts must stay below 60 letters.
    """
    words = r"list_sort(list_distinct(list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')))"
    return f"""
      ka AS (SELECT kid, {words.format(_comparable('kt'))} AS a FROM ({keys})),
      cb AS (SELECT cid, {words.format(_comparable('ct'))} AS b FROM ({catalog})),
      sets AS (SELECT kid, cid, list_filter(a, lambda w: list_contains(b, w)) AS s, list_filter(a, lambda w: NOT list_contains(b, w)) AS da,
                      list_filter(b, lambda w: NOT list_contains(a, w)) AS db, len(a) AS na, len(b) AS nb FROM ka, cb),
      rest AS (SELECT kid, cid, na, nb, len(s) AS ns, len(array_to_string(s, ' ')) AS ls, array_to_string(da, ' ') AS da,
                      array_to_string(db, ' ') AS db FROM sets),
      -- One mask per letter of each catalog rest, then a fold over the letters of the key rest.
      masks AS (SELECT db, map_from_entries(list_transform(list_distinct(string_split(db, '')), lambda c: row(c,
                       CAST(list_sum(list_transform(range(len(db)), lambda i: CASE WHEN db[i + 1] = c THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT)))) AS m
                FROM (SELECT DISTINCT db FROM rest WHERE db <> '')),
      folded AS (SELECT da, r.db, list_reduce(list_prepend((CAST(1 AS BIGINT) << len(r.db)) - 1,
                          list_transform(string_split(da, ''), lambda c: coalesce(m[c], 0))),
                          lambda v, x: ((v + (v & x)) | (v - (v & x))) & ((CAST(1 AS BIGINT) << len(r.db)) - 1)) AS v
                 FROM (SELECT DISTINCT da, db FROM rest WHERE da <> '' AND db <> '') r JOIN masks ON masks.db = r.db),
      common AS (SELECT da, db, len(db) - bit_count(v) AS lcs FROM folded),
      sized AS (SELECT kid, cid, na, nb, ns, ls, len(r.da) AS la, len(r.db) AS lb, coalesce(lcs, 0) AS lcs, CAST(ns > 0 AS INT) AS g
                FROM rest r LEFT JOIN common c ON c.da = r.da AND c.db = r.db),
      scored AS (SELECT *, 100.0::DOUBLE - CAST(100 * (la + lb - 2 * lcs) AS DOUBLE) / nullif(2 * (ls + g) + la + lb, 0) AS r1,
                        100.0::DOUBLE - CAST(100 * (g + la) AS DOUBLE) / nullif(2 * ls + g + la, 0) AS r2,
                        100.0::DOUBLE - CAST(100 * (g + lb) AS DOUBLE) / nullif(2 * ls + g + lb, 0) AS r3 FROM sized),
      fuzzy AS (SELECT kid, cid, CAST(CASE WHEN na = 0 OR nb = 0 THEN 0 WHEN ns > 0 AND (la = 0 OR lb = 0) THEN 100
                     WHEN ns = 0 THEN round_even(r1, 0) ELSE round_even(greatest(r1, r2, r3), 0) END AS BIGINT) AS score FROM scored)"""


def _cosine(a: str, b: str) -> str:
    return f"CAST(trunc(100 * round_even(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) * 1e9, 0) / 1e9) AS BIGINT)"


def _sentences(name: str, most: int) -> str:
    return (
        f"SELECT DISTINCT trim(p) AS t FROM (SELECT unnest(string_split_regex(coalesce(text, ''), '[.\\n]')) AS p FROM {name}) "
        f"WHERE length(trim(p)) BETWEEN 12 AND {most}"
    )


_HEADINGS = r"""SELECT title AS cid, title AS ct FROM (SELECT DISTINCT regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS title FROM pages)
      WHERE title NOT IN (SELECT text FROM conversations WHERE text IS NOT NULL)"""

ORACLES = {
    # The score is the same both ways; headings are short enough for the letter masks, items are not.
    "pending_title_matches": f"""
      WITH {token_set_sql("SELECT item_id AS kid, text AS kt FROM benchmark", _HEADINGS)},
      ranked AS (SELECT cid AS title, kid AS item_id, CAST(0 AS BIGINT) AS semantic_confidence, score AS fuzzy_confidence, score AS best_confidence,
                        row_number() OVER (PARTITION BY cid ORDER BY score DESC, kid) AS rank FROM fuzzy)
      SELECT ranked.*, text, 0 AS validated, CAST(NULL AS VARCHAR) AS validated_code, CAST(NULL AS VARCHAR) AS validated_name,
             CAST(NULL AS VARCHAR) AS notes FROM ranked LEFT JOIN benchmark USING (item_id) WHERE rank <= 2""",
    # Lengths tell most pairs apart: without a common word the shorter text must have 81 % of the longer one's letters.
    "similar_sentences": f"""
      WITH {token_set_sql(f"SELECT t AS kid, t AS kt FROM ({_sentences('conversations', 40)})", f"SELECT t AS cid, t AS ct FROM ({_sentences('documents', 55)})")
            .replace("FROM ka, cb)", "FROM ka, cb WHERE len(list_intersect(a, b)) > 0 OR 100 * least(len(array_to_string(a, ' ')), len(array_to_string(b, ' '))) >= 81 * greatest(len(array_to_string(a, ' ')), len(array_to_string(b, ' '))))")}
      SELECT kid AS sentence, cid AS name, score FROM fuzzy WHERE score >= 90""",
    "token_set_topk": f"""
      WITH {token_set_sql("SELECT DISTINCT text AS kid, text AS kt FROM conversations WHERE text IS NOT NULL", f"SELECT code AS cid, p_name AS ct FROM ({_PART_NAMES})")},
      ranked AS (SELECT kid AS text, cid AS code, CAST(0 AS BIGINT) AS semantic_confidence, score AS fuzzy_confidence, score AS best_confidence,
                        row_number() OVER (PARTITION BY kid ORDER BY score DESC, cid) AS rank FROM fuzzy)
      SELECT * FROM ranked WHERE rank <= 3""",
    "cosine_topk": f"""
      WITH s AS (SELECT k.vec_id AS key, c.vec_id, {_cosine('k.embedding', 'c.embedding')} AS score FROM embeddings k, embeddings c),
      ranked AS (SELECT key, vec_id, score AS semantic_confidence, CAST(0 AS BIGINT) AS fuzzy_confidence, score AS best_confidence,
                        row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0)
      SELECT * FROM ranked WHERE rank <= 3""",
    "combined_best": f"""
      WITH {token_set_sql("SELECT item_id AS kid, text AS kt FROM benchmark", f"SELECT code AS cid, p_name AS ct FROM ({_PART_NAMES})")},
      sem AS (SELECT f.*, greatest(coalesce({_cosine('k.embedding', 'c.embedding')}, 0), 0) AS sem
              FROM fuzzy f LEFT JOIN embeddings k ON k.vec_id = kid LEFT JOIN embeddings c ON c.vec_id = cid),
      ranked AS (SELECT kid AS item_id, cid AS code, sem AS semantic_confidence, score AS fuzzy_confidence, greatest(sem, score) AS best_confidence,
                        row_number() OVER (PARTITION BY kid ORDER BY greatest(sem, score) DESC, cid) AS rank FROM sem)
      SELECT * FROM ranked WHERE rank <= 5""",
    "level_restricted_match": f"""
      WITH k AS (SELECT vec_id AS key, embedding, unnest(list_distinct([label, label * 3, label - 1])) AS lv FROM embeddings WHERE label <> 0),
      s AS (SELECT key, c.vec_id, {_cosine('k.embedding', 'c.embedding')} AS score FROM k JOIN embeddings c ON c.label = lv),
      ranked AS (SELECT key, vec_id, score AS semantic_confidence, CAST(0 AS BIGINT) AS fuzzy_confidence, score AS best_confidence,
                        row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0)
      SELECT * FROM ranked WHERE rank <= 3""",
}

"""Repeat postings, requirement stability, variants and regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantlens.operators import filters, repeats
from vacantlens.operators.quantiles import describe
from vacantlens.plans.pay import rounded
from vacantlens.plans.sql import mean, norm, r, total
from vacantlens.sources.tables import table, text_table


def titled_lines(spark: SparkSession, root: str) -> DataFrame:
    """A line item as a posting: supplier = institution, part name = title, ship date = posting date."""
    line = table(spark, root, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate")
    part = table(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"))
    return line.join(part, "l_partkey").select(F.col("l_suppkey").alias("institution"), "title", "l_shipdate")


def dated_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every document with the date and customer of the order of the same number, if there is one."""
    orders = table(spark, root, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate", "o_custkey")
    return text_table(spark, root, "documents").join(orders, "doc_id", "left")


def pair_repetition(spark: SparkSession, root: str) -> DataFrame:
    return repeats.pair_repetition(titled_lines(spark, root), "institution", "title", top=20)


def repetition_describe(spark: SparkSession, root: str) -> DataFrame:
    counts = repeats.pair_repetition(titled_lines(spark, root), "institution", "title")
    return rounded(describe(counts, "rows"), 4, "mean", "std", "q25", "q50", "q75")


def repeat_postings(spark: SparkSession, root: str) -> DataFrame:
    return repeats.repeat_postings(titled_lines(spark, root), "institution", "title", "l_shipdate", 3)


def stability_profile(spark: SparkSession, root: str) -> DataFrame:
    documents = text_table(spark, root, "documents")
    return repeats.stability_profile(documents, ["n_chars", "text"], ["source", "lang"], texts=["text"])


def pair_drilldown(spark: SparkSession, root: str) -> DataFrame:
    rows = filters.by_pair(dated_documents(spark, root), "source", "src1", "lang", "en")
    return repeats.stability_profile(rows, ["n_chars", "o_orderdate", "o_custkey", "text"], texts=["text"])


def normalize_text_variants(spark: SparkSession, root: str) -> DataFrame:
    documents = repeats.normalization_effect(text_table(spark, root, "documents"), ["text"], ["lang"])
    turns = repeats.normalization_effect(text_table(spark, root, "conversations"), ["text"], ["role"])
    named = [
        (documents, "lang", "documents"),
        (turns, "role", "conversations"),
    ]
    parts = [df.select(F.lit(origin).alias("origin"), F.col(key).alias("key"), "text_raw", "text_norm") for df, key, origin in named]
    return parts[0].unionByName(parts[1])


def variant_counts(spark: SparkSession, root: str) -> DataFrame:
    rows = repeats.with_variant(dated_documents(spark, root), "text", "THE", "THE", "OTHER")
    return repeats.variant_by_date(rows, "o_orderdate")


def variant_amounts(spark: SparkSession, root: str) -> DataFrame:
    rows = repeats.with_variant(dated_documents(spark, root), "text", "THE", "THE", "OTHER")
    return rounded(repeats.variant_amounts(rows, "n_chars"), 4, "mean", "median")


def regime_matrix(spark: SparkSession, root: str) -> DataFrame:
    line = table(spark, root, "lineitem")
    return repeats.regime_matrix(line, ["l_returnflag", "l_linestatus", "l_quantity"], "l_shipdate")


def regime_consistency(spark: SparkSession, root: str) -> DataFrame:
    documents = text_table(spark, root, "documents").join(table(spark, root, "labels"), "doc_id", "left")
    return repeats.regime_consistency(documents, "quality", ["text"], "n_chars")


def regime_amounts(spark: SparkSession, root: str) -> DataFrame:
    return repeats.regime_amounts(table(spark, root, "lineitem"), "l_returnflag", "l_quantity")


QUERIES = {
    "pair_repetition": pair_repetition,
    "repetition_describe": repetition_describe,
    "repeat_postings": repeat_postings,
    "stability_profile": stability_profile,
    "pair_drilldown": pair_drilldown,
    "normalize_text_variants": normalize_text_variants,
    "variant_counts": variant_counts,
    "variant_amounts": variant_amounts,
    "regime_matrix": regime_matrix,
    "regime_consistency": regime_consistency,
    "regime_amounts": regime_amounts,
}

_LINES = "SELECT l_suppkey AS institution, p_name AS title, l_shipdate FROM lineitem JOIN part ON p_partkey = l_partkey"
_DATED = "SELECT d.*, o_orderdate, o_custkey FROM documents d LEFT JOIN orders ON o_orderkey = d.doc_id"
_VARIANT = f"""SELECT *, CASE WHEN starts_with({norm('text')}, 'THE') THEN 'THE' WHEN text IS NOT NULL THEN 'OTHER' END AS variant FROM ({_DATED})"""

ORACLES = {
    "pair_repetition": f"""
      SELECT institution, title, count(*) AS rows FROM ({_LINES}) WHERE title IS NOT NULL GROUP BY ALL
      ORDER BY rows DESC, institution, title LIMIT 20""",
    "repetition_describe": f"""
      WITH c AS (SELECT count(*) AS n FROM ({_LINES}) GROUP BY institution, title)
      SELECT count(n) AS "count", {r(mean('n'))} AS mean, {r('stddev_samp(n)')} AS std, min(n) AS min, max(n) AS max,
             {r('quantile_cont(n, 0.25)')} AS q25, {r('quantile_cont(n, 0.5)')} AS q50, {r('quantile_cont(n, 0.75)')} AS q75 FROM c""",
    "repeat_postings": f"""
      SELECT institution, title, count(*) AS total_postings, count(DISTINCT CAST(l_shipdate AS DATE)) AS distinct_dates,
             min(CAST(l_shipdate AS DATE)) AS first_posting, max(CAST(l_shipdate AS DATE)) AS last_posting
      FROM ({_LINES}) GROUP BY institution, title HAVING count(DISTINCT CAST(l_shipdate AS DATE)) >= 3""",
    "stability_profile": f"""
      WITH s AS (SELECT source, lang, count(DISTINCT n_chars) AS a, count(DISTINCT {norm('text')}) AS b FROM documents GROUP BY ALL)
      SELECT source, lang, 'n_chars' AS field, a AS distinct_values FROM s UNION ALL SELECT source, lang, 'text', b FROM s""",
    "pair_drilldown": f"""
      SELECT unnest(['n_chars', 'o_orderdate', 'o_custkey', 'text']) AS field,
             unnest([count(DISTINCT n_chars), count(DISTINCT o_orderdate), count(DISTINCT o_custkey),
                     count(DISTINCT {norm('text')})]) AS distinct_values
      FROM ({_DATED}) WHERE source = 'src1' AND lang = 'en'""",
    "normalize_text_variants": f"""
      SELECT 'documents' AS origin, lang AS key, count(DISTINCT text) AS text_raw, count(DISTINCT {norm('text')}) AS text_norm
      FROM documents GROUP BY lang
      UNION ALL
      SELECT 'conversations', role, count(DISTINCT text), count(DISTINCT {norm('text')}) FROM conversations GROUP BY role""",
    "variant_counts": f"""
      SELECT variant, CAST(o_orderdate AS DATE) AS date, count(*) AS rows FROM ({_VARIANT}) WHERE variant IS NOT NULL GROUP BY ALL""",
    "variant_amounts": f"""
      SELECT variant, count(n_chars) AS "count", {r(mean('n_chars'))} AS mean, {total('n_chars')} AS sum,
             {r('median(n_chars)')} AS median FROM ({_VARIANT}) WHERE variant IS NOT NULL GROUP BY variant""",
    "regime_matrix": """
      SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS postings, min(CAST(l_shipdate AS DATE)) AS first_date,
             max(CAST(l_shipdate AS DATE)) AS last_date, count(DISTINCT CAST(l_shipdate AS DATE)) AS distinct_dates
      FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity""",
    "regime_consistency": f"""
      SELECT quality, count(*) AS postings, count(DISTINCT {norm('text')}) AS text_values, count(DISTINCT n_chars) AS amount_values
      FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY quality""",
    "regime_amounts": """
      SELECT DISTINCT l_returnflag, l_quantity FROM lineitem WHERE l_returnflag IS NOT NULL AND l_quantity IS NOT NULL""",
}

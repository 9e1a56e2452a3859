"""Table profiles: missing values, counts, coverage, tails, months."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantlens.functions.numeric import percent
from vacantlens.operators import filters, profile
from vacantlens.operators.quantiles import describe, exact_quantiles, unpivot_numeric
from vacantlens.plans.pay import order_postings, rounded
from vacantlens.plans.sql import mean, r
from vacantlens.sources.tables import table

PRICE_LOW, PRICE_HIGH = 30000.0, 450000.0
DESCRIBED = ["count", "mean", "std", "min", "max", "q25", "q50", "q75"]


def labelled_documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents with the labels some of them have and the vectors some of them have."""
    documents = table(spark, root, "documents").drop("text")
    labels = table(spark, root, "labels")
    vectors = table(spark, root, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("vector_label"))
    return documents.join(labels, "doc_id", "left").join(vectors, "doc_id", "left")


def plausibility_flags(spark: SparkSession, root: str) -> DataFrame:
    flag = filters.plausibility(F.col("o_totalprice"), PRICE_LOW, PRICE_HIGH)
    counts = table(spark, root, "orders").groupBy(flag.alias("flag")).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    return counts.withColumn("percent", percent(F.col("rows"), total.select("total").scalar(), 2))


def tail_quantiles(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders")
    q = exact_quantiles(orders, [], "o_totalprice", [0.99, 0.995])
    price = F.col("o_totalprice")
    p99, p995 = q.select("q99").scalar(), q.select("q99_5").scalar()
    counts = orders.agg(
        F.count_if(price < PRICE_LOW).alias("below_low"),
        F.count_if(price > p99).alias("above_p99"),
        F.count_if(price > p995).alias("above_p995"),
    )
    return rounded(counts.withColumn("p99", p99).withColumn("p995", p995), 6, "p99", "p995")


def describe_numeric(spark: SparkSession, root: str) -> DataFrame:
    long = unpivot_numeric(table(spark, root, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(describe(long, "value", ["variable"]), 4, "mean", "std", "q25", "q50", "q75")


def describe_plausible(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders").where(F.col("o_totalprice").between(PRICE_LOW, PRICE_HIGH))
    return rounded(describe(orders, "o_totalprice"), 4, "mean", "std", "q25", "q50", "q75")


def tier_describe(spark: SparkSession, root: str) -> DataFrame:
    out = describe(order_postings(spark, root), "o_totalprice", ["c_mktsegment"])
    return rounded(out, 4, "mean", "std", "q25", "q50", "q75")


def outlier_listing(spark: SparkSession, root: str) -> DataFrame:
    rules = {"price": ("o_totalprice", 400000.0), "customer": ("o_custkey", 100.0)}
    return filters.outliers(table(spark, root, "orders"), rules, ["o_orderkey", "o_orderstatus"], ["o_orderkey"], 10)


def null_profile(spark: SparkSession, root: str) -> DataFrame:
    return profile.null_profile(labelled_documents(spark, root))


def value_counts_multi(spark: SparkSession, root: str) -> DataFrame:
    return profile.value_counts(labelled_documents(spark, root), ["lang", "source", "quality", "toxic"])


def coverage(spark: SparkSession, root: str) -> DataFrame:
    codes = {"quality": "quality", "toxicity": "toxic", "vector": "vector_label"}
    return profile.coverage(labelled_documents(spark, root), codes, "all")


def cardinalities(spark: SparkSession, root: str) -> DataFrame:
    return profile.cardinalities(table(spark, root, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"])


def key_counts(spark: SparkSession, root: str) -> DataFrame:
    return profile.key_counts(table(spark, root, "documents"), "source")


def flag_shares(spark: SparkSession, root: str) -> DataFrame:
    rules = {
        "large": F.col("o_totalprice") > 300000,
        "urgent": F.col("o_orderpriority") == "1-URGENT",
        "open_large": (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 300000),
    }
    return profile.conditional_counts(table(spark, root, "orders"), rules)


def monthly_volume(spark: SparkSession, root: str) -> DataFrame:
    return profile.monthly_volume(table(spark, root, "orders"), "o_orderdate")


QUERIES = {
    "plausibility_flags": plausibility_flags,
    "tail_quantiles": tail_quantiles,
    "describe_numeric": describe_numeric,
    "describe_plausible": describe_plausible,
    "tier_describe": tier_describe,
    "outlier_listing": outlier_listing,
    "null_profile": null_profile,
    "value_counts_multi": value_counts_multi,
    "coverage": coverage,
    "cardinalities": cardinalities,
    "key_counts": key_counts,
    "flag_shares": flag_shares,
    "monthly_volume": monthly_volume,
}


def _described(x: str) -> str:
    q = [f"{r(f'quantile_cont({x}, {p})')} AS {n}" for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    return (
        f'count({x}) AS "count", {r(mean(x))} AS mean, {r(f"stddev_samp({x})")} AS std, '
        f"min({x}) AS min, max({x}) AS max, {', '.join(q)}"
    )


_LABELLED = """
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, e.label AS vector_label
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""


def _share(part: str) -> str:
    return r(f"(CAST({part} AS DOUBLE) / (SELECT count(*) FROM t)) * 100", 2)


ORACLES = {
    "plausibility_flags": f"""
      WITH t AS (SELECT CASE WHEN o_totalprice < {PRICE_LOW} THEN 'implausible_low'
                             WHEN o_totalprice > {PRICE_HIGH} THEN 'implausible_high' ELSE 'ok' END AS flag FROM orders)
      SELECT flag, count(*) AS rows, {_share('count(*)')} AS percent FROM t GROUP BY flag""",
    "tail_quantiles": f"""
      WITH q AS (SELECT quantile_cont(o_totalprice, 0.99) AS p99, quantile_cont(o_totalprice, 0.995) AS p995 FROM orders)
      SELECT count(*) FILTER (o_totalprice < {PRICE_LOW}) AS below_low, count(*) FILTER (o_totalprice > p99) AS above_p99,
             count(*) FILTER (o_totalprice > p995) AS above_p995, {r('any_value(p99)', 6)} AS p99, {r('any_value(p995)', 6)} AS p995
      FROM orders, q""",
    "describe_numeric": f"""
      WITH u AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
                 ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME variable VALUE value)
      SELECT variable, {_described('value')} FROM u GROUP BY variable""",
    "describe_plausible": f"""
      SELECT {_described('o_totalprice')} FROM orders WHERE o_totalprice BETWEEN {PRICE_LOW} AND {PRICE_HIGH}""",
    "tier_describe": f"""
      SELECT c_mktsegment, {_described('o_totalprice')} FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""",
    "outlier_listing": """
      (SELECT 'price' AS rule, o_orderkey, o_orderstatus, o_totalprice AS value,
              row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders
       WHERE o_totalprice > 400000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)
      UNION ALL
      (SELECT 'customer', o_orderkey, o_orderstatus, CAST(o_custkey AS DOUBLE), row_number() OVER (ORDER BY o_custkey DESC, o_orderkey)
       FROM orders WHERE o_custkey > 100 ORDER BY o_custkey DESC, o_orderkey LIMIT 10)""",
    "null_profile": f"""
      WITH t AS ({_LABELLED}),
      m AS (SELECT unnest(['doc_id','lang','source','n_chars','quality','toxic','vector_label']) AS column_name,
                   unnest([count(*) - count(doc_id), count(*) - count(lang), count(*) - count(source), count(*) - count(n_chars),
                           count(*) - count(quality), count(*) - count(toxic), count(*) - count(vector_label)]) AS missing FROM t)
      SELECT column_name, missing, {r('(CAST(missing AS DOUBLE) / (SELECT count(*) FROM t)) * 100', 1)} AS percent FROM m WHERE missing > 0""",
    "value_counts_multi": f"""
      WITH t AS ({_LABELLED})
      SELECT 'lang' AS variable, lang AS value, count(*) AS rows FROM t WHERE lang IS NOT NULL GROUP BY lang
      UNION ALL SELECT 'source', source, count(*) FROM t WHERE source IS NOT NULL GROUP BY source
      UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), count(*) FROM t WHERE quality IS NOT NULL GROUP BY quality
      UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM t WHERE toxic IS NOT NULL GROUP BY toxic""",
    "coverage": f"""
      WITH t AS ({_LABELLED}),
      m AS (SELECT unnest(['quality', 'toxicity', 'vector', 'all']) AS metric,
                   unnest([count(quality), count(toxic), count(vector_label),
                           count(*) FILTER (quality IS NOT NULL AND toxic IS NOT NULL AND vector_label IS NOT NULL)]) AS rows FROM t)
      SELECT metric, rows, {_share('rows')} AS percent FROM m""",
    "cardinalities": """
      SELECT unnest(['o_custkey', 'o_orderstatus', 'o_orderpriority', 'o_orderdate']) AS column_name,
             unnest([count(DISTINCT o_custkey), count(DISTINCT o_orderstatus), count(DISTINCT o_orderpriority),
                     count(DISTINCT o_orderdate)]) AS distinct_values FROM orders""",
    "key_counts": """
      SELECT source, count(*) AS rows FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY rows DESC, source""",
    "flag_shares": f"""
      WITH t AS (SELECT * FROM orders),
      m AS (SELECT unnest(['large', 'urgent', 'open_large']) AS rule,
                   unnest([count(*) FILTER (o_totalprice > 300000), count(*) FILTER (o_orderpriority = '1-URGENT'),
                           count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 300000)]) AS rows FROM t)
      SELECT rule, rows, {_share('rows')} AS percent FROM m""",
    "monthly_volume": """
      WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS rows FROM orders GROUP BY 1)
      SELECT month, rows, (SELECT CAST(min(o_orderdate) AS DATE) FROM orders) AS first_day,
             (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) AS last_day, (SELECT count(*) FROM m) AS months FROM m""",
}

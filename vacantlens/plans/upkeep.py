"""Candidate refresh, patches, deletes, validated pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vacantlens.operators import enrich, maintain
from vacantlens.sources.tables import table

CUT = "2000-01-01"


def candidates(spark: SparkSession, root: str, late: bool) -> DataFrame:
    """(part, supplier) pairs out of early or late line items; confidence is the largest
    quantity, a pair that once reached 50 counts as validated by a person."""
    line = table(spark, root, "lineitem")
    when = F.col("l_shipdate") >= CUT if late else F.col("l_shipdate") < CUT
    pairs = line.where(when).groupBy("l_partkey", "l_suppkey").agg(
        (F.max("l_quantity") * 2).cast("int").alias("best_confidence"),
        F.max(F.when(F.col("l_quantity") >= 50, 1).otherwise(0)).alias("validated"),
    )
    best_first = W.partitionBy("l_partkey").orderBy(F.desc("best_confidence"), "l_suppkey")
    ranked = pairs.withColumn("rank", F.row_number().over(best_first).cast("long"))
    if late:
        return ranked.withColumn("validated", F.lit(0))
    return ranked


def refresh_candidates(spark: SparkSession, root: str) -> DataFrame:
    return maintain.refresh_candidates(
        candidates(spark, root, late=False), candidates(spark, root, late=True), "l_partkey", "l_suppkey"
    )


def best_candidate_enrich(spark: SparkSession, root: str) -> DataFrame:
    """Late line items with the best early supplier of their part; parts without one keep null."""
    best = enrich.best_candidates(candidates(spark, root, late=False), "l_partkey", "l_suppkey", ["l_suppkey", "best_confidence"])
    best = best.select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("best_supplier"), "best_confidence")
    line = table(spark, root, "lineitem").where(F.col("l_shipdate") >= CUT)
    return enrich.attach_best(line, "l_partkey", best, "key").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "best_supplier", "best_confidence"
    )


def apply_patches(spark: SparkSession, root: str) -> DataFrame:
    """Customers with balance and segment updated from their urgent orders."""
    orders = table(spark, root, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    patches = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("c_acctbal"),
        F.max("o_orderstatus").alias("c_mktsegment"),
    )
    return maintain.apply_patches(table(spark, root, "customer"), patches, "c_custkey", ["c_acctbal", "c_mktsegment"])


def delete_keys(spark: SparkSession, root: str) -> DataFrame:
    gone = table(spark, root, "orders").where(F.col("o_totalprice") > 490000).select(F.col("o_custkey").alias("c_custkey"))
    return maintain.delete_keys(table(spark, root, "customer"), gone, "c_custkey").select("c_custkey", "c_name")


def _reviewed(spark: SparkSession, root: str) -> DataFrame:
    return candidates(spark, root, late=False).withColumn("validated_code", F.when(F.col("validated") == 1, F.col("l_suppkey")))


def validated_pairs(spark: SparkSession, root: str) -> DataFrame:
    return maintain.validated_pairs(_reviewed(spark, root), "l_partkey", "l_suppkey")


def validation_precision(spark: SparkSession, root: str) -> DataFrame:
    reviewed = _reviewed(spark, root)
    truth = maintain.validated_pairs(reviewed, "l_partkey", "l_suppkey")
    return maintain.precision_at_1(reviewed, truth, "l_partkey", "l_suppkey").withColumn(
        "precision_at_1", F.rint(F.col("precision_at_1") * 1e6) / 1e6
    )


QUERIES = {
    "refresh_candidates": refresh_candidates,
    "best_candidate_enrich": best_candidate_enrich,
    "apply_patches": apply_patches,
    "delete_keys": delete_keys,
    "validated_pairs": validated_pairs,
    "validation_precision": validation_precision,
}


def _pairs(late: bool) -> str:
    return f"""
      SELECT l_partkey, l_suppkey, CAST(max(l_quantity) * 2 AS INT) AS best_confidence,
             {'0' if late else 'CAST(max(l_quantity) >= 50 AS INT)'} AS validated,
             row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(max(l_quantity) * 2 AS INT) DESC, l_suppkey) AS rank
      FROM lineitem WHERE l_shipdate {'>=' if late else '<'} TIMESTAMP '{CUT} 00:00:00' GROUP BY l_partkey, l_suppkey"""


ORACLES = {
    "refresh_candidates": f"""
      WITH s AS ({_pairs(False)}), f AS ({_pairs(True)})
      SELECT * FROM s WHERE validated = 1 OR l_partkey NOT IN (SELECT l_partkey FROM f)
      UNION ALL
      SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.validated = 1 AND s.l_partkey = f.l_partkey AND s.l_suppkey = f.l_suppkey)""",
    "best_candidate_enrich": f"""
      WITH b AS (SELECT l_partkey AS k, l_suppkey AS best_supplier, best_confidence FROM ({_pairs(False)}) WHERE rank = 1)
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, best_supplier, best_confidence
      FROM lineitem LEFT JOIN b ON k = l_partkey WHERE l_shipdate >= TIMESTAMP '{CUT} 00:00:00'""",
    "apply_patches": """
      WITH p AS (SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS bal, max(o_orderstatus) AS seg
                 FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey)
      SELECT c_custkey, c_name, c_nationkey, coalesce(bal, c_acctbal) AS c_acctbal, coalesce(seg, c_mktsegment) AS c_mktsegment
      FROM customer LEFT JOIN p ON o_custkey = c_custkey""",
    "delete_keys": """
      SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)""",
    "validated_pairs": f"SELECT DISTINCT l_partkey, l_suppkey FROM ({_pairs(False)}) WHERE validated = 1",
    "validation_precision": f"""
      WITH s AS ({_pairs(False)})
      SELECT count(*) AS validated_keys, count(*) FILTER (rank = 1) AS hits,
             round_even(CAST(count(*) FILTER (rank = 1) AS DOUBLE) / count(*) * 1e6, 0) / 1e6 AS precision_at_1
      FROM s WHERE validated = 1""",
}

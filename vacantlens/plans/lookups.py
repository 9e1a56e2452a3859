"""Lookups, searches, incremental checks and the duplicate-run frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantlens.operators import filters, incremental
from vacantlens.sources.tables import table


def newest_rows(spark: SparkSession, root: str) -> DataFrame:
    rows = filters.newest_first(table(spark, root, "events"), "ts", ["event_id"], 100)
    return rows.select("event_id", "user_id", "event_type")


def recent_rows(spark: SparkSession, root: str) -> DataFrame:
    as_of = F.to_timestamp(F.lit("2024-01-30 00:00:00"))
    return filters.recent(table(spark, root, "events"), "ts", 7, as_of).select("event_id", "user_id", "event_type")


def substring_search(spark: SparkSession, root: str) -> DataFrame:
    customer = table(spark, root, "customer").withColumnRenamed("c_name", "institution")
    orders = table(spark, root, "orders")
    posted = orders.join(customer, orders.o_custkey == customer.c_custkey)
    found = filters.containing(posted, "institution", "MER#00000001", "o_orderdate", ["o_orderkey"])
    return found.select("o_orderkey", "institution", F.col("o_orderdate").cast("date").alias("posted"))


def point_lookup(spark: SparkSession, root: str) -> DataFrame:
    row = filters.by_key(table(spark, root, "orders"), "o_orderkey", 77)
    return row.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


def seeded_sample(spark: SparkSession, root: str) -> DataFrame:
    return filters.seeded_sample(table(spark, root, "orders"), "o_orderkey", 50, 42).select("o_orderkey", "o_totalprice")


def completeness(spark: SparkSession, root: str) -> DataFrame:
    """Missing required fields and outcome of documents with their optional labels."""
    documents = table(spark, root, "documents").select("doc_id", "lang")
    labels = table(spark, root, "labels")
    required = ["doc_id", "lang", "quality", "toxic"]
    return documents.join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat_ws(", ", filters.missing_fields(required)).alias("missing"),
        filters.outcome("doc_id", required).alias("outcome"),
    )


def pending_keys(spark: SparkSession, root: str) -> DataFrame:
    """Customers with orders whose number no event user has yet."""
    keys = table(spark, root, "orders").select(F.col("o_custkey").alias("key"))
    existing = table(spark, root, "events").select(F.col("user_id").alias("key"))
    return incremental.pending_keys(keys, existing, "key")


def existing_check(spark: SparkSession, root: str) -> DataFrame:
    """Documents already labelled or already embedded."""
    complete = table(spark, root, "labels").select("doc_id")
    incomplete = table(spark, root, "embeddings").select(F.col("vec_id").alias("doc_id"))
    known = incremental.all_ids(complete, incomplete, "doc_id")
    return incremental.existing_check(table(spark, root, "documents"), known, "doc_id").select("doc_id", "lang")


def insert_or_ignore(spark: SparkSession, root: str) -> DataFrame:
    """First event per user and type, for users that have no customer record."""
    target = table(spark, root, "labels").select(F.col("doc_id").alias("user_id"))
    batch = table(spark, root, "events")
    added = incremental.insert_or_ignore(target, batch, ["user_id"], ["ts", "event_id"])
    return added.select("user_id", "event_id", "event_type")


def keep_first(spark: SparkSession, root: str) -> DataFrame:
    first = incremental.keep_first(table(spark, root, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return first.select("user_id", "event_type", "event_id", "value")


def duplicate_run_frontier(spark: SparkSession, root: str) -> DataFrame:
    """Views and clicks repeat known rows, purchases are new rows, the rest is neither."""
    events = table(spark, root, "events").select(
        "user_id",
        "event_id",
        F.col("event_type").isin("view", "click").alias("dup"),
        (F.col("event_type") == "purchase").alias("saved"),
    )
    return incremental.duplicate_run_frontier(events, "user_id", "event_id", "dup", "saved", threshold=5)


QUERIES = {
    "newest_rows": newest_rows,
    "recent_rows": recent_rows,
    "substring_search": substring_search,
    "point_lookup": point_lookup,
    "seeded_sample": seeded_sample,
    "completeness": completeness,
    "pending_keys": pending_keys,
    "existing_check": existing_check,
    "insert_or_ignore": insert_or_ignore,
    "keep_first": keep_first,
    "duplicate_run_frontier": duplicate_run_frontier,
}

ORACLES = {
    "newest_rows": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 100",
    "recent_rows": """
      SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY""",
    "substring_search": """
      SELECT o_orderkey, c_name AS institution, CAST(o_orderdate AS DATE) AS posted
      FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_name ILIKE '%mer#00000001%'""",
    "point_lookup": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey = 77",
    "seeded_sample": """
      SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey LIMIT 50""",
    "completeness": """
      SELECT d.doc_id, concat_ws(', ', CASE WHEN lang IS NULL THEN 'lang' END, CASE WHEN quality IS NULL THEN 'quality' END,
                                 CASE WHEN toxic IS NULL THEN 'toxic' END) AS missing,
             CASE WHEN lang IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL THEN 'complete' ELSE 'incomplete' END AS outcome
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "pending_keys": """
      SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT user_id FROM events)""",
    "existing_check": """
      SELECT doc_id, lang FROM documents
      WHERE doc_id IN (SELECT doc_id FROM labels UNION ALL SELECT vec_id FROM embeddings)""",
    "insert_or_ignore": """
      SELECT user_id, event_id, event_type FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels)
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
    "keep_first": """
      SELECT user_id, event_type, event_id, value FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
    "duplicate_run_frontier": """
      WITH e AS (SELECT user_id, event_id, CAST(event_type IN ('view', 'click') AS INT) AS dup,
                        sum(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
      r AS (SELECT *, sum(dup) OVER (PARTITION BY user_id, island ORDER BY event_id) AS run FROM e)
      SELECT user_id, count(*) AS rows, CAST(sum(dup) AS BIGINT) AS duplicates, CAST(max(run) AS BIGINT) AS longest_run,
             min(event_id) FILTER (run >= 5) AS frontier FROM r GROUP BY user_id""",
}

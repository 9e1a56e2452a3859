"""Whole runs: enriched postings from raw text, and the continuous ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantlens.operators import clean, enrich, filters, match
from vacantlens.operators.incremental import distinct_keys
from vacantlens.operators.profile import coverage
from vacantlens.plans.cleaning import (
    CLEANED_SQL,
    academic_flags_sql,
    contract_classes_sql,
    experience_sql,
    known_postings,
    raw_postings,
)
from vacantlens.plans.matching import token_set_sql
from vacantlens.plans.sql import r
from vacantlens.session import scratch_path
from vacantlens.sources import sinks
from vacantlens.sources.schemas import EVENTS
from vacantlens.sources.tables import table
from vacantlens.streaming.ingest import ingest, read_landed, read_stored


def stored_split(spark: SparkSession, root: str) -> DataFrame:
    """Cleaned and routed postings, written once so that the text rules run once."""
    path = scratch_path(spark, "split")
    clean.clean_split(raw_postings(spark, root), known_postings(spark, root), ["scraped_at", "doc_id"]).write.parquet(path)
    return spark.read.parquet(path)


def written_split(spark: SparkSession, root: str) -> DataFrame:
    """The two phase tables as written and read back."""
    complete, quarantine = scratch_path(spark, "complete"), scratch_path(spark, "quarantine")
    sinks.write_split(stored_split(spark, root), complete, quarantine)
    return clean.stored_counts(spark.read.parquet(complete), spark.read.parquet(quarantine))


def enriched_postings(spark: SparkSession, root: str) -> DataFrame:
    """Raw text to the enriched table: clean, keep the complete rows, match titles and
    institutions, enrich, write by month, read back."""
    complete = stored_split(spark, root).where(F.col("outcome") == "complete")
    rows = complete.drop("failed_fields", "outcome", "scraped_at", "doc_id")
    segments = table(spark, root, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.min("c_custkey").alias("isco_code"))
    titles = match.match_topk(
        distinct_keys(rows, "job_title"), segments, "job_title", "isco_code", "isco_code",
        key_text="job_title", catalog_text="label", k=1, threshold=60,
    )
    best_titles = enrich.best_candidates(titles, "job_title", "isco_code", ["isco_code"])
    names = table(spark, root, "customer").select(F.col("c_name").alias("institution"), F.col("c_custkey").alias("ejecutora"))
    best_names = enrich.best_candidates(
        names.withColumn("best_confidence", F.lit(100)).withColumn("rank", F.lit(1)), "institution", "ejecutora", ["ejecutora"]
    )
    path = scratch_path(spark, "enriched")
    sinks.write_enriched(enrich.enrich(rows, best_titles, best_names), path, sort=["isco_code", "ejecutora"])
    texts = ["experience_requirements", "academic_profile", "specialization", "knowledge", "competencies"]
    return spark.read.parquet(path).withColumns({name: F.sha2(name, 256) for name in texts})


def enriched_coverage(spark: SparkSession, root: str) -> DataFrame:
    codes = {"title": "isco_code", "institution": "ejecutora", "contract": "contract_regime"}
    return coverage(enriched_postings(spark, root), codes, "all")


REQUIRED_EVENT = ["event_id", "user_id", "event_type", "value"]


def route_events(batch: DataFrame) -> DataFrame:
    """Events as records with required fields; the value of an error is missing."""
    rows = batch.withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return rows.withColumn("outcome", filters.outcome("event_id", REQUIRED_EVENT))


def stream_ingest(spark: SparkSession, root: str) -> DataFrame:
    """Two overlapping deliveries of the event table through the stream into stored tables."""
    target, checkpoint = scratch_path(spark, "ingest"), scratch_path(spark, "ingest-checkpoint")
    first = read_landed(spark, root, EVENTS, "events.parquet").where(F.col("ts") < "2024-01-20")
    second = read_landed(spark, root, EVENTS, "events.parquet").where(F.col("ts") >= "2024-01-10")
    query = ingest(first.union(second), "event_id", "ts", route_events, target, checkpoint, delay="40 days")
    query.awaitTermination()
    stored = read_stored(spark, target, route_events(table(spark, root, "events")).schema)
    return stored.select("event_id", "user_id", "event_type", "value", "outcome")


QUERIES = {
    "written_split": written_split,
    "enriched_postings": enriched_postings,
    "enriched_coverage": enriched_coverage,
    "stream_ingest": stream_ingest,
}

_SEGMENTS = "SELECT min(c_custkey) AS cid, c_mktsegment AS ct FROM customer GROUP BY c_mktsegment"
_TITLES = "SELECT DISTINCT job_title AS kid, job_title AS kt FROM split WHERE outcome = 'complete'"
_ENRICHED = f"""WITH {CLEANED_SQL}, {token_set_sql(_TITLES, _SEGMENTS)},
  titles AS (SELECT kid, cid FROM fuzzy WHERE score >= 60 QUALIFY row_number() OVER (PARTITION BY kid ORDER BY score DESC, cid) = 1),
  names AS (SELECT c_name, min(c_custkey) AS ejecutora FROM customer GROUP BY c_name),
  e AS (SELECT posting_unique_id AS pe, {experience_sql()} FROM (SELECT *, coalesce(upper(experience_requirements), '') AS u FROM split)),
  a AS (SELECT posting_unique_id AS pa, {academic_flags_sql()} FROM (SELECT *, coalesce(upper(academic_profile), '') AS u FROM split)),
  enriched AS (
    SELECT posting_unique_id, job_title, institution, posting_start_date, posting_end_date, salary_amount, number_of_vacancies,
           sha256(experience_requirements) AS experience_requirements, sha256(academic_profile) AS academic_profile,
           sha256(specialization) AS specialization, sha256(knowledge) AS knowledge, sha256(competencies) AS competencies,
           contract_type, titles.cid AS isco_code, ejecutora, {contract_classes_sql()}, e.* EXCLUDE (pe), a.* EXCLUDE (pa),
           CAST(date_trunc('month', posting_start_date) AS DATE) AS year_month
    FROM split LEFT JOIN titles ON kid = job_title LEFT JOIN names ON c_name = institution
    JOIN e ON pe = posting_unique_id JOIN a ON pa = posting_unique_id
    WHERE outcome = 'complete')"""


def _share(part: str) -> str:
    return r(f"(CAST({part} AS DOUBLE) / (SELECT count(*) FROM enriched)) * 100", 2)


ORACLES = {
    "enriched_postings": f"{_ENRICHED} SELECT * FROM enriched",
    "enriched_coverage": f"""{_ENRICHED},
      m AS (SELECT unnest(['title', 'institution', 'contract', 'all']) AS metric,
                   unnest([count(isco_code), count(ejecutora), count(contract_regime),
                           count(*) FILTER (isco_code IS NOT NULL AND ejecutora IS NOT NULL AND contract_regime IS NOT NULL)]) AS rows
            FROM enriched)
      SELECT metric, rows, {_share('rows')} AS percent FROM m""",
    "written_split": f"""WITH {CLEANED_SQL}
      SELECT outcome AS status, count(*) AS rows FROM split GROUP BY outcome""",
    "stream_ingest": """
      SELECT event_id, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value,
             CASE WHEN event_type <> 'error' THEN 'complete' ELSE 'incomplete' END AS outcome FROM events""",
}

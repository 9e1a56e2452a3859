"""Standardise raw postings and route each row to complete, incomplete or failed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantlens.functions import parsing, text
from vacantlens.operators.filters import missing_fields, outcome
from vacantlens.operators.incremental import keep_first

CLEAN_FIELDS = [
    "posting_unique_id",
    "job_title",
    "institution",
    "posting_start_date",
    "posting_end_date",
    "salary_amount",
    "number_of_vacancies",
    "contract_type",
    "experience_requirements",
    "academic_profile",
    "specialization",
    "knowledge",
    "competencies",
]


def clean_columns(null_no_info: bool = False) -> dict[str, Column]:
    """The rule of every cleaned field. Institutions keep 'NO INFO' unless asked otherwise."""
    institution = text.clean_text(F.col("institution"))
    return {
        "posting_unique_id": parsing.parse_posting_id(F.col("posting_unique_id")),
        "job_title": text.clean_title(F.col("job_title")),
        "institution": text.null_if_no_info(institution) if null_no_info else institution,
        "posting_start_date": parsing.parse_date(F.col("posting_start_date")),
        "posting_end_date": parsing.parse_date(F.col("posting_end_date")),
        "salary_amount": parsing.parse_money(F.col("monthly_salary")),
        "number_of_vacancies": parsing.parse_count(F.col("number_of_vacancies")),
        "contract_type": parsing.classify_contract(F.col("contract_type_raw")),
        "experience_requirements": text.clean_free_text(F.col("experience_requirements")),
        "academic_profile": text.clean_free_text(F.col("academic_profile")),
        "specialization": text.clean_listing(F.col("specialization")),
        "knowledge": text.clean_listing(F.col("knowledge")),
        "competencies": text.clean_listing(F.col("competencies")),
    }


def clean_postings(raw: DataFrame, keep: Sequence[str] = (), null_no_info: bool = False) -> DataFrame:
    """All rules in one projection, then ``failed_fields`` and ``outcome``.

    A row without a usable id is failed and only its id counts as a failed field.
    """
    cleaned = raw.select(*[c.alias(n) for n, c in clean_columns(null_no_info).items()], *keep)
    no_id = F.col("posting_unique_id").isNull()
    return cleaned.withColumn(
        "failed_fields",
        F.when(no_id, F.array(F.lit("posting_unique_id"))).otherwise(missing_fields(CLEAN_FIELDS)),
    ).withColumn("outcome", outcome("posting_unique_id", CLEAN_FIELDS))


def clean_split(raw: DataFrame, known_ids: DataFrame | None, order: Sequence[str]) -> DataFrame:
    """Postings to store: usable ids not yet known, one row per id, cleaned and routed.

    Known ids and repeated copies are dropped on the raw rows, before the text rules run;
    the anti join and the choice of the first copy share one shuffle by id. Ids are compared
    in their cleaned form, so '738213B' is recognised on a rerun. Rows without a usable id
    are stored nowhere; ``failed_rows`` lists them.
    """
    usable = raw.withColumn("_id", parsing.parse_posting_id(F.col("posting_unique_id"))).where(F.col("_id").isNotNull())
    # Copies go first: each task keeps one row per id before the shuffle.
    first = keep_first(usable, ["_id"], order)
    if known_ids is not None:
        known = known_ids.select(F.col("posting_unique_id").cast("long").alias("_id"))
        first = first.join(known, "_id", "left_anti")
    first = first.drop("_id")
    return clean_postings(first, [c for c in order if c not in CLEAN_FIELDS])


def failed_rows(raw: DataFrame) -> DataFrame:
    return raw.where(parsing.parse_posting_id(F.col("posting_unique_id")).isNull())


def complete_rows(split: DataFrame) -> DataFrame:
    return split.where(F.col("outcome") == "complete").drop("failed_fields", "outcome")


def quarantine_rows(split: DataFrame) -> DataFrame:
    """Incomplete rows with the reasons as one text and the review columns."""
    return (
        split.where(F.col("outcome") == "incomplete")
        .withColumn("failed_fields", F.concat_ws(", ", "failed_fields"))
        .withColumn("reviewed", F.lit(False))
        .withColumn("notes", F.lit(None).cast("string"))
        .withColumn("reviewed_at", F.lit(None).cast("timestamp"))
        .drop("outcome")
    )


def failures_by_field(split: DataFrame) -> DataFrame:
    """How often each field kept a row from being complete."""
    return (
        split.select(F.explode("failed_fields").alias("field"))
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def run_statistics(raw: DataFrame, split: DataFrame) -> DataFrame:
    """One row per outcome; rows that were neither stored nor failed are duplicates."""
    no_id = parsing.parse_posting_id(F.col("posting_unique_id")).isNull()
    seen = raw.agg(F.count(F.lit(1)).alias("encountered"), F.count_if(no_id).alias("failed"))
    stored = split.agg(
        F.count_if(F.col("outcome") == "complete").alias("complete"),
        F.count_if(F.col("outcome") == "incomplete").alias("incomplete"),
    )
    one = stored.withColumns({c: seen.select(c).scalar() for c in ("encountered", "failed")})
    one = one.withColumn("duplicate", F.expr("encountered - complete - incomplete - failed"))
    one = one.withColumn("new_rows", F.expr("complete + incomplete"))
    names = ["encountered", "complete", "incomplete", "failed", "duplicate", "new_rows"]
    return one.unpivot([], names, "statistic", "rows")


def status_counts(split: DataFrame) -> DataFrame:
    """Rows a split adds to each phase table."""
    return split.groupBy(F.col("outcome").alias("status")).agg(F.count(F.lit(1)).alias("rows"))


def stored_counts(complete: DataFrame, incomplete: DataFrame) -> DataFrame:
    """Rows per phase table; their sum is the number of postings stored."""
    return (
        complete.select(F.lit("complete").alias("status"))
        .unionByName(incomplete.select(F.lit("incomplete").alias("status")))
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("rows"))
    )

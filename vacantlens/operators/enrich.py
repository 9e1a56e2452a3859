"""Enrich cleaned postings with codes, classes and parsed requirement flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantlens import config
from vacantlens.functions.numeric import month_start
from vacantlens.functions.parsing import parse_academic, parse_experience


def best_candidates(
    candidates: DataFrame, key: str, code: str, columns: Sequence[str], prefer_validated: bool = False, catalog: DataFrame | None = None
) -> DataFrame:
    """The candidate with the highest confidence per key; ties go by rank, then code.

    ``prefer_validated`` puts rows approved by a person first. Where a person wrote another code into
    ``validated_code``, that one counts before all; its attributes come from ``catalog``, one row per code,
    and are null without it.
    """
    order = [F.desc("best_confidence"), F.asc("rank"), F.asc(code)]
    corrected = None
    if {"validated", "validated_code"} <= set(candidates.columns):
        corrected = F.coalesce((F.col("validated") == 1) & F.col("validated_code").isNotNull(), F.lit(False))
    if prefer_validated:
        order.insert(0, F.desc(F.coalesce(F.col("validated"), F.lit(0))))
    if corrected is not None:
        order.insert(0, F.desc(corrected))
    ranked = candidates.withColumn("_best", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    best = ranked.where(F.col("_best") == 1)
    if corrected is None:
        return best.select(key, *columns)
    kind = candidates.schema[code].dataType
    best = best.select(
        F.col(key), corrected.alias("_corrected"), F.when(corrected, F.col("validated_code").cast(kind)).otherwise(F.col(code)).alias("_code"),
        *[F.when(~corrected, F.col(c)).alias(c) for c in columns if c != code],
    )
    if catalog is not None:
        known = [c for c in columns if c != code and c in catalog.columns]
        written = catalog.select(F.col(code).alias("_code"), *[F.col(c).alias(f"_w_{c}") for c in known])
        best = best.join(written, "_code", "left").withColumns({c: F.when(F.col("_corrected"), F.col(f"_w_{c}")).otherwise(F.col(c)) for c in known})
    return best.select(key, *[F.col("_code").alias(code) if c == code else F.col(c) for c in columns])


def attach_best(df: DataFrame, on: str, best: DataFrame, key: str) -> DataFrame:
    """Left join by exact key; rows without a candidate keep nulls. The join is left to
    adaptive execution: broadcast when the measured side is small, else sort-merge with
    skewed partitions split."""
    return df.join(best.withColumnRenamed(key, f"_k_{key}"), F.col(on) == F.col(f"_k_{key}"), "left").drop(f"_k_{key}")


def contract_columns(c: Column) -> dict[str, Column]:
    """Regime and temporal nature of a contract class; unknown classes give null."""
    lookup = F.create_map(
        *[x for name, regime, nature in config.CONTRACT_CLASSES for x in (F.lit(name), F.struct(F.lit(regime).alias("r"), F.lit(nature).alias("n")))]
    )
    found = F.try_element_at(lookup, c)
    return {"contract_regime": found["r"], "contract_temporal_nature": found["n"]}


def label_codes(c: Column, labels: dict[str, str] = config.TIER_LABELS) -> Column:
    """Code to label by a fixed map; an unmapped code gives null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), c)


def enrich(
    cleaned: DataFrame,
    titles: DataFrame | None = None,
    institutions: DataFrame | None = None,
    programs: DataFrame | None = None,
    topics: DataFrame | None = None,
) -> DataFrame:
    """Cleaned postings with best candidates, contract classes, parsed flags and topics.

    ``titles``, ``institutions`` and ``programs`` hold one best row per key; ``topics``
    is joined by posting id. With ``programs``, a profile without a program requires no thesis.

    Topics need a join of the whole rows by id. The candidates then ride along on the topic
    side: only ids and keys are moved for them, and the whole rows are shuffled once.
    """
    matched = [
        (best, on)
        for best, on in ((titles, "job_title"), (institutions, "institution"), (programs, "academic_profile"))
        if best is not None
    ]
    keys = [on for _, on in matched]
    out = cleaned if topics is None else cleaned.select("posting_unique_id", *keys)
    for best, on in matched:
        out = attach_best(out, on, best, best.columns[0])
    if topics is not None:
        codes = out.drop(*keys).join(topics, "posting_unique_id", "left")
        out = cleaned.join(codes, "posting_unique_id", "left")
    academic = parse_academic(F.col("academic_profile"))
    if programs is not None:
        has_program = F.col(programs.columns[1]).isNotNull()
        academic["thesis_required"] = F.when(has_program, academic["thesis_required"]).otherwise(0)
    wanted = ["thesis_required", "accepts_related_fields", "requires_colegiado", "requires_habilitado"]
    return out.withColumns(
        {
            **contract_columns(F.col("contract_type")),
            **parse_experience(F.col("experience_requirements")),
            **{name: academic[name] for name in wanted},
            "year_month": month_start(F.col("posting_start_date")),
        }
    )

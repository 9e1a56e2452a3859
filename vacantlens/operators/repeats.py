"""Repeat postings, requirement stability and text variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantlens.functions.numeric import fixed_mean, fixed_sum
from vacantlens.functions.text import normalize_text, text_digest
from vacantlens.operators.quantiles import attach_quantiles


def pair_repetition(df: DataFrame, first: str, second: str, top: int | None = None) -> DataFrame:
    """Rows per pair, most repeated first."""
    counts = (
        df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
        .groupBy(first, second)
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return counts if top is None else counts.orderBy(F.desc("rows"), first, second).limit(top)


def repeat_postings(df: DataFrame, first: str, second: str, at: str, min_dates: int = 3) -> DataFrame:
    """Pairs posted on at least ``min_dates`` distinct dates, with first and last date."""
    day = F.col(at).cast("date")
    return (
        df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
        .groupBy(first, second)
        .agg(
            F.count(F.lit(1)).alias("total_postings"),
            F.countDistinct(day).alias("distinct_dates"),
            F.min(day).alias("first_posting"),
            F.max(day).alias("last_posting"),
        )
        .where(F.col("distinct_dates") >= min_dates)
    )


def stability_profile(
    df: DataFrame, fields: Sequence[str], by: Sequence[str] = (), texts: Sequence[str] = ()
) -> DataFrame:
    """Distinct values per field, for one selection or per key.

    Fields in ``texts`` are compared in normalised form. Long values are counted by
    digest so that the shuffle carries 32 bytes instead of the text.
    """

    def counted(name: str) -> Column:
        return text_digest(normalize_text(F.col(name))) if name in texts else F.col(name)

    one = df.groupBy(*by).agg(*[F.countDistinct(counted(f)).alias(f) for f in fields])
    return one.unpivot([F.col(k) for k in by], list(fields), "field", "distinct_values")


def normalization_effect(df: DataFrame, texts: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Distinct texts before and after normalisation."""
    parts = []
    for name in texts:
        parts += [
            F.countDistinct(text_digest(F.col(name))).alias(f"{name}_raw"),
            F.countDistinct(text_digest(normalize_text(F.col(name)))).alias(f"{name}_norm"),
        ]
    return df.groupBy(*by).agg(*parts)


def with_variant(df: DataFrame, text: str, prefix: str, yes: str, no: str) -> DataFrame:
    """Label rows by whether the normalised text starts with the prefix; null text has no variant."""
    return df.withColumn("variant", F.when(normalize_text(F.col(text)).startswith(prefix), yes).when(F.col(text).isNotNull(), no))


def variant_by_date(df: DataFrame, at: str) -> DataFrame:
    return (
        df.where(F.col("variant").isNotNull())
        .groupBy("variant", F.col(at).cast("date").alias("date"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def variant_amounts(df: DataFrame, amount: str) -> DataFrame:
    """count, mean, median, sum of an amount per variant."""
    rows = df.where(F.col("variant").isNotNull())
    stats = rows.groupBy("variant").agg(
        F.count(amount).alias("count"),
        fixed_mean(F.col(amount)).alias("mean"),
        fixed_sum(F.col(amount)).alias("sum"),
    )
    return attach_quantiles(stats, rows, ["variant"], amount, {0.5: "median"})


def regime_matrix(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Rows, first and last date and distinct dates for each combination of keys."""
    day = F.col(at).cast("date")
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    return (
        df.where(present)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("postings"),
            F.min(day).alias("first_date"),
            F.max(day).alias("last_date"),
            F.countDistinct(day).alias("distinct_dates"),
        )
    )


def regime_consistency(df: DataFrame, regime: str, texts: Sequence[str], amount: str) -> DataFrame:
    """Per regime: distinct normalised texts and distinct amounts."""
    return df.where(F.col(regime).isNotNull()).groupBy(regime).agg(
        F.count(F.lit(1)).alias("postings"),
        *[F.countDistinct(text_digest(normalize_text(F.col(t)))).alias(f"{t}_values") for t in texts],
        F.countDistinct(amount).alias("amount_values"),
    )


def regime_amounts(df: DataFrame, regime: str, amount: str) -> DataFrame:
    """The set of amounts of each regime as rows, so that no set is held in one cell."""
    return df.where(F.col(regime).isNotNull() & F.col(amount).isNotNull()).select(regime, amount).distinct()

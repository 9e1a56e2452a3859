"""Row selection: lookups, searches, ranges, completeness and outcome routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest_first(df: DataFrame, at: str, tie: Sequence[str], limit: int | None = None) -> DataFrame:
    """Rows by time, newest first. With a limit Spark keeps only the top rows of each task."""
    out = df.orderBy(F.desc(at), *tie)
    return out if limit is None else out.limit(limit)


def by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def by_pair(df: DataFrame, first: str, first_value: object, second: str, second_value: object) -> DataFrame:
    return df.where((F.col(first) == F.lit(first_value)) & (F.col(second) == F.lit(second_value)))


def containing(df: DataFrame, column: str, text: str, at: str, tie: Sequence[str]) -> DataFrame:
    """Case-insensitive substring search, newest first; '%' and '_' are plain characters."""
    return newest_first(df.where(F.lower(column).contains(text.lower())), at, tie)


def recent(df: DataFrame, at: str, days: int = 7, as_of: Column | None = None) -> DataFrame:
    end = F.current_timestamp() if as_of is None else as_of
    return df.where(F.col(at) >= end - F.make_dt_interval(days=F.lit(days)))


def missing_fields(required: Sequence[str]) -> Column:
    """Names of the required columns that are null, in declared order."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))


def outcome(identifier: str, required: Sequence[str]) -> Column:
    """failed without an identifier, else complete or incomplete."""
    return (
        F.when(F.col(identifier).isNull(), "failed")
        .when(F.size(missing_fields(required)) == 0, "complete")
        .otherwise("incomplete")
    )


def outliers(
    df: DataFrame, rules: dict[str, tuple[str, float]], columns: Sequence[str], tie: Sequence[str], top: int = 10
) -> DataFrame:
    """For each named rule (column, bound): the ``top`` largest values above the bound.

    One scan serves all rules; each task keeps ``top`` rows per rule before the shuffle.
    """
    hits = F.array(
        *[
            F.when(F.col(column) > bound, F.struct(F.lit(name).alias("rule"), F.col(column).cast("double").alias("value")))
            for name, (column, bound) in rules.items()
        ]
    )
    long = df.select(*columns, F.explode(F.array_compact(hits)).alias("_hit")).select(*columns, "_hit.*")
    ranked = long.withColumn("rank", F.row_number().over(W.partitionBy("rule").orderBy(F.desc("value"), *tie)).cast("long"))
    return ranked.where(F.col("rank") <= top)


def plausibility(c: Column, low: float, high: float) -> Column:
    """Null values stay 'ok': only a value outside the bounds is implausible."""
    return F.when(c < low, "implausible_low").when(c > high, "implausible_high").otherwise("ok")


def seeded_sample(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows picked by a hash of the key and the seed: the same rows on every run."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(size)

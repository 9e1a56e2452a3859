"""Whole-table profiles: missing values, value counts, coverage, cardinalities, months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantlens.functions.numeric import month_start, percent

#: 4,096 registers: a standard error of 1.6 percent.
SKETCH_BITS = 12


def _long_form(one_row: DataFrame, names: Sequence[str], name: str, value: str, keep: Sequence[str] = ()) -> DataFrame:
    return one_row.unpivot([F.col(k) for k in keep], list(names), name, value)


def null_profile(df: DataFrame) -> DataFrame:
    """Columns with missing values: count and percent, one pass over the table."""
    columns = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = _long_form(one, columns, "column_name", "missing", ["_rows"])
    return long.where(F.col("missing") > 0).select(
        "column_name", "missing", percent(F.col("missing"), F.col("_rows")).alias("percent")
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of every non-null value of several columns in one aggregation."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = text.unpivot([], list(columns), "variable", "value").where(F.col("value").isNotNull())
    return long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("rows"))


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), key)
    )


def coverage(df: DataFrame, codes: dict[str, str], all_name: str) -> DataFrame:
    """How many rows have each code, and all of them: count and percent."""
    every = F.lit(True)
    for column in codes.values():
        every = every & F.col(column).isNotNull()
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.col(column)).alias(name) for name, column in codes.items()],
        F.count_if(every).alias(all_name),
    )
    long = _long_form(one, [*codes, all_name], "metric", "rows", ["_rows"])
    return long.select("metric", "rows", percent(F.col("rows"), F.col("_rows"), 2).alias("percent"))


def cardinalities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct counts; Spark spreads each by (column, value), so no value is hot."""
    one = df.agg(*[F.countDistinct(F.col(c)).alias(c) for c in columns])
    return _long_form(one, columns, "column_name", "distinct_values")


def distinct_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, sketch): a mergeable sketch of each column's distinct values, a few kilobytes each.

    Store them per month and add new months; ``distinct_estimates`` merges any of them.
    """
    one = df.groupBy(*by).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_BITS).alias(c) for c in columns])
    return one.unpivot([F.col(b) for b in by], list(columns), "column_name", "sketch")


def distinct_estimates(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, distinct_values) of merged sketches; the standard error is 1.04 / sqrt(2 ^ SKETCH_BITS)."""
    return sketches.groupBy(*by, "column_name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))


def conditional_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows and share of rows (percent) meeting each rule."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(rule).alias(name) for name, rule in rules.items()])
    long = _long_form(one, list(rules), "rule", "rows", ["_rows"])
    return long.select("rule", "rows", percent(F.col("rows"), F.col("_rows"), 2).alias("percent"))


def monthly_volume(df: DataFrame, at: str) -> DataFrame:
    """Rows per month with the overall first and last day and the number of months."""
    monthly = (
        df.where(F.col(at).isNotNull())
        .groupBy(month_start(F.col(at)).alias("month"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min(F.col(at).cast("date")).alias("_lo"), F.max(F.col(at).cast("date")).alias("_hi"))
    )
    # One row per month is left, so the unpartitioned window is over calendar months only.
    everything = W.partitionBy(F.lit(1))
    return monthly.select(
        "month",
        "rows",
        F.min("_lo").over(everything).alias("first_day"),
        F.max("_hi").over(everything).alias("last_day"),
        F.count(F.lit(1)).over(everything).alias("months"),
    )

"""Column helpers of the native operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds ``value`` as a column that is computed once per row, however often it is used later.

    Catalyst merges neighbouring projections and would repeat a costly expression at every use;
    a generator of one row stands between them.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or with underscores before it until no column is called so, in any case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name

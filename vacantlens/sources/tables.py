"""Readers for phase tables, catalogs and CSV files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantlens.operators.filters import newest_first
from vacantlens.session import spread


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table; zone-less timestamps become timestamps of the session zone."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def text_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table whose texts cost far more to process than to move: a copy stored in fewer
    pieces than there are cores is spread over all of them."""
    return spread(table(spark, root, name))


def phase_table(spark: SparkSession, path: str, at: str, tie: Sequence[str], limit: int | None = None) -> DataFrame:
    """A stored phase table, newest rows first."""
    return newest_first(spark.read.parquet(path), at, tie, limit)


def catalog(df: DataFrame, columns: Sequence[str], required: str, order: Sequence[str]) -> DataFrame:
    """Projected, filtered and ordered catalog."""
    return df.where(F.col(required).isNotNull()).select(*columns).orderBy(*order)


#: Quotes are doubled inside quoted cells, which may hold line breaks.
CSV_QUOTING = {"quote": '"', "escape": '"', "multiLine": True}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, line_breaks: bool = True) -> DataFrame:
    """CSV with a declared schema.

    Cells may hold line breaks, so that only a reader of the whole file knows where a row begins: a file
    is one task. Say ``line_breaks=False`` of files whose rows are lines, and large ones are read in splits.
    """
    return spark.read.schema(schema).options(header=True, **(CSV_QUOTING | {"multiLine": line_breaks})).csv(path)


def read_sheets(
    spark: SparkSession, sheets: Sequence[tuple[str, str, int]], names: Sequence[str], row_number: str = "row_number"
) -> DataFrame:
    """Same-shaped sheets (path, sheet name, sheet index) stacked with lineage columns.

    Columns are named by position, extra ones are kept as ``extra_i`` and missing ones are
    null. Each sheet's first column is its row number, which the forward fill needs.
    """
    parts = []
    for path, sheet, index in sheets:
        # Without its quoted cells, which may hold line breaks, a row is a line. A stray quote can only hide
        # commas that the plain lines have, so no row has more cells than the larger count and one more.
        lines = F.split(F.regexp_replace("value", '"[^"]*+"', ""), r"\r\n|\n|\r").alias("bare"), F.split("value", r"\r\n|\n|\r").alias("plain")
        line = spark.read.text(path, wholetext=True).select(*lines).select(F.explode(F.concat("bare", "plain")).alias("line"))
        commas = F.length("line") - F.length(F.replace("line", F.lit(",")))
        width = (line.agg(F.max(commas)).first()[0] or 0) + 1
        cells = ", ".join(f"_c{i} string" for i in range(max(width, 1)))
        raw = spark.read.schema(cells).options(header=False, **CSV_QUOTING).csv(path)
        given = [row_number, *names]
        extra = raw.columns[len(given) :]
        if extra:
            used = raw.agg(*[F.count(c) for c in extra]).first()
            raw = raw.drop(*[c for c, n in zip(extra, used) if not n])
        given += [f"extra_{i}" for i in range(len(raw.columns) - len(given))]
        part = raw.toDF(*given[: len(raw.columns)])
        part = part.withColumn(row_number, F.col(row_number).try_cast("long"))
        parts.append(part.withColumn("source_sheet", F.lit(sheet)).withColumn("source_sheet_index", F.lit(index)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

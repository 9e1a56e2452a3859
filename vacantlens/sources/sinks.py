"""Writers for phase tables, the enriched table and CSV exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantlens.operators.clean import complete_rows, quarantine_rows
from vacantlens.operators.incremental import insert_or_ignore


def append_new(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str], path: str) -> None:
    """Append the rows whose key the target does not hold yet."""
    insert_or_ignore(target, batch, keys, order).write.mode("append").parquet(path)


def write_split(split: DataFrame, complete_path: str, quarantine_path: str, mode: str = "append") -> None:
    """Complete rows to one table, incomplete rows with their reasons to the other.

    ``split`` is read twice; pass a stored or checkpointed frame when its rules are costly.
    """
    complete_rows(split).withColumn("cleaned_at", F.current_timestamp()).write.mode(mode).parquet(complete_path)
    quarantine_rows(split).withColumn("cleaned_at", F.current_timestamp()).write.mode(mode).parquet(quarantine_path)


def write_enriched(df: DataFrame, path: str, month: str = "year_month", sort: Sequence[str] = ()) -> None:
    """Replace the enriched table: one folder per month, rows sorted by the lookup codes.

    ``rebalance`` lets adaptive execution split a month that is too large for one task.
    """
    _laid_out(df, month, sort).write.mode("overwrite").partitionBy(month).parquet(path)


def _laid_out(df: DataFrame, month: str, sort: Sequence[str]) -> DataFrame:
    laid_out = df.hint("rebalance", F.col(month))
    return laid_out.sortWithinPartitions(month, *sort) if sort else laid_out


def _fingerprints(df: DataFrame, month: str) -> DataFrame:
    """(month, rows, two digests of all rows in any order)."""
    columns = sorted(c for c in df.columns if c != month)
    rows = df.select(F.col(month).alias("_month"), *[F.xxhash64(F.lit(i), *columns).alias(f"_h{i}") for i in (1, 2)])
    return rows.groupBy("_month").agg(
        F.count(F.lit(1)).alias("_rows"), F.bit_xor("_h1").alias("_x"), F.sum(F.col("_h2").cast("decimal(38,0)")).alias("_s")
    )


def refresh_enriched(df: DataFrame, path: str, month: str = "year_month", sort: Sequence[str] = ()) -> list:
    """Bring the enriched table to the rows of ``df`` by rewriting only the months whose rows differ.

    Months are compared by their number of rows and two 64-bit digests. Returns the months written; a
    table that does not exist, or that has months ``df`` lacks, is written whole. Pass a stored frame: it is read
    for the comparison and for the writing.
    """
    spark = df.sparkSession
    months = _fingerprints(df, month)
    try:
        old = _fingerprints(spark.read.schema(df.schema).parquet(path), month)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        old = None
    if old is None:
        write_enriched(df, path, month, sort)
        return [r["_month"] for r in months.select("_month").collect()]  # a row per month
    a, b = months.alias("a"), old.alias("b")
    both = a.join(b, F.col("a._month").eqNullSafe(F.col("b._month")), "full")
    same = F.col("a._rows").eqNullSafe(F.col("b._rows")) & F.col("a._x").eqNullSafe(F.col("b._x")) & F.col("a._s").eqNullSafe(F.col("b._s"))
    differ = both.where(~same).select(F.col("a._month").alias("month"), F.col("a._rows").isNull().alias("gone")).collect()
    if any(r["gone"] for r in differ):
        write_enriched(df, path, month, sort)
        return [r["_month"] for r in months.select("_month").collect()]
    changed = [r["month"] for r in differ]
    if changed:
        wanted = F.col(month).isin([m for m in changed if m is not None])
        rows = df.where(wanted | F.col(month).isNull() if None in changed else wanted)
        # Only the folders of the months that are in the rows are replaced.
        _laid_out(rows, month, sort).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)
    return changed


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per task."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)

"""Incremental work: pending keys, existence, first copies, the duplicate-run frontier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantlens import config
from vacantlens.operators.scan import BLOCK_ROWS, balanced_blocks, same_block


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys, the unit of matching work."""
    return df.where(F.col(key).isNotNull()).select(key).distinct()


def pending_keys(keys: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Distinct keys that have no row in ``existing`` yet."""
    return distinct_keys(keys, key).join(existing.select(key), key, "left_anti")


def all_ids(complete: DataFrame, incomplete: DataFrame, key: str) -> DataFrame:
    return complete.select(key).unionByName(incomplete.select(key))


def existing_check(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is already known (semi join)."""
    return df.join(known.select(key), key, "left_semi")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in the given order. Each task keeps one row per key before the
    shuffle, so a key with very many copies does not load one task."""
    ranked = df.withColumn("_first", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_first") == 1).drop("_first")


def insert_or_ignore(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Rows of the batch to append: first copy per key, and only keys the target lacks."""
    return keep_first(batch, keys, order).join(target.select(*keys), list(keys), "left_anti")


def duplicate_run_frontier(
    df: DataFrame,
    source: str,
    seq: str,
    duplicate: str,
    saved: str,
    threshold: int = config.DUPLICATE_RUN,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Where each source reaches ``threshold`` duplicates in a row.

    A saved row ends the run; any other row leaves it as it is. ``seq`` is a unique
    integer position within the source. A source may be of any length: rows are ordered
    only inside even blocks of about ``block_rows`` rows, and the run that a block starts with
    is carried over from the block totals. Rows without source are a source of their own.
    """
    rows = df.select(
        F.col(source),
        F.col(seq).cast("long").alias("_seq"),
        F.col(duplicate).cast("long").alias("_dup"),
        F.col(saved).cast("boolean").alias("_reset"),
    )
    rows = balanced_blocks(rows, source, "_seq", block_rows)
    inside = W.partitionBy(source, "_block").orderBy("_seq").rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn("_c", F.sum("_dup").over(inside)).withColumn(
        "_at_reset", F.max(F.when(F.col("_reset"), F.col("_c"))).over(inside)
    )
    before = W.partitionBy(source).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        local.groupBy(source, "_block")
        .agg(F.max("_c").alias("_total"), F.max("_at_reset").alias("_last_reset"))
        .withColumn("_c_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .withColumn("_reset_total", F.col("_c_before") + F.col("_last_reset"))
        .withColumn("_carry", F.col("_c_before") - F.coalesce(F.max("_reset_total").over(before), F.lit(0)))
        .select(source, "_block", "_carry")
    )
    run = F.col("_c") - F.coalesce("_at_reset", F.lit(0)) + F.when(F.col("_at_reset").isNull(), F.col("_carry")).otherwise(0)
    runs = same_block(local, blocks, source).withColumn("_run", run)
    return runs.groupBy(source).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("_dup").alias("duplicates"),
        F.max("_run").alias("longest_run"),
        F.min(F.when(F.col("_run") >= threshold, F.col("_seq"))).alias("frontier"),
    )

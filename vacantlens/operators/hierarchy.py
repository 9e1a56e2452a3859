"""Reference catalogs: distinct entries, parents, roll-up, forward fill of sparse cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantlens.functions.parsing import academic_level_digit
from vacantlens.functions.text import strip
from vacantlens.operators.scan import BLOCK_ROWS, balanced_blocks, same_block


def catalog_distinct(df: DataFrame, columns: Sequence[str], required: str) -> DataFrame:
    """Distinct catalog entries out of a fact table."""
    return df.where(F.col(required).isNotNull()).select(*columns).distinct()


def parent_code(code: Column, level: int) -> Column:
    """Level 2 hangs on the first character, deeper levels on the code without its last one."""
    if level <= 1:
        return F.lit(None).cast("string")
    return F.left(code, F.lit(1)) if level == 2 else F.left(code, F.length(code) - 1)


def hierarchy_level(df: DataFrame, code: str, label: str, level: int) -> DataFrame:
    """Distinct (codigo, parent_codigo, descripcion) of one level; codes stay text."""
    return (
        df.where(F.col(code).isNotNull())
        .select(F.col(code).cast("string").alias(code), F.col(label).cast("string").alias(label))
        .distinct()
        .select(
            strip(F.col(code)).alias("codigo"),
            parent_code(strip(F.col(code)), level).alias("parent_codigo"),
            strip(F.col(label)).alias("descripcion"),
        )
    )


def roll_up(levels: Sequence[DataFrame]) -> DataFrame:
    """Each entry of the deepest level with code and label of all its ancestors.

    ``levels`` runs from level 1 down. Entries without a parent keep nulls above.
    """
    depth = len(levels)
    out = levels[-1].select(
        F.col("codigo").alias(f"code_{depth}"), F.col("descripcion").alias(f"label_{depth}"), F.col("parent_codigo").alias("_up")
    )
    for level in range(depth - 1, 0, -1):
        parent = levels[level - 1].select(
            F.col("codigo").alias(f"code_{level}"),
            F.col("descripcion").alias(f"label_{level}"),
            F.col("parent_codigo").alias("_next") if level > 1 else F.lit(None).cast("string").alias("_next"),
        )
        out = out.join(parent, F.col("_up") == F.col(f"code_{level}"), "left").drop("_up").withColumnRenamed("_next", "_up")
    return out.drop("_up")


def forward_fill(
    df: DataFrame, columns: Sequence[str], part: str, row_number: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Fill nulls with the last value above, per part, in ``row_number`` order.

    Rows are ordered only inside even blocks of about ``block_rows`` rows; the value a block starts
    with comes from the block ends before it, so one long part spreads over many tasks.
    """
    blocked = balanced_blocks(df, part, row_number, block_rows)
    inside = W.partitionBy(part, "_block").orderBy(row_number).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(part).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    local = blocked.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    ends = local.groupBy(part, "_block").agg(*[F.max_by(c, row_number).alias(f"_end_{c}") for c in columns])
    carried = ends.select(
        part, "_block", *[F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in columns]
    )
    out = same_block(local, carried, part)
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_carry_{c}")))
    return out.select(*df.columns)


def program_rows(sheets: DataFrame, part: str, row_number: str, hierarchy: Sequence[str], program: str, level_code: str) -> DataFrame:
    """Program catalog out of stacked sheets: filled hierarchy, real programs, valid levels."""
    filled = forward_fill(sheets, hierarchy, part, row_number)
    return (
        filled.where(F.col(program).isNotNull())
        .withColumn("academic_level", academic_level_digit(F.col(level_code)))
        .where(F.col("academic_level").isNotNull())
    )


def level_counts(programs: DataFrame, level: str = "academic_level") -> DataFrame:
    return programs.groupBy(level).agg(F.count(F.lit(1)).alias("programs"))

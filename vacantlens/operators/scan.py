"""Long ordered scans in even blocks.

A scan that carries something from row to row (the last value above, the length of a run) is cut into
blocks of neighbouring rows. Each block is scanned on its own and summed up in one row per part; the
summaries of the blocks before give what a block starts with.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantlens.session import stored

#: Rows of a block, and blocks of a scan; blocks of larger tables hold more rows.
BLOCK_ROWS, MOST_BLOCKS = 65_536, 8_192


def balanced_blocks(df: DataFrame, part: str, position: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with _block, which never falls in (part, position) order. Blocks are ranges of the rows that
    are there, so sparse or clustered positions and parts of any length still give even blocks.

    Ranges come from a sample; they are kept in a table, so that all uses and repeated tasks see the same.
    """
    blocks = min(-(-df.count() // block_rows), MOST_BLOCKS)
    if blocks <= 1:
        return df.withColumn("_block", F.lit(0))
    return stored(df.repartitionByRange(blocks, part, position).withColumn("_block", F.spark_partition_id()), "blocks")


def same_block(left: DataFrame, right: DataFrame, part: str) -> DataFrame:
    """Rows of ``left`` with the columns of ``right``, one row per (part, _block); a null part is a part."""
    renamed = right.withColumnsRenamed({part: "_right_part", "_block": "_right_block"})
    keys: list[Column] = [F.col(part).eqNullSafe(F.col("_right_part")), F.col("_block") == F.col("_right_block")]
    return left.join(renamed, reduce(Column.__and__, keys)).drop("_right_part", "_right_block")

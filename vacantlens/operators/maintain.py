"""Table maintenance as rewrites: refresh, patch, delete, validated pairs.

Each function returns the new content of a table. Write it to a new folder, never over
the one being read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def refresh_candidates(stored: DataFrame, fresh: DataFrame, key: str, code: str) -> DataFrame:
    """Replace the unvalidated candidates of the keys in ``fresh``; validated pairs stay.

    A fresh pair that a person has already validated is not inserted again.
    """
    keys = fresh.select(key).distinct()
    # A pair nobody has looked at may hold null as well as 0.
    checked = F.coalesce(F.col("validated"), F.lit(0)) == 1
    validated = stored.where(checked)
    kept = stored.where(~checked).join(keys, key, "left_anti")
    added = fresh.join(validated.select(key, code), [key, code], "left_anti")
    return kept.unionByName(validated).unionByName(added, allowMissingColumns=True)


def apply_patches(base: DataFrame, patches: DataFrame, key: str, columns: Sequence[str], order: str | None = None) -> DataFrame:
    """Update the named columns by key; a null in a patch leaves the stored value.

    Of several patches for a key the last non-null value by ``order`` counts, column by column,
    or the largest one without an order. Rows are never multiplied.
    """
    last = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if order else F.max(c) for c in columns}
    patch = patches.groupBy(key).agg(*[value.alias(f"_p_{c}") for c, value in last.items()])
    joined = base.join(patch, key, "left")
    return joined.select(
        *[F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns]
    )


def delete_keys(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def validated_pairs(candidates: DataFrame, key: str, code: str) -> DataFrame:
    """Human-approved (key, code) pairs, the training and evaluation set of a scorer."""
    return (
        candidates.where((F.col("validated") == 1) & F.col("validated_code").isNotNull())
        .select(key, F.col("validated_code").alias(code))
        .distinct()
    )


def precision_at_1(candidates: DataFrame, truth: DataFrame, key: str, code: str) -> DataFrame:
    """Share of validated keys whose top-ranked candidate is the validated code."""
    top = candidates.where(F.col("rank") == 1).select(key, F.col(code).alias("_top"))
    joined = truth.join(top, key, "left")
    hits = F.count_if(F.coalesce(F.col("_top") == F.col(code), F.lit(False)))
    return joined.agg(F.count(F.lit(1)).alias("validated_keys"), hits.alias("hits")).withColumn(
        "precision_at_1", F.col("hits") / F.nullif(F.col("validated_keys"), F.lit(0))
    )

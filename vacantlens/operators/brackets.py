"""Statistics and exact quantiles of several levels of keys, from one pass over the facts.

The facts' columns are written once, narrow. One aggregation gives all statistics. Values of keys of up to
2 ACCURACY rows are ordered as they are, after one shuffle. Larger keys get a quantile
sketch, made in parts before the shuffle; its rank error is bounded, so two of
its values bracket each wanted rank for certain. A last pass over the narrow rows counts how many lie
below the bracket and each value within. No task holds a large key's rows: a key of N rows leaves at
most about 4 N / ACCURACY values, or 2 ACCURACY if it is small, to one ordering.

Coarser keys share all passes. A missing key of the finest level leaves a row out of all levels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantlens.operators.quantiles import with_keys
from vacantlens.session import stored

#: A sketch's values are at most N / ACCURACY ranks off.
ACCURACY = 10_000


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which a null key, which marks a coarser level, meets null."""
    other = right.withColumnsRenamed({k: f"_right{k}" for k in keys})
    on: list[Column] = [F.col(k).eqNullSafe(F.col(f"_right{k}")) for k in keys]
    return left.join(other, reduce(Column.__and__, on), how).drop(*[f"_right{k}" for k in keys])


def bracketed(
    df: DataFrame,
    levels: Sequence[Sequence[str]],
    value: str,
    quantiles: Mapping[float, str],
    stats: Mapping[str, Column],
    having: Column | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per level and key: _level (place in ``levels``), the keys of the finest level (null where a
    level lacks them), ``stats``, and exact interpolated quantiles of the non-null values.

    ``levels[0]`` is the finest; the others are subsets of it. ``having`` filters the keys after the first pass.
    """
    keys = list(levels[0])
    group = ["_level", *keys]
    facts = stored(with_keys(df, keys), "facts")
    if len(levels) == 1:
        rows = facts.withColumn("_level", F.lit(0))
    else:
        own = [
            F.struct(F.lit(i).alias("_level"), *[(F.col(k) if k in level else F.lit(None).cast(facts.schema[k].dataType)).alias(k) for k in keys])
            for i, level in enumerate(levels)
        ]
        rows = facts.withColumn("_key", F.explode(F.array(*own))).select("_key.*", *[c for c in facts.columns if c not in keys])
    v = F.col(value).cast("double")
    summary = rows.groupBy(*group).agg(*[c.alias(name) for name, c in stats.items()], F.count(value).alias("_n"))
    summary = stored(summary.withColumn("_keep", F.lit(True) if having is None else having), "summary")
    values = rows.where(F.col(value).isNotNull()).select(*group, v.alias("_v"))

    # In keys of few rows everything is inside, as single ranks may fall between a sketch's percentages: their
    # values are ordered as they are. The large ones are at most one in 2 accuracy rows, a table of its own small size.
    large = stored(summary.where(F.col("_n") > 2 * accuracy).select(*group, "_n", "_keep"), "large")
    if large.isEmpty():
        chosen = _ordered(values, group, quantiles)
    else:
        small = _joined(values, large.select(*group), group, "left_anti")
        chosen = _ordered(small, group, quantiles).unionByName(_within_brackets(values, large.where("_keep").drop("_keep"), group, quantiles, accuracy))
    return _joined(summary.where("_keep"), chosen, group, "left").select(*group, *stats, *quantiles.values())


def _ordered(values: DataFrame, group: Sequence[str], quantiles: Mapping[float, str]) -> DataFrame:
    """The quantiles of keys of few rows: one shuffle, which also serves the last grouping."""
    # Zeros of either sign are one value.
    values = values.withColumn("_v", F.col("_v") + F.lit(0.0))
    key = W.partitionBy(*group)
    ranked = values.withColumns({"_r": F.row_number().over(key.orderBy("_v")) - 1, "_n": F.count(F.lit(1)).over(key)})
    out = []
    for p, name in quantiles.items():
        position = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = (F.max(F.when(F.col("_r") == rank, F.col("_v"))) for rank in (F.floor(position), F.ceil(position)))
        out.append((low + (high - low) * F.max(position - F.floor(position))).alias(name))
    return ranked.groupBy(*group).agg(*out)


def _within_brackets(values: DataFrame, large: DataFrame, group: Sequence[str], quantiles: Mapping[float, str], accuracy: int) -> DataFrame:
    """The quantiles of the keys in ``large``, from the values within the brackets of a sketch."""
    edges = [min(max(p + side * 2 / accuracy, 0.0), 1.0) for p in quantiles for side in (-1, 1)]
    sketches = _joined(values, large.select(*group), group).groupBy(*group).agg(F.percentile_approx("_v", edges, accuracy).alias("_edges"))
    bounded = _joined(large, stored(sketches, "sketches"), group, "left")

    slots = [
        F.struct(
            F.lit(i).alias("slot"),
            F.when(F.lit(p > 2 / accuracy), F.col("_edges")[2 * i]).alias("lo"),
            F.when(F.lit(p < 1 - 2 / accuracy), F.col("_edges")[2 * i + 1]).alias("hi"),
        )
        for i, p in enumerate(quantiles)
    ]
    brackets = stored(bounded.select(*group, "_n", F.array(*slots).alias("_slots")), "brackets")
    inside = _joined(values, brackets, group)
    placed = inside.select(*group, "_n", "_v", F.explode("_slots").alias("_s")).where("_s.hi IS NULL OR _v <= _s.hi")
    counted = (
        placed.select(*group, "_n", F.col("_s.slot").alias("_slot"), F.when(F.expr("_s.lo IS NULL OR _v >= _s.lo"), F.col("_v")).alias("_v"))
        .groupBy(*group, "_n", "_slot", "_v")
        .agg(F.count(F.lit(1)).alias("_f"))
    )
    # With one quantile the rows stay where the last grouping wants them.
    part = group if len(quantiles) == 1 else [*group, "_slot"]
    running = W.partitionBy(*part).orderBy(F.asc_nulls_first("_v")).rowsBetween(W.unboundedPreceding, 0)
    located = counted.withColumn("_end", F.sum("_f").over(running))

    def value_at(slot: int, rank: Column) -> Column:
        here = (F.col("_slot") == slot) & (rank >= F.col("_end") - F.col("_f")) & (rank < F.col("_end"))
        return F.max(F.when(here, F.col("_v")))

    out = []
    for i, (p, name) in enumerate(quantiles.items()):
        position = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = value_at(i, F.floor(position)), value_at(i, F.ceil(position))
        found = low + (high - low) * F.max(position - F.floor(position))
        out.append(F.when(low.isNull() | high.isNull(), F.raise_error(F.lit("a rank lies outside its bracket"))).otherwise(found).alias(name))
    return located.groupBy(*group).agg(*out)

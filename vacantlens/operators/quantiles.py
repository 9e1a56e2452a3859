"""Exact quantiles and describe() without holding a group in one task.

The built-in exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, which fails when one key owns a third of the rows. Here values
are first counted per (key, value); each value falls into a narrow bucket that is a
pure function of the value; bucket totals tell which buckets hold the wanted ranks;
only those buckets are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantlens.functions.numeric import fixed_mean

_STEPS = 9  # 2**9 buckets between a power of two and the next


def value_bucket(c: Column) -> Column:
    """Bucket number that never decreases as the value grows, for any double."""
    size = F.abs(c.cast("double"))
    power = F.floor(F.log2(size))
    step = F.floor(size * F.pow(F.lit(2.0), F.least(F.lit(_STEPS) - power, F.lit(1000))))
    number = (power + 1100) * 2048 + step
    return F.when(c == 0, F.lit(0.0)).otherwise(F.signum(c.cast("double")) * number).cast("long")


def quantile_name(prob: float) -> str:
    return "q" + f"{prob * 100:g}".replace(".", "_")


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are all present: a missing key forms no group."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], weight: str | None = None
) -> DataFrame:
    """One row per key: ``n`` non-null values and one linearly interpolated column per probability.

    With ``weight`` a row stands for that many equal values, so that rows counted once for a
    fine key also serve the coarser keys.
    """
    keys = list(keys)
    repeats = F.count(F.lit(1)) if weight is None else F.sum("_w")
    counted = (
        with_keys(df, keys)
        .where(F.col(value).isNotNull())
        .select(*keys, F.col(value).cast("double").alias("_v"), (F.lit(1) if weight is None else F.col(weight)).alias("_w"))
        .groupBy(*keys, "_v")
        .agg(repeats.alias("_f"))
        .withColumn("_b", value_bucket(F.col("_v")))
        # Always true; stated here so that both uses below have one plan and share its shuffle.
        .where(F.col("_b").isNotNull())
    )
    running = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    buckets = (
        counted.groupBy(*keys, "_b")
        .agg(F.sum("_f").alias("_bf"))
        .withColumn("_to", F.sum("_bf").over(running))
        .withColumn("_n", F.sum("_bf").over(W.partitionBy(*keys)))
    )
    positions = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    ends = [end for p in positions for end in (F.floor(p), F.ceil(p))]
    holds_rank = F.lit(False)
    for rank in ends:
        holds_rank = holds_rank | ((rank >= F.col("_to") - F.col("_bf")) & (rank < F.col("_to")))
    targets = buckets.where(holds_rank).select(*keys, "_b", (F.col("_to") - F.col("_bf")).alias("_from"), "_n")
    inside = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    located = counted.join(targets, [*keys, "_b"]).withColumn("_end", F.col("_from") + F.sum("_f").over(inside))

    def value_at(rank: Column) -> Column:
        here = (rank >= F.col("_end") - F.col("_f")) & (rank < F.col("_end"))
        return F.max(F.when(here, F.col("_v")))

    out = []
    for prob, position in zip(probs, positions):
        low, high = value_at(F.floor(position)), value_at(F.ceil(position))
        share = F.max(position - F.floor(position))
        out.append((low + (high - low) * share).alias(quantile_name(prob)))
    return located.groupBy(*keys).agg(F.max("_n").alias("n"), *out)


def attach_quantiles(
    stats: DataFrame, df: DataFrame, keys: Sequence[str], value: str, names: dict[float, str], weight: str | None = None
) -> DataFrame:
    """Add exact quantile columns to a one-row-per-key aggregate of the same rows."""
    keys = list(keys)
    q = exact_quantiles(df, keys, value, list(names), weight)
    q = q.select(*keys, *[F.col(quantile_name(p)).alias(name) for p, name in names.items()])
    if not keys:
        return stats.withColumns({name: q.select(name).scalar() for name in names.values()})
    return stats.join(q, keys, "left")


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles, max of one column, optionally per key."""
    c = F.col(value)
    stats = with_keys(df, by).groupBy(*by).agg(
        F.count(c).alias("count"),
        fixed_mean(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )
    return attach_quantiles(stats, df, by, value, {0.25: "q25", 0.5: "q50", 0.75: "q75"})


def unpivot_numeric(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(variable, value) rows of several numeric columns, so one job describes them all."""
    doubles = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot([F.col(k) for k in keep], list(columns), "variable", "value")


def histogram(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = 50) -> DataFrame:
    """Equal-width bins between each key's own minimum and maximum; the last bin is closed."""
    by = list(by)
    rows = with_keys(df, [*by, value]).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_f"))
    bounds = rows.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    if by:
        joined = rows.join(bounds, by)
    else:
        joined = rows.withColumns({c: bounds.select(c).scalar() for c in ("lo", "hi")})
    span = F.nullif((F.col("hi") - F.col("lo")).cast("double"), F.lit(0.0))
    scaled = F.least(F.floor((F.col(value) - F.col("lo")) / span * bins), F.lit(bins - 1))
    number = F.when(span.isNull(), bins // 2).otherwise(scaled).cast("int")
    return (
        joined.withColumn("bin", number)
        .groupBy(*by, "bin")
        .agg(F.sum("_f").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )

"""Pay dispersion by occupation, institution and tier, and tier-relative anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantlens import config
from vacantlens.functions.numeric import fixed_mean, fixed_sum, round_even
from vacantlens.operators.brackets import bracketed
from vacantlens.operators.quantiles import attach_quantiles, histogram
from vacantlens.session import stored


def plausible(df: DataFrame, pay: str, low: float = config.SALARY_MIN, high: float = config.SALARY_MAX) -> DataFrame:
    """Rows whose plausibility flag is 'ok', as a condition that reaches the Parquet scan."""
    return df.where(F.col(pay).between(low, high) | F.col(pay).isNull())


def occupation_volume(df: DataFrame, code: str, institution: str, pay: str) -> DataFrame:
    """Postings, distinct institutions and mean pay per occupation."""
    return (
        df.where(F.col(code).isNotNull())
        .groupBy(code)
        .agg(
            F.count(F.lit(1)).alias("postings"),
            F.countDistinct(institution).alias("institutions"),
            fixed_mean(F.col(pay)).alias("avg_salary"),
        )
    )


def volume_bands(volume: DataFrame, bounds: Sequence[int] = (10, 50, 100)) -> DataFrame:
    """Number of occupations with at least so many postings."""
    one = volume.agg(*[F.count_if(F.col("postings") >= b).alias(f"postings_{b}_plus") for b in bounds])
    return one.unpivot([], one.columns, "band", "occupations")


def pay_dispersion(
    df: DataFrame,
    labels: DataFrame,
    code: str,
    institution: str,
    pay: str,
    low: float = config.SALARY_MIN,
    high: float = config.SALARY_MAX,
    min_postings: int = config.MIN_POSTINGS,
    min_institutions: int = config.MIN_INSTITUTIONS,
) -> DataFrame:
    """Occupations with enough postings and institutions, by coefficient of variation of pay.

    ``labels`` has columns (codigo, descripcion). The fact table is aggregated before
    the label join, so only one row per occupation meets the label table.
    """
    rows = plausible(df.where(F.col(code).isNotNull()), pay, low, high).select(
        F.col(code).cast("string").alias("code"), F.col(institution).alias("_inst"), F.col(pay).alias("_pay")
    )
    stats = bracketed(
        rows,
        [["code"]],
        "_pay",
        {0.5: "median_salary"},
        {
            "postings": F.count(F.lit(1)),
            "institutions": F.countDistinct("_inst"),
            "avg_salary": fixed_mean(F.col("_pay")),
            "std_salary": F.stddev_samp("_pay"),
        },
        having=(F.col("postings") >= min_postings) & (F.col("institutions") >= min_institutions),
    )
    named = stats.join(
        labels.select(F.col("codigo").cast("string").alias("code"), "descripcion"), "code", "left"
    )
    cv = round_even(F.col("std_salary") / F.col("avg_salary") * 100, 1)
    return named.select(
        "code", "descripcion", "postings", "institutions", "median_salary", "avg_salary", "std_salary", cv.alias("cv_salary")
    ).orderBy(F.desc("cv_salary"), "code")


def institution_pay(df: DataFrame, keys: Sequence[str], institution: str, pay: str) -> DataFrame:
    """Pay distribution per institution within ``keys`` (one occupation or all of them),
    with the overall median of the keys beside it."""
    keys = list(keys)
    group = [*keys, institution]
    c = F.col(pay)
    rows = bracketed(
        df.select(*group, pay),
        [group, keys],
        pay,
        {0.5: "median_salary"},
        {
            "postings": F.count(c),
            "avg_salary": fixed_mean(c),
            "std_salary": F.stddev_samp(c),
            "min_salary": F.min(c),
            "max_salary": F.max(c),
        },
    )
    rows = stored(rows, "levels")
    own = rows.where("_level = 0").drop("_level")
    overall = rows.where("_level = 1").select(*keys, F.col("median_salary").alias("overall_median"))
    return own.join(overall, keys, "left") if keys else own.withColumn("overall_median", overall.scalar())


def tier_pay(df: DataFrame, keys: Sequence[str], tier: str, pay: str) -> DataFrame:
    """count, median, mean, std of pay per tier, rounded to cents."""
    c = F.col(pay)
    full = bracketed(
        df.select(*keys, tier, pay),
        [[*keys, tier]],
        pay,
        {0.5: "q50"},
        {"count": F.count(c), "mean": fixed_mean(c), "std": F.stddev_samp(c)},
    )
    return full.select(
        *keys,
        tier,
        "count",
        round_even(F.col("q50"), 2).alias("median"),
        round_even(F.col("mean"), 2).alias("mean"),
        round_even(F.col("std"), 2).alias("std"),
    )


def tier_zscores(
    df: DataFrame,
    occupation: str,
    tier: str,
    institution: str,
    pay: str,
    min_tier_rows: int = 5,
    min_postings: int = 2,
    z_limit: float = config.Z_LIMIT,
) -> DataFrame:
    """Mean z-score of each institution within its occupation and tier, for all occupations at once.

    The mean of the rows' z-scores equals the z-score of the mean, so the fact table is
    reduced to one row per institution before it meets the tier's mean and deviation; no
    window over a whole tier is needed, however large the tier is.
    """
    group = [occupation, tier]
    rows = df.where(F.col(tier).isNotNull() & F.col(occupation).isNotNull() & F.col(pay).isNotNull())
    inst = stored(bracketed(
        rows.select(*group, institution, pay),
        [[*group, institution]],
        pay,
        {0.5: "median_salary"},
        {"postings": F.count(F.lit(1)), "_sum": fixed_sum(F.col(pay)), "_var": F.var_pop(pay)},
    ), "institutions").withColumn("_avg", F.col("_sum") / F.col("postings"))
    means = inst.groupBy(*group).agg(
        F.sum("postings").alias("tier_n"), (F.sum("_sum") / F.sum("postings")).alias("tier_mean")
    )
    spread = F.sum(F.col("postings") * (F.col("_var") + F.pow(F.col("_avg") - F.col("tier_mean"), F.lit(2))))
    tiers = (
        inst.join(means, group)
        .groupBy(*group)
        .agg(F.max("tier_n").alias("tier_n"), F.max("tier_mean").alias("tier_mean"), spread.alias("_spread"))
        .withColumn("tier_std", F.sqrt(F.col("_spread") / F.nullif(F.col("tier_n") - 1, F.lit(0))))
    )
    usable = (F.col("tier_n") >= min_tier_rows) & (F.col("tier_std") > 0)
    z = F.when(usable, (F.col("_avg") - F.col("tier_mean")) / F.col("tier_std"))
    scored = (
        inst.where(F.col("postings") >= min_postings)
        .join(tiers, group)
        .select(*group, institution, "postings", z.alias("avg_z_score"), "median_salary")
    )
    return scored.withColumn("flagged", F.coalesce(F.abs("avg_z_score") > z_limit, F.lit(False)))


def institution_volume(df: DataFrame, institution: str, tier: str) -> DataFrame:
    return (
        df.where(F.col(institution).isNotNull() & F.col(tier).isNotNull())
        .groupBy(institution, tier)
        .agg(F.count(F.lit(1)).alias("postings"))
    )


def top_per_tier(volume: DataFrame, institution: str, tier: str, top: int = 20) -> DataFrame:
    """The institutions with most postings of each tier; ties go by name."""
    order = W.partitionBy(tier).orderBy(F.desc("postings"), institution)
    return volume.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)


def volume_histogram(volume: DataFrame, tier: str, bins: int = 30) -> DataFrame:
    """Distribution of postings per institution within each tier, with the tier's median."""
    bars = histogram(volume, "postings", [tier], bins)
    return attach_quantiles(bars, volume, [tier], "postings", {0.5: "median"})

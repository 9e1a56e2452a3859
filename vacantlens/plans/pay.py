"""Pay dispersion, tiers and anomalies over line items and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantlens.functions.numeric import round_even
from vacantlens.operators import dispersion
from vacantlens.operators.enrich import label_codes
from vacantlens.operators.quantiles import histogram, unpivot_numeric
from vacantlens.plans.sql import mean, r
from vacantlens.sources.tables import table

# Market segment as tier code; segments outside the three codes have no tier label.
SEGMENT_TIERS = {"HOUSEHOLD": "E", "BUILDING": "R", "MACHINERY": "M"}
LOW, HIGH = 5000.0, 90000.0


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: round_even(F.col(c), digits) for c in columns})


def line_postings(spark: SparkSession, root: str) -> DataFrame:
    """A line item as a posting: part brand = occupation, supplier = institution, region = tier."""
    line = table(spark, root, "lineitem").select("l_partkey", "l_suppkey", F.col("l_extendedprice").alias("salary"))
    part = table(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("occupation"))
    supplier = table(spark, root, "supplier")
    nation = table(spark, root, "nation")
    region = table(spark, root, "region")
    places = (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("institution"), F.col("r_name").alias("tier"))
    )
    return line.join(part, "l_partkey").join(places, "l_suppkey").select("occupation", "institution", "tier", "salary")


LINE_POSTINGS = """
  SELECT p_brand AS occupation, s_name AS institution, r_name AS tier, l_extendedprice AS salary
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"""


def order_postings(spark: SparkSession, root: str) -> DataFrame:
    """An order as a posting: customer = institution, market segment = tier code."""
    orders = table(spark, root, "orders")
    customer = table(spark, root, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .withColumn("tier_code", label_codes(F.col("c_mktsegment"), SEGMENT_TIERS))
        .withColumn("tier", label_codes(F.col("tier_code")))
    )


ORDER_POSTINGS = """
  SELECT *, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Nacional' WHEN 'BUILDING' THEN 'Regional'
                              WHEN 'MACHINERY' THEN 'Municipal' END AS tier
  FROM orders JOIN customer ON c_custkey = o_custkey"""


def pay_dispersion(spark: SparkSession, root: str) -> DataFrame:
    labels = table(spark, root, "part").select(
        F.col("p_partkey").alias("codigo"), F.concat_ws(" ", "p_name", "p_brand").alias("descripcion")
    )
    out = dispersion.pay_dispersion(
        table(spark, root, "lineitem"), labels, "l_partkey", "l_suppkey", "l_extendedprice",
        low=LOW, high=HIGH, min_postings=20, min_institutions=8,
    )
    return rounded(out, 4, "median_salary", "avg_salary", "std_salary")


def occupation_volume(spark: SparkSession, root: str) -> DataFrame:
    out = dispersion.occupation_volume(table(spark, root, "lineitem"), "l_partkey", "l_suppkey", "l_extendedprice")
    return rounded(out, 4, "avg_salary")


def volume_bands(spark: SparkSession, root: str) -> DataFrame:
    volume = dispersion.occupation_volume(table(spark, root, "lineitem"), "l_partkey", "l_suppkey", "l_extendedprice")
    return dispersion.volume_bands(volume, (10, 25, 40))


def institution_pay(spark: SparkSession, root: str) -> DataFrame:
    out = dispersion.institution_pay(line_postings(spark, root), ["occupation"], "institution", "salary")
    return rounded(out, 4, "avg_salary", "std_salary", "median_salary", "overall_median")


def tier_pay(spark: SparkSession, root: str) -> DataFrame:
    return dispersion.tier_pay(line_postings(spark, root), ["occupation"], "tier", "salary")


def tier_zscore_flags(spark: SparkSession, root: str) -> DataFrame:
    out = dispersion.tier_zscores(line_postings(spark, root), "occupation", "tier", "institution", "salary", z_limit=0.5)
    return rounded(out, 6, "avg_z_score", "median_salary")


def tier_topn(spark: SparkSession, root: str) -> DataFrame:
    volume = dispersion.institution_volume(order_postings(spark, root), "c_name", "tier")
    return dispersion.top_per_tier(volume, "c_name", "tier", 20)


def count_histogram(spark: SparkSession, root: str) -> DataFrame:
    volume = dispersion.institution_volume(order_postings(spark, root), "c_name", "tier")
    return rounded(dispersion.volume_histogram(volume, "tier", 30), 4, "median")


def numeric_histograms(spark: SparkSession, root: str) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    long = unpivot_numeric(table(spark, root, "lineitem"), columns)
    return histogram(long, "value", ["variable"], 50)


QUERIES = {
    "pay_dispersion": pay_dispersion,
    "occupation_volume": occupation_volume,
    "volume_bands": volume_bands,
    "institution_pay": institution_pay,
    "tier_pay": tier_pay,
    "tier_zscore_flags": tier_zscore_flags,
    "tier_topn": tier_topn,
    "count_histogram": count_histogram,
    "numeric_histograms": numeric_histograms,
}

ORACLES = {
    "pay_dispersion": f"""
      WITH s AS (
        SELECT CAST(l_partkey AS VARCHAR) AS code, count(*) AS postings, count(DISTINCT l_suppkey) AS institutions,
               median(l_extendedprice) AS med, {mean('l_extendedprice')} AS m, stddev_samp(l_extendedprice) AS sd
        FROM lineitem WHERE l_extendedprice BETWEEN {LOW} AND {HIGH} GROUP BY l_partkey
        HAVING count(*) >= 20 AND count(DISTINCT l_suppkey) >= 8)
      SELECT code, p_name || ' ' || p_brand AS descripcion, postings, institutions, {r('med')} AS median_salary,
             {r('m')} AS avg_salary, {r('sd')} AS std_salary, {r('sd / m * 100', 1)} AS cv_salary
      FROM s LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = code ORDER BY cv_salary DESC, code""",
    "occupation_volume": f"""
      SELECT l_partkey, count(*) AS postings, count(DISTINCT l_suppkey) AS institutions,
             {r(mean('l_extendedprice'))} AS avg_salary
      FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY l_partkey""",
    "volume_bands": """
      WITH v AS (SELECT count(*) AS n FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY l_partkey)
      SELECT 'postings_10_plus' AS band, count(*) FILTER (n >= 10) AS occupations FROM v
      UNION ALL SELECT 'postings_25_plus', count(*) FILTER (n >= 25) FROM v
      UNION ALL SELECT 'postings_40_plus', count(*) FILTER (n >= 40) FROM v""",
    "institution_pay": f"""
      WITH p AS ({LINE_POSTINGS}),
      o AS (SELECT occupation, median(salary) AS om FROM p GROUP BY occupation),
      s AS (SELECT occupation, institution, count(salary) AS postings, {mean('salary')} AS m, stddev_samp(salary) AS sd,
                   min(salary) AS min_salary, max(salary) AS max_salary, median(salary) AS med
            FROM p GROUP BY occupation, institution)
      SELECT occupation, institution, postings, {r('m')} AS avg_salary, {r('sd')} AS std_salary, min_salary, max_salary,
             {r('med')} AS median_salary, {r('om')} AS overall_median
      FROM s JOIN o USING (occupation)""",
    "tier_pay": f"""
      WITH p AS ({LINE_POSTINGS})
      SELECT occupation, tier, count(salary) AS "count", {r('median(salary)', 2)} AS median,
             {r(mean('salary'), 2)} AS mean, {r('stddev_samp(salary)', 2)} AS std
      FROM p WHERE tier IS NOT NULL GROUP BY occupation, tier""",
    "tier_zscore_flags": f"""
      WITH p AS ({LINE_POSTINGS}),
      t AS (SELECT occupation, tier, avg(salary) AS tm, stddev_samp(salary) AS ts, count(*) AS tn FROM p GROUP BY ALL),
      z AS (SELECT occupation, tier, institution, salary,
                   CASE WHEN tn >= 5 AND ts > 0 THEN (salary - tm) / ts END AS z
            FROM p JOIN t USING (occupation, tier)),
      i AS (SELECT occupation, tier, institution, count(*) AS postings, avg(z) AS az, median(salary) AS med
            FROM z GROUP BY ALL HAVING count(*) >= 2)
      SELECT occupation, tier, institution, postings, {r('az', 6)} AS avg_z_score, {r('med', 6)} AS median_salary,
             coalesce(abs(az) > 0.5, false) AS flagged FROM i""",
    "tier_topn": f"""
      WITH v AS (SELECT c_name, tier, count(*) AS postings FROM ({ORDER_POSTINGS}) WHERE tier IS NOT NULL GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY postings DESC, c_name) AS rank FROM v)
      SELECT * FROM k WHERE rank <= 20""",
    "count_histogram": f"""
      WITH v AS (SELECT c_name, tier, count(*) AS n FROM ({ORDER_POSTINGS}) WHERE tier IS NOT NULL GROUP BY ALL),
      b AS (SELECT tier, min(n) AS lo, max(n) AS hi, {r('median(n)')} AS median FROM v GROUP BY tier)
      SELECT tier, CAST(CASE WHEN hi = lo THEN 15 ELSE least(floor((n - lo) / CAST(hi - lo AS DOUBLE) * 30), 29) END AS INT) AS bin,
             count(*) AS rows, lo, hi, median
      FROM v JOIN b USING (tier) GROUP BY ALL""",
    "numeric_histograms": """
      WITH u AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
                 ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME variable VALUE value),
      b AS (SELECT variable, min(value) AS lo, max(value) AS hi FROM u GROUP BY variable)
      SELECT variable, CAST(CASE WHEN hi = lo THEN 25 ELSE least(floor((value - lo) / (hi - lo) * 50), 49) END AS INT) AS bin,
             count(*) AS rows, lo, hi
      FROM u JOIN b USING (variable) GROUP BY ALL""",
}

"""All queries and their SQL checks, collected from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vacantlens.plans import catalogs, cleaning, features, flow, lookups, matching, pay, quality, stability, upkeep

MODULES = [pay, quality, stability, cleaning, lookups, catalogs, upkeep, matching, flow, features]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)

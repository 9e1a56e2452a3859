"""Snippets shared by the SQL checks."""

from __future__ import annotations


def r(x: str, digits: int = 4) -> str:
    """Round half to even at a number of decimals, as the Spark side does."""
    return f"round_even(CAST({x} AS DOUBLE) * 1e{digits}, 0) / 1e{digits}"


def mean(x: str) -> str:
    return f"(CAST(sum(CAST({x} AS DECIMAL(30,6))) AS DOUBLE) / count({x}))"


def total(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(30,6))) AS DOUBLE)"


def norm(x: str) -> str:
    """Comparison form of a text; RE2 word classes are ASCII, so letters are named."""
    upper = f"upper(replace({x}, 'ß', 'SS'))"
    plain = rf"regexp_replace({upper}, '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g')"
    return rf"trim(regexp_replace({plain}, '\s+', ' ', 'g'))"

"""Field parsers: numbers, dates, classes and flags out of free text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantlens import config
from vacantlens.functions.text import fold_accents, strip

# Flags for patterns written for Unicode text: \s \d \w as Unicode, '.' stops at \n only.
_UNICODE = "(?Ud)"


def parse_posting_id(c: Column) -> Column:
    """All digits of the text as one integer; null when there is none."""
    return F.regexp_replace(c, r"[^0-9]", "").try_cast("bigint")


def parse_money(c: Column) -> Column:
    """'S/. 4,000.00' -> 4000.0; anything that is not a plain number is null."""
    text = F.regexp_replace(strip(F.replace(c, F.lit("S/. "), F.lit(""))), ",", "")
    plain = text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\z")
    return F.when(plain, text.try_cast("double"))


def parse_count(c: Column) -> Column:
    text = strip(c)
    return F.when(text.rlike(r"^[+-]?\d+\z"), text.try_cast("int"))


def parse_date(c: Column) -> Column:
    """Day/month/year with one or two digits for day and month."""
    text = strip(c)
    return F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}\z"), F.try_to_date(text, "d/M/yyyy"))


def classify_contract(
    c: Column, patterns: Sequence[tuple[str, str]] = config.CONTRACT_TYPE_PATTERNS
) -> Column:
    """First pattern that matches the start of the text names the class."""
    text = strip(c)
    out = F.lit(None).cast("string")
    for pattern, name in reversed(patterns):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def _first_int(c: Column, patterns: Sequence[str]) -> Column:
    found = [F.nullif(F.regexp_extract(c, _UNICODE + p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found).try_cast("int")


def _has_any(c: Column, keywords: Sequence[str]) -> Column:
    out = F.lit(False)
    for keyword in keywords:
        out = out | c.contains(keyword)
    return F.coalesce(out, F.lit(False))


def parse_experience(c: Column, use_total: bool = False, paren_years: bool = False) -> dict[str, Column]:
    """Years of general and specific experience and the two sector flags.

    ``use_total`` also tries the patterns for an overall minimum, which the
    published rule lists but never applies. ``paren_years`` reads a number in brackets
    behind its word, as in ``TRES (03) AÑOS``, which no published pattern matches.
    """
    text = F.upper(c)
    if paren_years:
        text = F.regexp_replace(text, r"\p{L}+\s*\(\s*(\d{1,2})\s*\)", "$1")
    general = _first_int(text, config.GENERAL_YEARS_PATTERNS)
    if use_total:
        general = F.coalesce(general, _first_int(text, config.TOTAL_YEARS_PATTERNS))
    needed = ~_has_any(text, config.NO_EXPERIENCE_KEYWORDS)
    return {
        "experience_general_years": general,
        "experience_specific_years": _first_int(text, config.SPECIFIC_YEARS_PATTERNS),
        "sector_public_required": (needed & _has_any(text, config.PUBLIC_SECTOR_KEYWORDS)).cast("int"),
        "sector_private_required": (needed & _has_any(text, config.PRIVATE_SECTOR_KEYWORDS)).cast("int"),
    }


def parse_academic(c: Column, fold: bool = False) -> dict[str, Column]:
    """Academic level (first keyword in priority order) and requirement flags.

    Keywords carry no accents; ``fold`` also folds the text so that accented
    spellings match.
    """
    text = F.upper(c)
    level_text = fold_accents(text) if fold else text
    levels = F.array().cast("array<int>")
    name = F.lit(None).cast("string")
    thesis = F.lit(0)
    for keyword, codes, level_name, needs_thesis in reversed(config.ACADEMIC_LEVELS):
        hit = level_text.contains(keyword)
        codes_column = F.array(*[F.lit(code) for code in codes]).cast("array<int>")
        levels = F.when(hit, codes_column).otherwise(levels)
        name = F.when(hit, level_name).otherwise(name)
        thesis = F.when(hit, needs_thesis).otherwise(thesis)
    return {
        "search_levels": levels,
        "level_name": name,
        "thesis_required": thesis,
        "accepts_related_fields": _has_any(text, config.RELATED_FIELDS_KEYWORDS).cast("int"),
        "requires_colegiado": _has_any(text, config.COLEGIADO_KEYWORDS).cast("int"),
        "requires_habilitado": _has_any(text, config.HABILITADO_KEYWORDS).cast("int"),
        "multiple_options_allowed": _has_any(text, config.MULTIPLE_OPTIONS_KEYWORDS).cast("int"),
    }


def academic_level_digit(c: Column) -> Column:
    """Last character of a program code as the level; only 3 to 9 are levels."""
    digit = F.right(c, F.lit(1)).try_cast("int")
    return F.when(digit.between(3, 9), digit)

"""Text rules as column expressions; no Python runs per row.

Java regex classes are ASCII by default, so whitespace is spelled out as the
Unicode set and ``(?U)`` is used where word or digit classes are needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantlens.config import BLANK_VALUES, NO_INFO

# Body of a character class: every Unicode whitespace character.
WS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The same characters one by one, for trimming, which looks at the ends of a text only.
WS_CHARS = (
    "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680]))
    + "".join(map(chr, [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
)


def _drop(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def strip(c: Column, extra: str = "") -> Column:
    return F.btrim(c, F.lit(extra + WS_CHARS))


def squeeze(c: Column) -> Column:
    """One blank for each run of whitespace, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def clean_text(
    c: Column,
    trim: bool = True,
    remove_quotes: bool = True,
    remove_punctuation: bool = True,
    remove_extra_spaces: bool = True,
) -> Column:
    """Quotes, inverted marks, bullets at line starts and extra blanks removed.

    Null or '' gives null; text that cleans to nothing gives ``NO INFO``.
    """
    out = strip(c) if trim else c
    if remove_quotes:
        out = F.btrim(out, F.lit("\"'"))
    if remove_punctuation:
        out = strip(out, "¿¡")
        out = _drop(out, rf"(?md)^[{WS}\-–•*.]+")
    out = squeeze(out) if remove_extra_spaces else strip(out)
    return F.when(c != "", F.coalesce(_null_if(out, ""), F.lit(NO_INFO)))


def _null_if(c: Column, value: str) -> Column:
    """``nullif`` that names ``c`` once, so that a long chain of rules is not run twice."""
    return F.try_element_at(F.array_remove(F.array(c), value), F.lit(1))


def null_if_no_info(c: Column) -> Column:
    return _null_if(c, NO_INFO)


def clean_free_text(c: Column) -> Column:
    """Experience and academic text: generic cleaning, nothing left is null."""
    return null_if_no_info(clean_text(c))


def clean_listing(c: Column) -> Column:
    """Knowledge, competencies, specialization: one blank after ',' and ';'."""
    out = null_if_no_info(clean_text(c))
    # Clean text has single blanks only, so plain replacements do.
    for mark in ",;":
        for found, put in ((f" {mark}", mark), (f"{mark} ", mark), (mark, f"{mark} ")):
            out = F.replace(out, F.lit(found), F.lit(put))
    return F.btrim(out)


def clean_title(
    c: Column, roman_word_boundary: bool = False, gender_word_boundary: bool = False
) -> Column:
    """Title without quantity words, numbers, gender marks and Roman numerals.

    The published rule has no right boundary on Roman numerals and on '/A', '/O',
    so it eats the first letter of some words; the two flags mend that.
    """
    # The published patterns, in order.
    out = _drop(c, rf"(?i)^(UN/A|UNA|UNAS|UNOS|UN)[{WS}]+")
    out = _drop(out, rf"^[\(\p{{Nd}}\).:{WS}]+")
    out = F.regexp_replace(out, rf"[{WS}]+\(?\p{{Nd}}+\)?[{WS}.]*", " ")
    out = _drop(out, rf"[{WS}.]+\(?\p{{Nd}}+\)?[{WS}]*\z")
    out = F.regexp_replace(out, rf"[{WS}]*[(/]([AO])[)][{WS}]*", " ")
    gender_end = r"(?![\p{L}])" if gender_word_boundary else ""
    out = squeeze(F.regexp_replace(out, rf"[{WS}]*/[AO]{gender_end}[{WS}]*", " "))
    roman_end = r"(?![\p{L}])" if roman_word_boundary else ""
    out = F.regexp_replace(
        out, rf"(?i)[{WS}]+(CM|CD|XC|XL|IX|IV|[IVX])+{roman_end}[{WS}–\-]*", " "
    )
    out = squeeze(out)
    return null_if_no_info(clean_text(out))


def normalize_text(c: Column) -> Column:
    """Comparison form: upper case, punctuation as blanks, blanks collapsed."""
    return squeeze(F.regexp_replace(F.upper(c), r"(?U)[^\w\s]", " "))


def blank_special(c: Column) -> Column:
    """Null and the special 'nothing here' values become '' before vectorising."""
    return F.when(c.isNull() | F.upper(c).isin(BLANK_VALUES), "").otherwise(c)


def fold_accents(c: Column) -> Column:
    return F.translate(c, "ÁÉÍÓÚÜáéíóúü", "AEIOUUaeiouu")


def text_digest(c: Column) -> Column:
    """32-byte stand-in for a long text in distinct counts and grouping keys."""
    return F.unhex(F.sha2(c.cast("binary"), 256))

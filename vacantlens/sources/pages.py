"""Fields out of stored HTML pages, as column expressions.

A page is cut into parts, each a tag with the text behind it. One fold over the parts carries the
depth of open elements and notes where labels and values begin and end, as part numbers; texts are
joined only for what was found. Work is linear in the page.

Defined cases: comments, scripts and styles are no text; ``<x/>`` closes itself; an element left open
ends with the page; a closing tag without an opening one is ignored at depth 0; labels inside labels
and values inside values belong to the outer one; a null page has no fields; an empty field is null.
"""

from __future__ import annotations

import html
import re
from html.entities import html5, name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantlens import config
from vacantlens.functions.text import strip

#: Elements without an end tag.
VOID = "area base br col embed hr img input link meta param source track wbr".split()

_NO_TEXT = r"(?is)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<!doctype[^>]*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
# Quotes count behind an equals sign only; a tag with an open quote ends at the next '>'.
_TAG = r"""(?:</?[A-Za-z](?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+>|</?[A-Za-z][^>]*+>)"""
_PART = rf"((?:{_TAG}|^)(?:[^<]++|<(?!/?[A-Za-z]))*+)"
_ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?"
#: What a browser counts as white space.
_BLANK = r"[\s ﻿\p{Z}]+"
#: Depth of an element that is not open.
_NONE = -1


def _table(names: dict[str, str]) -> Column:
    """A constant map."""
    pairs = "\x01".join(f"{name}\x02{char}" for name, char in names.items())
    return F.str_to_map(F.lit(pairs), F.lit("\x01"), F.lit("\x02"))


def _character(entity: Column) -> Column:
    """The character(s) an entity stands for; an unknown name stays as it is written."""
    common = {f"&{name};": chr(code) for name, code in name2codepoint.items()}
    rare = {f"&{name}": char for name, char in html5.items() if f"&{name}" not in common}
    body = F.rtrim(F.lower(entity), F.lit(";"))
    number = F.when(F.startswith(body, F.lit("&#x")), F.conv(F.substr(body, F.lit(4)), 16, 10)).otherwise(F.substr(body, F.lit(3)))
    code = number.try_cast("long")
    usable = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    safe = F.when(usable, code).otherwise(F.lit(0xFFFD))
    # Numbers 128 to 159 are read as Windows characters.
    windows = {str(n): html.unescape(f"&#{n};") for n in range(128, 160)}
    plain = F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")
    numeric = F.coalesce(F.element_at(_table(windows), safe.cast("string")), plain)
    named = F.coalesce(F.element_at(_table(common), entity), F.element_at(_table(rare), entity), entity)
    return F.when(F.startswith(entity, F.lit("&#")), numeric).otherwise(named)


def decoded(c: Column) -> Column:
    """Text with its entities decoded, each once."""
    found = F.regexp_extract_all(c, F.lit(f"({_ENTITY})"), 1)
    between = F.split(c, _ENTITY, -1)
    joined = F.zip_with(between, found, lambda text, entity: F.concat(text, F.coalesce(_character(entity), F.lit(""))))
    return F.when(F.contains(c, F.lit("&")), F.array_join(joined, "")).otherwise(c)


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_BLANK}|{_BLANK}$", "")


def tag_text(c: Column) -> Column:
    """Text content of a piece of HTML: tags dropped, entities decoded, ends stripped."""
    return _trimmed(strip(decoded(F.regexp_replace(c, r"<[^>]*>", ""))))


def first_tag(c: Column, tag: str) -> Column:
    """Text of the first ``<tag>`` element, or null where there is none or it is empty."""
    found = F.regexp_extract(c, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.nullif(tag_text(found), F.lit(""))


def page_parts(c: Column) -> Column:
    """The page as an array of (kind, name, classes, text): kind 1 opens an element, -1 closes one,
    0 does neither; classes with a blank on both sides; text is what follows the tag."""

    def part(piece: Column) -> Column:
        tag = F.regexp_extract(piece, f"^{_TAG}", 0)
        name = F.lower(F.regexp_extract(tag, r"^</?([A-Za-z][^\s/>]*)", 1))
        inert = name.isin("", *VOID) | F.endswith(tag, F.lit("/>"))
        kind = F.when(inert, 0).when(F.startswith(tag, F.lit("</")), -1).otherwise(1)
        quoted = F.regexp_extract(tag, r"""(?is)\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
        classes = F.regexp_replace(F.regexp_replace(quoted, r"(?is)^\sclass\s*=\s*", ""), "[\"']", "")
        return F.struct(
            kind.alias("kind"), name.alias("name"), F.concat(F.lit(" "), F.regexp_replace(classes, r"\s+", " "), F.lit(" ")).alias("classes"),
            F.substr(piece, F.length(tag) + 1).alias("text"),
        )

    return F.transform(F.regexp_extract_all(F.regexp_replace(c, _NO_TEXT, ""), F.lit(_PART), 1), part)


def _of_class(part: Column, name: str) -> Column:
    return F.contains(part["classes"], F.lit(f" {name} "))


def _raw(parts: Column, start: Column, end: Column) -> Column:
    """Text of the parts ``start`` to before ``end``, counted from 1, as it is written."""
    return F.array_join(F.transform(F.slice(parts, start, end - start), lambda p: p["text"]), "")


def _read(texts: Column) -> Column:
    """Written texts as a browser shows them; empty ones are null."""
    return F.transform(texts, lambda t: F.nullif(_trimmed(strip(decoded(t))), F.lit("")))


def element_span(parts: Column, name: str, of_class: str) -> Column:
    """(at, end): the parts of the first element of that name and class, whatever it holds; at 0 if absent."""
    start = F.struct(*[F.lit(v).cast("int").alias(k) for k, v in {"i": 1, "depth": 0, "at": 0, "end": 0, "base": _NONE}.items()])

    def step(s: Column, p: Column) -> Column:
        depth = F.greatest(s["depth"] + p["kind"], F.lit(0))
        begins = (s["at"] == 0) & (p["kind"] == 1) & (p["name"] == name) & _of_class(p, of_class)
        ends = (s["at"] > 0) & (s["end"] == 0) & (depth <= s["base"])
        return F.struct(
            (s["i"] + 1).alias("i"), depth.alias("depth"), F.when(begins, s["i"]).otherwise(s["at"]).alias("at"),
            F.when(ends, s["i"]).otherwise(s["end"]).alias("end"), F.when(begins, s["depth"]).otherwise(s["base"]).alias("base"),
        )

    return F.aggregate(parts, start, step, lambda s: F.struct(s["at"].alias("at"), F.when(s["end"] == 0, s["i"]).otherwise(s["end"]).alias("end")))


_LABEL = "at int, end int, requirement boolean, depth int"


def label_spans(parts: Column, label: str, requirement: str, value: str) -> Column:
    """(labels, pairs): the label elements of both classes, and each with the first value element among
    the siblings behind it. A label waits for its value until the element that holds it ends."""
    zero = F.lit(0).cast("int")
    none = F.array().cast(f"array<struct<{_LABEL.replace(' int', ':int').replace(' boolean', ':boolean')}>>")
    pairs_none = F.array().cast("array<struct<at:int,end:int,requirement:boolean,value_at:int,value_end:int>>")
    start = F.struct(
        F.lit(1).alias("i"), zero.alias("depth"), zero.alias("label_at"), zero.alias("label_depth"), F.lit(False).alias("requirement"),
        zero.alias("value_at"), zero.alias("value_depth"), none.alias("labels"), none.alias("waiting"), none.alias("served"), pairs_none.alias("pairs"),
    )

    def paired(served: Column, at: Column, end: Column) -> Column:
        return F.transform(
            served,
            lambda x: F.struct(x["at"].alias("at"), x["end"].alias("end"), x["requirement"].alias("requirement"), at.alias("value_at"), end.alias("value_end")),
        )

    def step(s: Column, p: Column) -> Column:
        depth = F.greatest(s["depth"] + p["kind"], F.lit(0))
        opens = p["kind"] == 1
        label_ends = (s["label_at"] > 0) & (p["kind"] == -1) & (depth <= s["label_depth"])
        value_ends = (s["value_at"] > 0) & (p["kind"] == -1) & (depth <= s["value_depth"])
        labels_here = opens & (s["label_at"] == 0) & (p["name"] == "span") & (_of_class(p, label) | _of_class(p, requirement))
        serves = F.filter(s["waiting"], lambda x: x["depth"] == s["depth"])
        value_here = opens & (s["value_at"] == 0) & (F.size(s["waiting"]) > 0) & _of_class(p, value) & (F.size(serves) > 0)
        done = F.array(F.struct(s["label_at"].alias("at"), s["i"].alias("end"), s["requirement"].alias("requirement"), s["label_depth"].alias("depth")))
        waiting = (
            F.when(value_here, F.filter(s["waiting"], lambda x: x["depth"] != s["depth"]))
            .when(label_ends, F.concat(s["waiting"], done))
            .when((p["kind"] == -1) & (F.size(s["waiting"]) > 0), F.filter(s["waiting"], lambda x: x["depth"] <= depth))
            .otherwise(s["waiting"])
        )
        return F.struct(
            (s["i"] + 1).alias("i"),
            depth.alias("depth"),
            F.when(labels_here, s["i"]).when(label_ends, zero).otherwise(s["label_at"]).alias("label_at"),
            F.when(labels_here, s["depth"]).otherwise(s["label_depth"]).alias("label_depth"),
            F.when(labels_here, _of_class(p, requirement)).otherwise(s["requirement"]).alias("requirement"),
            F.when(value_here, s["i"]).when(value_ends, zero).otherwise(s["value_at"]).alias("value_at"),
            F.when(value_here, s["depth"]).otherwise(s["value_depth"]).alias("value_depth"),
            F.when(label_ends, F.concat(s["labels"], done)).otherwise(s["labels"]).alias("labels"),
            waiting.alias("waiting"),
            F.when(value_here, serves).otherwise(s["served"]).alias("served"),
            F.when(value_ends, F.concat(s["pairs"], paired(s["served"], s["value_at"], s["i"]))).otherwise(s["pairs"]).alias("pairs"),
        )

    def finish(s: Column) -> Column:
        left = F.when(s["value_at"] > 0, paired(s["served"], s["value_at"], s["i"])).otherwise(pairs_none)
        return F.struct(s["labels"].alias("labels"), F.concat(s["pairs"], left).alias("pairs"))

    return F.aggregate(parts, start, step, finish)


def labelled(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """``keep`` with _parts, _labels (at, requirement, label) and _pairs (at, requirement, label, from, to),
    the labels that have a value, by place in the page."""
    parts = df.select(*keep, page_parts(F.col(html)).alias("_parts"))
    spans = parts.withColumn(
        "_spans", label_spans(F.col("_parts"), config.PAGE_LABEL_CLASS, config.PAGE_REQUIREMENT_CLASS, config.PAGE_VALUE_CLASS)
    )
    texts = spans.withColumn("_texts", _read(F.transform("_spans.labels", lambda x: _raw(F.col("_parts"), x["at"], x["end"]))))
    named = F.zip_with(
        "_spans.labels",
        "_texts",
        lambda x, t: F.struct(x["at"].alias("at"), x["requirement"].alias("requirement"), F.regexp_replace(t, _BLANK, " ").alias("label")),
    )
    labels = texts.withColumn("_labels", named)
    pair = lambda x: F.struct(
        x["at"].alias("at"),
        x["requirement"].alias("requirement"),
        F.get(F.filter("_labels", lambda y: y["at"] == x["at"]), F.lit(0))["label"].alias("label"),
        x["value_at"].alias("from"),
        x["value_end"].alias("to"),
    )
    return labels.select(*keep, "_parts", "_labels", F.array_sort(F.transform("_spans.pairs", pair)).alias("_pairs"))


def _value(label: str, requirement: bool) -> Column:
    """Written value beside the first label of ``labelled`` rows that contains ``label`` and has a value."""
    words = " ".join(label.split())
    fits = F.filter("_pairs", lambda x: (x["requirement"] == requirement) & F.contains(x["label"], F.lit(words)))
    return F.get(F.transform(F.slice(fits, 1, 1), lambda x: _raw(F.col("_parts"), x["from"], x["to"])), F.lit(0))


def labelled_field(html: Column, label: str, label_class: str, value_class: str) -> Column:
    """Value beside the first label of a page that contains ``label`` and has a value, by classes of any site."""
    parts, words = page_parts(html), " ".join(label.split())
    pairs = label_spans(parts, label_class, label_class, value_class)["pairs"]
    both = F.transform(
        F.array_sort(pairs),
        lambda x: F.struct(_raw(parts, x["at"], x["end"]).alias("label"), _raw(parts, x["value_at"], x["value_end"]).alias("value")),
    )
    named = F.zip_with(_read(F.transform(both, lambda x: x["label"])), _read(F.transform(both, lambda x: x["value"])), lambda n, v: F.struct(n.alias("label"), v.alias("value")))
    return F.get(F.filter(named, lambda x: F.contains(F.regexp_replace(x["label"], _BLANK, " "), F.lit(words))), F.lit(0))["value"]


def posting_id() -> Column:
    """Number after 'Nº' in the first requirement label of ``labelled`` rows that has one."""
    numbers = F.transform(
        F.filter("_labels", lambda x: x["requirement"]), lambda x: F.regexp_extract(x["label"], config.PAGE_ID_PATTERN, 1)
    )
    return F.get(F.filter(numbers, lambda x: x != ""), F.lit(0))


def posting_fields(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """All posting fields of each stored page; absent fields are null."""
    heads = {"job_title": config.PAGE_TITLE_CLASS, "institution": config.PAGE_INSTITUTION_CLASS}
    found = {n: _value(label, False) for n, label in config.PAGE_LABELS.items()}
    found |= {n: _value(label, True) for n, label in config.PAGE_REQUIREMENT_LABELS.items()}
    found |= {n: F.when(F.col(f"_{n}.at") > 0, _raw(F.col("_parts"), F.col(f"_{n}.at"), F.col(f"_{n}.end"))) for n in heads}
    rows = labelled(pages, html, keep).withColumns({f"_{n}": element_span(F.col("_parts"), "span", c) for n, c in heads.items()})
    # All texts go through one expression, each step is computed once per page.
    raw = rows.select(*keep, posting_id().alias("posting_unique_id"), F.array(*found.values()).alias("_raw"))
    read = raw.select(*keep, "posting_unique_id", _read(F.col("_raw")).alias("_read"))
    columns = {n: F.get("_read", F.lit(i)) for i, n in enumerate(found)} | {"posting_unique_id": F.col("posting_unique_id")}
    return read.select(*keep, *[columns[n].alias(n) for n in config.FIELD_ORDER])


def article_fields(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """Title, heading, first paragraph and link count of general web pages."""
    c = F.col(html)
    return pages.select(
        *keep,
        first_tag(c, "title").alias("title"),
        first_tag(c, "h1").alias("heading"),
        first_tag(c, "p").alias("first_paragraph"),
        F.regexp_count(c, F.lit(r"(?i)<a\s[^>]*href")).cast("long").alias("links"),
    )

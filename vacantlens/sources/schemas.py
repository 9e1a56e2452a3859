"""Declared schemas; nothing is inferred, so codes keep their leading zeros."""

from __future__ import annotations

from pyspark.sql import types as T

from vacantlens import config


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RAW_POSTINGS = T.StructType(
    [*strings(*config.FIELD_ORDER).fields, T.StructField("scraped_at", T.TimestampType())]
)
OCCUPATION_CSV = strings(
    "Gran grupo", "Sub grupo principal", "Sub grupo", "Grupo primario", "Descripcion CNO 2015"
)
INSTITUTIONS = strings(*config.INSTITUTION_COLUMNS)
PROGRAMS = T.StructType(
    [
        *strings(*config.PROGRAM_COLUMNS).fields,
        T.StructField("academic_level", T.IntegerType()),
        T.StructField("source_sheet", T.StringType()),
        T.StructField("source_sheet_index", T.IntegerType()),
    ]
)
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

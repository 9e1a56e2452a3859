"""Every column rule against hand-derived values, quirks included."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vacantlens.functions import numeric, parsing, text
from vacantlens.operators.enrich import contract_columns, label_codes


def apply(spark, rule, values, type_="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {type_}")
    return [r[0] for r in rows.select(rule(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


CASES = [
    (text.clean_text, [None, "", "   ", ' "hola" ', "¿Qué? ¡sí!", "- uno\n  • dos\n.tres", "a  b", "--", "'x", "a - b"],
     [None, None, "NO INFO", "hola", "Qué? ¡sí!", "uno dos tres", "a b", "NO INFO", "x", "a - b"]),
    (text.clean_free_text, [None, "", " • ", "NO INFO", " a  b "], [None, None, None, None, "a b"]),
    (text.clean_listing, ["a,b;c ;d", " , a", "a,", "a , , b", "x ; ,y", None, "-"],
     ["a, b; c; d", ", a", "a,", "a, , b", "x; , y", None, None]),
    (text.clean_title,
     ["TECNICO INFORMATICO II", "UN/A ASISTENTE (A)", "(1) ANALISTA/A I", "1.2. JEFE (O) 02", "ESPECIALISTA LEY 30057",
      "unas 12", "PROFESIONAL I – REGISTRADOR", "X/ADMIN", "", None, "CHOFER Y/O GUARDIA", "UNA\tSECRETARIA 3."],
     ["TECNICO NFORMATICO", "ASISTENTE", "ANALISTA", "JEFE", "ESPECIALISTA LEY", None, "PROFESIONAL REGISTRADOR", "X DMIN",
      None, None, "CHOFER Y GUARDIA", "SECRETARIA"]),
    (text.normalize_text, ["Técnico, superior.", None, "  a--b  ", "x_y"], ["TÉCNICO SUPERIOR", None, "A B", "X_Y"]),
    (text.blank_special, ["no aplica", "NO REQUIERE", "No Info", None, "x"], ["", "", "", "", "x"]),
    (parsing.parse_posting_id, ["735144", " 738213B", "S/N", None, "12-34"], [735144, 738213, None, None, 1234]),
    (parsing.parse_money, ["S/. 4,000.00", " S/. 12.5 ", "S/. abc", None, "1e3", "100d", "1_000", ""],
     [4000.0, 12.5, None, None, 1000.0, None, None, None]),
    (parsing.parse_count, [" 5 ", "5.0", "+7", "x", None], [5, None, 7, None, None]),
    (parsing.parse_date, ["05/12/2025", "5/1/2025", " 31/12/2024 ", "31/02/2025", "2025-01-01", None],
     [datetime.date(2025, 12, 5), datetime.date(2025, 1, 5), datetime.date(2024, 12, 31), None, None, None]),
    (parsing.classify_contract,
     ["D.LEG 1057 - DETERMINADO (NECESIDAD TRANSITORIA)-005", "D.LEG 1057 - DETERMINADO (SUPLENCIA)", "D.LEG 1057 - INDETERMINADO-9",
      " 7281", "276", "DOCENTES UNIVERSITARIOS", "LEY 30220 x", "LEY 30057", "PRACTICAS", None],
     ["D.LEG 1057 DETERMINADO NECESIDAD TRANSITORIA", "D.LEG 1057 DETERMINADO SUPLENCIA", "D.LEG 1057 INDETERMINADO",
      "D.LEG 728", "D.LEG 276", "DOCENTES UNIVERSITARIOS LEY 30220", "DOCENTES UNIVERSITARIOS LEY 30220", "LEY 30057", None, None]),
    (parsing.academic_level_digit, ["001011016", "001011019", "x2", "nivel", None], [6, 9, None, None, None]),
    (label_codes, ["E", "R", "M", "Z", None], ["Nacional", "Regional", "Municipal", None, None]),
]


@pytest.mark.parametrize("rule,given_values,expected", CASES, ids=[c[0].__name__ for c in CASES])
def test_rule(spark, rule, given_values, expected):
    assert apply(spark, rule, given_values) == expected


def test_title_flags_mend_the_boundaries(spark):
    mended = lambda c: text.clean_title(c, roman_word_boundary=True, gender_word_boundary=True)
    assert apply(spark, mended, ["TECNICO INFORMATICO II", "X/ADMIN", "JEFE/A I"]) == ["TECNICO INFORMATICO", "X/ADMIN", "JEFE"]


@pytest.mark.parametrize(
    "value,expected",
    [
        ("EXPERIENCIA GENERAL: TRES (03) AÑOS EXPERIENCIA ESPECÍFICA: DOS AÑOS EN SECTOR PÚBLICO", (None, None, 1, 0)),
        ("EXPERIENCIA LABORAL GENERAL DE 01 AÑO EN EL SECTOR PÚBLICO Y/O PRIVADO", (1, None, 1, 1)),
        ("SIN EXPERIENCIA", (None, None, 0, 0)),
        ("SIN EXPERIENCIA EN SECTOR PRIVADO", (None, None, 0, 0)),
        ("EXPERIENCIA MINIMA DE 06 MESES EN EL SECTOR PUBLICO Y/O PRIVADO", (None, None, 1, 1)),
        ("experiencia general: 4 años; experiencia específica de 2 años", (4, 2, 0, 0)),
        ("Experiencia general:\n4 años", (4, None, 0, 0)),
        ("Experiencia general: x\n4 años", (None, None, 0, 0)),
        (None, (None, None, 0, 0)),
    ],
)
def test_experience(spark, value, expected):
    row = spark.createDataFrame([(value,)], "x string").select(
        *[c.alias(n) for n, c in parsing.parse_experience(F.col("x")).items()]
    ).first()
    assert tuple(row) == expected


def test_experience_total_years(spark):
    df = spark.createDataFrame([("EXPERIENCIA MINIMA DE 3 AÑOS",)], "x string")
    plain, total = (parsing.parse_experience(F.col("x"), use_total=t)["experience_general_years"] for t in (False, True))
    assert tuple(df.select(plain, total).first()) == (None, 3)


@pytest.mark.parametrize(
    "value,levels,name,flags",
    [
        ("TITULO PROFESIONAL DE ABOGADO COLEGIADO Y HABILITADO", [6], "Profesional Universitario", (1, 0, 1, 1, 0)),
        ("BACHILLER EN ADMINISTRACION, ECONOMIA O CONTABILIDAD", [6], "Profesional Universitario", (0, 0, 0, 0, 1)),
        ("TITULO TECNICO EN SECRETARIADO EJECUTIVO", [3, 4, 5], "Técnico", (0, 0, 0, 0, 0)),
        ("SECUNDARIA COMPLETA", [], "Secundaria", (0, 0, 0, 0, 0)),
        ("EGRESADO EN DERECHO O AFINES", [6], "Profesional Universitario", (0, 1, 0, 0, 1)),
        ("TÍTULO PROFESIONAL DE ABOGADO COLEGIADO Y HABILITADO.", [], None, (0, 0, 1, 1, 0)),
        ("tecnico o maestria", [3, 4, 5], "Técnico", (0, 0, 0, 0, 1)),
        (None, [], None, (0, 0, 0, 0, 0)),
    ],
)
def test_academic(spark, value, levels, name, flags):
    row = spark.createDataFrame([(value,)], "x string").select(
        *[c.alias(n) for n, c in parsing.parse_academic(F.col("x")).items()]
    ).first()
    assert (row.search_levels, row.level_name, tuple(row)[2:]) == (levels, name, flags)


def test_academic_folding_finds_accented_levels(spark):
    df = spark.createDataFrame([("TÍTULO PROFESIONAL",)], "x string")
    assert df.select(parsing.parse_academic(F.col("x"), fold=True)["search_levels"]).first()[0] == [6]


def test_contract_classes(spark):
    df = spark.createDataFrame([("D.LEG 1057 DETERMINADO SUPLENCIA",), ("UNKNOWN TYPE",), (None,)], "x string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in contract_columns(F.col("x")).items()]).collect()]
    assert got == [("D.LEG 1057", "TEMPORARY"), (None, None), (None, None)]


def test_round_even_is_half_to_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (2.5,)], "x double")
    assert [r[0] for r in df.select(numeric.round_even(F.col("x"), 2)).collect()] == [0.12, 0.38, 2.5]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" \t\n  ab¿¡\"'-•*.,;ñÉ12", max_size=30), min_size=1, max_size=20))
def test_clean_text_keeps_words_and_trims_marks(spark, values):
    for value, cleaned in zip(values, apply(spark, text.clean_text, values)):
        assert (cleaned is None) == (not value)
        if cleaned is None:
            continue
        letters = [c for c in value if c.isalnum()]
        if cleaned == "NO INFO" and not letters:
            continue
        assert [c for c in cleaned if c.isalnum()] == letters
        assert cleaned and cleaned == " ".join(cleaned.split())
        marks = set(value)
        if not marks & set("\"'¿¡"):
            assert cleaned[0] not in "-–•*."
        if not marks & set("\"'-–•*."):
            assert cleaned[0] not in "¿¡" and cleaned[-1] not in "¿¡"
        if not marks & set("\"'¿¡-–•*."):
            assert cleaned == " ".join(value.split())

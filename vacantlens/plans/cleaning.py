"""Raw postings rendered from the tables, cleaned, routed, parsed and classified."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantlens import config
from vacantlens.functions.parsing import classify_contract, parse_academic, parse_experience
from vacantlens.functions.text import WS
from vacantlens.operators import clean
from vacantlens.operators.enrich import contract_columns
from vacantlens.sources.tables import table, text_table

# What a document without an order of its number, or an order without its customer, is rendered with.
DEFAULTS = {
    "o_custkey": "0",
    "o_orderstatus": "'F'",
    "o_totalprice": "CAST(1000 AS DOUBLE)",
    "o_orderdate": "CAST('1995-01-31 00:00:00' AS TIMESTAMP)",
    "o_orderpriority": "'3-MEDIUM'",
    "c_name": "'Customer'",
    "c_mktsegment": "'GENERAL'",
}
_GIVEN = ", ".join(f"coalesce({name}, {value}) AS {name}" for name, value in DEFAULTS.items())

# A document with the order and customer of the same number, rendered as a raw posting. Status
# and priority decide which field is damaged, so that every rule and every failure occurs.
# The text is plain SQL for both engines but for the two formats.
RAW_FIELDS = {
    "posting_unique_id": """CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'S/N'
        WHEN o_orderpriority = '1-URGENT' THEN concat(' ', CAST(doc_id AS STRING), 'B ')
        WHEN o_orderpriority = '2-HIGH' THEN CAST(CAST(floor(doc_id / 4.0) * 4 AS BIGINT) AS STRING)
        ELSE CAST(doc_id AS STRING) END""",
    "institution": """CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN ' - '
        WHEN o_orderstatus = 'F' THEN concat('  "', c_name, '" ')
        WHEN o_orderstatus = 'O' THEN concat('¿', c_name, '¡ ') ELSE concat('•  ', c_name, '  S.A.') END""",
    "job_title": """CASE WHEN o_orderpriority = '1-URGENT' THEN concat('UN/A ', c_mktsegment, ' INFORMATICO II')
        WHEN o_orderpriority = '2-HIGH' THEN concat('(1) ', c_mktsegment, '/A III – ', lang)
        WHEN o_orderpriority = '3-MEDIUM' THEN concat('1.2. ', c_mktsegment, ' (O) 02')
        WHEN o_orderpriority = '4-NOT SPECIFIED' THEN concat(c_mktsegment, ' LEY 30057 ', source)
        ELSE concat('unas ', CAST(o_custkey AS STRING)) END""",
    "posting_start_date": """CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O' THEN '31/02/2025'
        WHEN o_orderstatus = 'F' THEN {dmy} WHEN o_orderstatus = 'P' THEN concat(' ', {dmy}, ' ')
        ELSE concat(day(o_orderdate), '/', month(o_orderdate), '/', year(o_orderdate)) END""",
    "posting_end_date": "CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN NULL ELSE {dmy} END",
    "monthly_salary": """CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN 'S/. abc'
        ELSE concat('S/. ', {money}) END""",
    "number_of_vacancies": """CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN '5.0'
        ELSE concat(' ', CAST(day(o_orderdate) AS STRING)) END""",
    "contract_type_raw": """CASE o_orderpriority WHEN '1-URGENT' THEN 'D.LEG 1057 - DETERMINADO (NECESIDAD TRANSITORIA)-005'
        WHEN '2-HIGH' THEN 'D.LEG 1057 - INDETERMINADO-9'
        WHEN '3-MEDIUM' THEN CASE o_orderstatus WHEN 'F' THEN 'D.LEG 1057 - DETERMINADO (SUPLENCIA) 7' ELSE ' 728-A' END
        WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'F' THEN 'LEY 30057 X' WHEN 'O' THEN 'DOCENTES UNIVERSITARIOS 1' ELSE '276' END
        ELSE 'PRACTICAS' END""",
    "experience_requirements": "concat('• ', text)",
    "academic_profile": "concat('\"', text, '\"')",
    "specialization": """CASE WHEN lang = 'de' THEN replace(text, ', ', ' ;')
        ELSE concat('- ', replace(text, chr(10), concat(chr(10), ' - '))) END""",
    "knowledge": "replace(text, ',', ' ,  ')",
    "competencies": "CASE WHEN lang = 'es' THEN NULL WHEN lang = 'fr' THEN '   ' ELSE text END",
}
_SPARK = {"dmy": "date_format(o_orderdate, 'dd/MM/yyyy')", "money": "format_number(o_totalprice, 2)"}
_DUCKDB = {"dmy": "strftime(o_orderdate, '%d/%m/%Y')", "money": "format('{:,.2f}', o_totalprice)"}


def _expression(name: str, dialect: dict[str, str]) -> str:
    out = RAW_FIELDS[name]
    for key, value in dialect.items():
        out = out.replace("{" + key + "}", value)
    return out


def posting_sources(spark: SparkSession, root: str) -> DataFrame:
    """Every document with the order and customer of its number, or the default values."""
    documents = text_table(spark, root, "documents")
    orders = table(spark, root, "orders")
    customer = table(spark, root, "customer").select("c_custkey", "c_name", "c_mktsegment")
    # Orders meet their customers first: the texts are shuffled once.
    numbered = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    joined = documents.join(numbered, F.col("doc_id") == F.col("o_orderkey"), "left")
    return joined.withColumns({name: F.expr(f"coalesce({name}, {value})") for name, value in DEFAULTS.items()})


def raw_postings(spark: SparkSession, root: str) -> DataFrame:
    fields = [F.expr(_expression(n, _SPARK)).alias(n) for n in config.FIELD_ORDER]
    return posting_sources(spark, root).select(*fields, F.col("o_orderdate").alias("scraped_at"), "doc_id")


SOURCES_SQL = (
    f"SELECT doc_id, text, lang, source, {_GIVEN} FROM documents LEFT JOIN orders ON o_orderkey = doc_id "
    "LEFT JOIN customer ON c_custkey = o_custkey"
)
RAW_SQL = (
    "SELECT "
    + ", ".join(f"{_expression(n, _DUCKDB)} AS {n}" for n in config.FIELD_ORDER)
    + f", o_orderdate AS scraped_at, doc_id FROM ({SOURCES_SQL})"
)


def known_postings(spark: SparkSession, root: str) -> DataFrame:
    """Ids stored by earlier runs: the labelled documents."""
    return table(spark, root, "labels").select(F.col("doc_id").alias("posting_unique_id"))


def split_postings(spark: SparkSession, root: str) -> DataFrame:
    return clean.clean_split(raw_postings(spark, root), known_postings(spark, root), ["scraped_at", "doc_id"])


def clean_split(spark: SparkSession, root: str) -> DataFrame:
    out = split_postings(spark, root).drop("scraped_at")
    return out.withColumn("failed_fields", F.concat_ws(", ", "failed_fields"))


def quarantine(spark: SparkSession, root: str) -> DataFrame:
    return clean.quarantine_rows(split_postings(spark, root)).select("posting_unique_id", "failed_fields", "reviewed", "notes")


def complete_postings(spark: SparkSession, root: str) -> DataFrame:
    return clean.complete_rows(split_postings(spark, root)).drop("scraped_at", "doc_id")


def failed_rows(spark: SparkSession, root: str) -> DataFrame:
    return clean.failed_rows(raw_postings(spark, root)).select("doc_id", "posting_unique_id")


def clean_failures_by_field(spark: SparkSession, root: str) -> DataFrame:
    return clean.failures_by_field(split_postings(spark, root))


def outcome_stats(spark: SparkSession, root: str) -> DataFrame:
    return clean.run_statistics(raw_postings(spark, root), split_postings(spark, root))


def status_counts(spark: SparkSession, root: str) -> DataFrame:
    return clean.status_counts(split_postings(spark, root))


def classified_contracts(spark: SparkSession, root: str) -> DataFrame:
    raw = raw_postings(spark, root).select("doc_id", classify_contract(F.col("contract_type_raw")).alias("contract_type"))
    return raw.withColumns(contract_columns(F.col("contract_type")))


# A requirement phrase by language in front of the whole text.
EXPERIENCE_TEXT = """CASE lang
    WHEN 'en' THEN concat('Experiencia general: tres (', CAST(n_chars AS STRING), ') años. Experiencia específica: dos años en sector público. ', text)
    WHEN 'de' THEN concat('experiencia laboral general de ', CAST(n_chars AS STRING), ' años en el sector público y/o privado. ', text)
    WHEN 'fr' THEN concat('Exp general 2 años, exp ESPECIFICA: ', CAST(n_chars AS STRING), 'AÑO ', text)
    ELSE concat('Sin experiencia en sector privado. ', text) END"""
ACADEMIC_TEXT = """CASE lang
    WHEN 'en' THEN concat('Titulo profesional de abogado colegiado y habilitado ', text)
    WHEN 'de' THEN concat(text, ' Bachiller o egresado en administracion o afines')
    WHEN 'fr' THEN concat('TÍTULO TÉCNICO O PROFESIONAL TECNICO Y/O AUXILIAR ', text)
    ELSE concat(text, ' Secundaria completa') END"""


def parsed_experience(spark: SparkSession, root: str) -> DataFrame:
    texts = text_table(spark, root, "documents").select("doc_id", F.expr(EXPERIENCE_TEXT).alias("t"))
    return texts.select("doc_id", *[c.alias(n) for n, c in parse_experience(F.col("t")).items()])


def parsed_academic(spark: SparkSession, root: str) -> DataFrame:
    texts = text_table(spark, root, "documents").select("doc_id", F.expr(ACADEMIC_TEXT).alias("t"))
    columns = parse_academic(F.col("t"))
    columns["search_levels"] = F.array_join(columns["search_levels"].cast("array<string>"), ",")
    return texts.select("doc_id", *[c.alias(n) for n, c in columns.items()])


QUERIES = {
    "clean_split": clean_split,
    "complete_postings": complete_postings,
    "quarantine": quarantine,
    "failed_rows": failed_rows,
    "clean_failures_by_field": clean_failures_by_field,
    "outcome_stats": outcome_stats,
    "status_counts": status_counts,
    "classify_contract": classified_contracts,
    "parse_experience": parsed_experience,
    "parse_academic": parsed_academic,
}


# --- SQL checks -------------------------------------------------------------------------


def _sub(x: str, pattern: str, to: str = "") -> str:
    pattern = pattern.replace("'", "''")
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def _strip(x: str) -> str:
    return _sub(x, f"^[{WS}]+|[{WS}]+$")


def _squeeze(x: str) -> str:
    return f"trim({_sub(x, f'[{WS}]+', ' ')})"


def _clean(x: str) -> str:
    out = _sub(_strip(x), "^[\"']+|[\"']+$")
    out = _sub(out, f"^[¿¡{WS}]+|[¿¡{WS}]+$")
    out = _squeeze(_sub(out, rf"(?m)^[{WS}\-–•*.]+"))
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL ELSE coalesce(nullif({out}, ''), 'NO INFO') END"


def _free(x: str) -> str:
    return f"nullif({_clean(x)}, 'NO INFO')"


def _listing(x: str) -> str:
    return _squeeze(_sub(_sub(_free(x), f"[{WS}]*,[{WS}]*", ", "), f"[{WS}]*;[{WS}]*", "; "))


def _title(x: str) -> str:
    out = _sub(x, rf"(?i)^(UN/A|UNA|UNAS|UNOS|UN)[{WS}]+")
    out = _sub(out, rf"^[\(\d\).:{WS}]+")
    out = _sub(out, rf"[{WS}]+\(?\d+\)?[{WS}.]*", " ")
    out = _sub(out, rf"[{WS}.]+\(?\d+\)?[{WS}]*$")
    out = _sub(out, rf"[{WS}]*[(/]([AO])[)][{WS}]*", " ")
    out = _squeeze(_sub(out, rf"[{WS}]*/[AO][{WS}]*", " "))
    out = _squeeze(_sub(out, rf"(?i)[{WS}]+(CM|CD|XC|XL|IX|IV|[IVX])+[{WS}–\-]*", " "))
    return _free(f"({out})")


def _id(x: str) -> str:
    return f"TRY_CAST(regexp_replace({x}, '[^0-9]', '', 'g') AS BIGINT)"


def _date(x: str) -> str:
    s = _strip(x)
    return rf"CASE WHEN regexp_matches({s}, '^\d{{1,2}}/\d{{1,2}}/\d{{4}}$') THEN CAST(try_strptime({s}, '%d/%m/%Y') AS DATE) END"


def _money(x: str) -> str:
    s = f"replace({_strip(f'''replace({x}, 'S/. ', '')''')}, ',', '')"
    return rf"CASE WHEN regexp_matches({s}, '^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$') THEN TRY_CAST({s} AS DOUBLE) END"


def _count(x: str) -> str:
    s = _strip(x)
    return rf"CASE WHEN regexp_matches({s}, '^[+-]?\d+$') THEN TRY_CAST({s} AS INT) END"


def contract_sql(x: str) -> str:
    s = f"trim({x})"
    return f"""CASE WHEN starts_with({s}, 'D.LEG 1057 - DETERMINADO (NECESIDAD TRANSITORIA)') THEN 'D.LEG 1057 DETERMINADO NECESIDAD TRANSITORIA'
      WHEN starts_with({s}, 'D.LEG 1057 - DETERMINADO (SUPLENCIA)') THEN 'D.LEG 1057 DETERMINADO SUPLENCIA'
      WHEN starts_with({s}, 'D.LEG 1057 - INDETERMINADO') THEN 'D.LEG 1057 INDETERMINADO'
      WHEN starts_with({s}, '728') THEN 'D.LEG 728' WHEN starts_with({s}, '276') THEN 'D.LEG 276'
      WHEN starts_with({s}, 'DOCENTES UNIVERSITARIOS') OR starts_with({s}, 'LEY 30220') THEN 'DOCENTES UNIVERSITARIOS LEY 30220'
      WHEN starts_with({s}, 'LEY 30057') THEN 'LEY 30057' END"""


_RULES = {
    "job_title": _title("job_title"),
    "institution": _clean("institution"),
    "posting_start_date": _date("posting_start_date"),
    "posting_end_date": _date("posting_end_date"),
    "salary_amount": _money("monthly_salary"),
    "number_of_vacancies": _count("number_of_vacancies"),
    "contract_type": contract_sql("contract_type_raw"),
    "experience_requirements": _free("experience_requirements"),
    "academic_profile": _free("academic_profile"),
    "specialization": _listing("specialization"),
    "knowledge": _listing("knowledge"),
    "competencies": _listing("competencies"),
}
_FIELDS = ["posting_unique_id", *_RULES]
_MISSING = ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in _FIELDS)
# All rows, cleaned; kept rows; and their outcome.
CLEANED_SQL = f"""
  raw AS ({RAW_SQL}),
  ids AS (SELECT *, {_id('posting_unique_id')} AS pid FROM raw),
  fresh AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY scraped_at, doc_id) AS copy FROM ids
            WHERE pid IS NOT NULL AND pid NOT IN (SELECT doc_id FROM labels)),
  cleaned AS (SELECT pid AS posting_unique_id, {', '.join(f'{e} AS {n}' for n, e in _RULES.items())}, doc_id FROM fresh WHERE copy = 1),
  routed AS (SELECT *, concat_ws(', ', {_MISSING}) AS failed_fields FROM cleaned),
  split AS (SELECT *, CASE WHEN failed_fields = '' THEN 'complete' ELSE 'incomplete' END AS outcome FROM routed)"""


def _level_sql(value) -> str:
    out = "CASE"
    for keyword, levels, name, thesis in config.ACADEMIC_LEVELS:
        out += f" WHEN contains(u, '{keyword}') THEN {value(levels, name, thesis)}"
    return out


def _any_sql(keywords) -> str:
    return "(" + " OR ".join(f"contains(u, '{k}')" for k in keywords) + ")"


def _years_sql(patterns) -> str:
    return "TRY_CAST(coalesce(" + ", ".join(f"nullif(regexp_extract(u, '{p}', 1), '')" for p in patterns) + ") AS INT)"


_NONE_NEEDED = _any_sql(config.NO_EXPERIENCE_KEYWORDS)


def experience_sql() -> str:
    """Columns of the experience parser over a relation with the upper-case text ``u``."""
    return f"""{_years_sql(config.GENERAL_YEARS_PATTERNS)} AS experience_general_years,
             {_years_sql(config.SPECIFIC_YEARS_PATTERNS)} AS experience_specific_years,
             CAST(NOT {_NONE_NEEDED} AND {_any_sql(config.PUBLIC_SECTOR_KEYWORDS)} AS INT) AS sector_public_required,
             CAST(NOT {_NONE_NEEDED} AND {_any_sql(config.PRIVATE_SECTOR_KEYWORDS)} AS INT) AS sector_private_required"""


def academic_flags_sql() -> str:
    return f"""{_level_sql(lambda levels, name, thesis: thesis)} ELSE 0 END AS thesis_required,
             CAST({_any_sql(config.RELATED_FIELDS_KEYWORDS)} AS INT) AS accepts_related_fields,
             CAST({_any_sql(config.COLEGIADO_KEYWORDS)} AS INT) AS requires_colegiado,
             CAST({_any_sql(config.HABILITADO_KEYWORDS)} AS INT) AS requires_habilitado"""


def contract_classes_sql() -> str:
    return """CASE WHEN contract_type LIKE 'D.LEG 1057%' THEN 'D.LEG 1057' WHEN contract_type LIKE 'DOCENTES%' THEN 'LEY 30220'
                     ELSE contract_type END AS contract_regime,
             CASE WHEN contract_type LIKE '%1057 DETERMINADO%' THEN 'TEMPORARY' WHEN contract_type IS NOT NULL THEN 'PERMANENT' END
               AS contract_temporal_nature"""


ORACLES = {
    "clean_split": f"WITH {CLEANED_SQL} SELECT * FROM split",
    "complete_postings": f"WITH {CLEANED_SQL} SELECT * EXCLUDE (failed_fields, outcome, doc_id) FROM split WHERE outcome = 'complete'",
    "quarantine": f"""WITH {CLEANED_SQL}
      SELECT posting_unique_id, failed_fields, false AS reviewed, CAST(NULL AS VARCHAR) AS notes FROM split WHERE outcome = 'incomplete'""",
    "failed_rows": f"""
      SELECT doc_id, posting_unique_id FROM ({RAW_SQL}) WHERE NOT regexp_matches(posting_unique_id, '[0-9]')""",
    "clean_failures_by_field": f"""WITH {CLEANED_SQL}
      SELECT field, count(*) AS rows
      FROM (SELECT unnest(string_split(failed_fields, ', ')) AS field FROM split WHERE outcome <> 'complete') GROUP BY field""",
    "outcome_stats": f"""WITH {CLEANED_SQL},
      s AS (SELECT (SELECT count(*) FROM raw) AS e, count(*) FILTER (outcome = 'complete') AS c,
                   count(*) FILTER (outcome = 'incomplete') AS i, (SELECT count(*) FROM ids WHERE pid IS NULL) AS f FROM split)
      SELECT unnest(['encountered', 'complete', 'incomplete', 'failed', 'duplicate', 'new_rows']) AS statistic,
             unnest([e, c, i, f, e - c - i - f, c + i]) AS rows FROM s""",
    "status_counts": f"""WITH {CLEANED_SQL}
      SELECT outcome AS status, count(*) AS rows FROM split GROUP BY outcome""",
    "classify_contract": f"""
      WITH c AS (SELECT doc_id, {contract_sql('contract_type_raw')} AS contract_type FROM ({RAW_SQL}))
      SELECT *, {contract_classes_sql()} FROM c""",
    "parse_experience": f"""
      WITH t AS (SELECT doc_id, upper({EXPERIENCE_TEXT}) AS u FROM documents)
      SELECT doc_id, {experience_sql()} FROM t""",
    "parse_academic": f"""
      WITH t AS (SELECT doc_id, upper({ACADEMIC_TEXT}) AS u FROM documents)
      SELECT doc_id, {_level_sql(lambda levels, name, thesis: "'" + ','.join(map(str, levels)) + "'")} ELSE '' END AS search_levels,
             {_level_sql(lambda levels, name, thesis: f"'{name}'")} END AS level_name,
             {academic_flags_sql()},
             CAST({_any_sql(config.MULTIPLE_OPTIONS_KEYWORDS)} AS INT) AS multiple_options_allowed FROM t""",
}

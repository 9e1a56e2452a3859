"""Reference catalogs: hierarchy levels, roll-up, sheets, CSV, stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantlens.functions.text import WS
from vacantlens.operators import hierarchy
from vacantlens.plans.cleaning import SOURCES_SQL, posting_sources
from vacantlens.session import scratch_path
from vacantlens.sources import pages, sinks, tables
from vacantlens.sources.schemas import strings
from vacantlens.sources.tables import table, text_table


def catalog_distinct(spark: SparkSession, root: str) -> DataFrame:
    """Suppliers with their places out of the line items they appear in."""
    line = table(spark, root, "lineitem").select("l_suppkey")
    supplier, nation, region = (table(spark, root, n) for n in ("supplier", "nation", "region"))
    facts = (
        line.join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return hierarchy.catalog_distinct(facts, ["s_name", "n_name", "r_name"], "s_name")


def ordered_catalog(spark: SparkSession, root: str) -> DataFrame:
    return tables.catalog(table(spark, root, "part"), ["p_partkey", "p_name", "p_brand"], "p_name", ["p_partkey"])


def coded_orders(spark: SparkSession, root: str) -> DataFrame:
    """A four-character code per order: region, nation, segment and status, one each."""
    orders, customer, nation = (table(spark, root, n) for n in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    one = F.col("n_regionkey").cast("string")
    two = F.concat(one, F.char(F.col("n_nationkey") + 65))
    three = F.concat(two, F.left("c_mktsegment", F.lit(1)))
    return joined.select(
        one.alias("code_1"), two.alias("code_2"), three.alias("code_3"),
        F.concat(three, F.left("o_orderstatus", F.lit(1))).alias("code_4"),
        F.col("n_name"), F.col("c_mktsegment"), F.col("o_orderstatus"),
    )


def _levels(spark: SparkSession, root: str) -> list[DataFrame]:
    # Reduced to distinct entries once; the four levels share that shuffle.
    coded = coded_orders(spark, root).distinct().withColumn("label_1", F.concat(F.lit("region "), "code_1"))
    labels = ["label_1", "n_name", "c_mktsegment", "o_orderstatus"]
    return [hierarchy.hierarchy_level(coded, f"code_{i}", label, i) for i, label in enumerate(labels, 1)]


def hierarchy_levels(spark: SparkSession, root: str) -> DataFrame:
    parts = [df.withColumn("level", F.lit(i)) for i, df in enumerate(_levels(spark, root), 1)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hierarchy_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Orders per code with all ancestors, aggregated before the joins."""
    counts = coded_orders(spark, root).groupBy("code_4").agg(F.count(F.lit(1)).alias("orders"))
    return counts.join(hierarchy.roll_up(_levels(spark, root)), "code_4", "left")


def sparse_parts(spark: SparkSession, root: str) -> DataFrame:
    """Parts as program rows of a sheet with sparse hierarchy cells: a brand is named only on
    small parts, and large parts are rows without a program."""
    return table(spark, root, "part").select(
        F.col("p_partkey").alias("row_number"),
        F.col("p_type").alias("source_sheet"),
        F.when(F.col("p_size") <= 10, F.col("p_brand")).alias("campo_amplio_codigo"),
        F.when(F.col("p_size") <= 5, F.col("p_name")).alias("campo_especifico_codigo"),
        F.when(F.col("p_size") < 45, F.concat(F.lit("P"), F.col("p_partkey").cast("string"))).alias("programa_codigo"),
        F.concat(F.lit("00"), F.col("p_size").cast("string")).alias("codigo_campo_programa_nivel"),
    )


HIERARCHY = ["campo_amplio_codigo", "campo_especifico_codigo"]


def forward_fill_hierarchy(spark: SparkSession, root: str) -> DataFrame:
    return hierarchy.forward_fill(sparse_parts(spark, root), HIERARCHY, "source_sheet", "row_number", block_rows=512)


def program_catalog(spark: SparkSession, root: str) -> DataFrame:
    """The sheets written as CSV files, read back as one table, filled and filtered."""
    rows = sparse_parts(spark, root)
    names = [*HIERARCHY, "programa_codigo", "codigo_campo_programa_nivel"]
    base = scratch_path(spark, "sheets")
    # One folder per sheet in one write.
    rows.select("row_number", *names, "source_sheet").write.partitionBy("source_sheet").option("header", False).csv(base)
    # A workbook has few sheets.
    sheet_names = sorted(row[0] for row in rows.select("source_sheet").distinct().collect())
    sheets = [(f"{base}/source_sheet={name}", name, i) for i, name in enumerate(sheet_names, 2)]
    stacked = tables.read_sheets(spark, sheets, names)
    programs = hierarchy.program_rows(
        stacked, "source_sheet", "row_number", HIERARCHY, "programa_codigo", "codigo_campo_programa_nivel"
    )
    return programs.select("source_sheet", "source_sheet_index", *names, "academic_level")


def level_counts(spark: SparkSession, root: str) -> DataFrame:
    programs = hierarchy.program_rows(
        sparse_parts(spark, root), "source_sheet", "row_number", HIERARCHY, "programa_codigo", "codigo_campo_programa_nivel"
    )
    return hierarchy.level_counts(programs)


def csv_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Parts with zero-padded codes through CSV and back; the codes stay text."""
    path = scratch_path(spark, "csv")
    parts = table(spark, root, "part").select(
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("codigo"), "p_name", "p_brand"
    )
    sinks.export_csv(parts, path)
    back = tables.read_csv(spark, path, strings("codigo", "p_name", "p_brand"), line_breaks=False)
    return back.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("parts"), F.min("codigo").alias("first_code"), F.max("codigo").alias("last_code"),
        F.countDistinct("p_name").alias("names"),
    )


def page_fields(spark: SparkSession, root: str) -> DataFrame:
    return pages.article_fields(text_table(spark, root, "pages"), "html", ["page_id"])


def rendered_pages(spark: SparkSession, root: str) -> DataFrame:
    """A detail page per document, with its order's fields beside their labels."""

    def item(label_class: str, label: str, value: F.Column) -> F.Column:
        head = f'<li><span class="x {label_class}">{label}</span> <b>:</b>\n<span class="detalle-sp">'
        safe = F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        return F.concat(F.lit(head), safe, F.lit("</span></li>"))

    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    html = F.concat(
        F.lit('<html><body><span class="sp-aviso0"> '), F.col("c_mktsegment"), F.lit(' </span><span class="sp-aviso">'),
        F.col("c_name"), F.lit('</span><ul><li><span class="sub-titulo-2">Nº '), F.col("doc_id").cast("string"), F.lit("</span></li>"),
        item("sub-titulo", "CANTIDAD DE\n VACANTES:", F.dayofmonth("o_orderdate").cast("string")),
        item("sub-titulo", "REMUNERACIÓN:", F.concat(F.lit("S/. "), F.format_number("o_totalprice", 2))),
        item("sub-titulo", "FECHA INICIO DE PUBLICACIÓN:", day),
        item("sub-titulo-2", "EXPERIENCIA:", F.col("text")),
        item("sub-titulo-2", "CONOCIMIENTO:", F.concat(F.lit("  "), F.col("lang"), F.lit(" & more"))),
        F.lit('<li><span class="sub-titulo-2">COMPETENCIAS</span></li></ul></body></html>'),
    )
    return posting_sources(spark, root).select("doc_id", html.alias("html"))


def posting_page_fields(spark: SparkSession, root: str) -> DataFrame:
    return pages.posting_fields(rendered_pages(spark, root), "html", ["doc_id"])


QUERIES = {
    "catalog_distinct": catalog_distinct,
    "ordered_catalog": ordered_catalog,
    "hierarchy_levels": hierarchy_levels,
    "hierarchy_rollup": hierarchy_rollup,
    "forward_fill_hierarchy": forward_fill_hierarchy,
    "program_catalog": program_catalog,
    "level_counts": level_counts,
    "csv_roundtrip": csv_roundtrip,
    "page_fields": page_fields,
    "posting_page_fields": posting_page_fields,
}

_CODED = """
  SELECT CAST(n_regionkey AS VARCHAR) AS code_1, n_regionkey || chr(65 + n_nationkey) AS code_2,
         n_regionkey || chr(65 + n_nationkey) || c_mktsegment[1] AS code_3,
         n_regionkey || chr(65 + n_nationkey) || c_mktsegment[1] || o_orderstatus[1] AS code_4,
         n_name, c_mktsegment, o_orderstatus
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"""
_SPARSE = """
  SELECT p_partkey AS row_number, p_type AS source_sheet, CASE WHEN p_size <= 10 THEN p_brand END AS campo_amplio_codigo,
         CASE WHEN p_size <= 5 THEN p_name END AS campo_especifico_codigo, CASE WHEN p_size < 45 THEN 'P' || p_partkey END AS programa_codigo,
         '00' || p_size AS codigo_campo_programa_nivel FROM part"""
_FILLED = f"""
  SELECT row_number, source_sheet,
         last_value(campo_amplio_codigo IGNORE NULLS) OVER w AS campo_amplio_codigo,
         last_value(campo_especifico_codigo IGNORE NULLS) OVER w AS campo_especifico_codigo,
         programa_codigo, codigo_campo_programa_nivel FROM ({_SPARSE})
  WINDOW w AS (PARTITION BY source_sheet ORDER BY row_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
_PROGRAMS = f"""
  SELECT *, CAST(right(codigo_campo_programa_nivel, 1) AS INT) AS academic_level FROM ({_FILLED})
  WHERE programa_codigo IS NOT NULL AND CAST(right(codigo_campo_programa_nivel, 1) AS INT) BETWEEN 3 AND 9"""


def _text_of(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for name, char in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
        out = f"replace({out}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"nullif(regexp_replace({out}, '^[{WS}]+|[{WS}]+$', '', 'g'), '')"


def _tag(tag: str) -> str:
    return _text_of(rf"regexp_extract(html, '(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>', 1)")


ORACLES = {
    "catalog_distinct": """
      SELECT DISTINCT s_name, n_name, r_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
      JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_name IS NOT NULL""",
    "ordered_catalog": "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name IS NOT NULL ORDER BY p_partkey",
    "hierarchy_levels": f"""
      WITH c AS ({_CODED})
      SELECT DISTINCT code_1 AS codigo, CAST(NULL AS VARCHAR) AS parent_codigo, 'region ' || code_1 AS descripcion, 1 AS level FROM c
      UNION ALL SELECT DISTINCT code_2, code_1, n_name, 2 FROM c UNION ALL SELECT DISTINCT code_3, code_2, c_mktsegment, 3 FROM c
      UNION ALL SELECT DISTINCT code_4, code_3, o_orderstatus, 4 FROM c""",
    "hierarchy_rollup": f"""
      WITH c AS ({_CODED}),
      l3 AS (SELECT DISTINCT code_3 AS k, c_mktsegment AS v FROM c)
      SELECT code_4, count(*) AS orders, o_orderstatus AS label_4, c.code_3, l3.v AS label_3, code_2, n_name AS label_2, code_1,
             'region ' || code_1 AS label_1
      FROM c JOIN l3 ON l3.k = c.code_3 GROUP BY ALL""",
    "forward_fill_hierarchy": _FILLED,
    "program_catalog": f"""
      SELECT source_sheet, CASE source_sheet WHEN 'ECONOMY' THEN 2 WHEN 'LARGE' THEN 3 WHEN 'MEDIUM' THEN 4 WHEN 'PROMO' THEN 5
             WHEN 'SMALL' THEN 6 ELSE 7 END AS source_sheet_index, campo_amplio_codigo, campo_especifico_codigo, programa_codigo,
             codigo_campo_programa_nivel, academic_level FROM ({_PROGRAMS})""",
    "level_counts": f"SELECT academic_level, count(*) AS programs FROM ({_PROGRAMS}) GROUP BY academic_level",
    "csv_roundtrip": """
      SELECT p_brand, count(*) AS parts, lpad(CAST(min(p_partkey) AS VARCHAR), 8, '0') AS first_code,
             lpad(CAST(max(p_partkey) AS VARCHAR), 8, '0') AS last_code, count(DISTINCT p_name) AS names FROM part GROUP BY p_brand""",
    "page_fields": rf"""
      SELECT page_id, {_tag('title')} AS title, {_tag('h1')} AS heading, {_tag('p')} AS first_paragraph,
             len(regexp_extract_all(html, '(?i)<a\s[^>]*href')) AS links FROM pages""",
    "posting_page_fields": f"""
      SELECT doc_id, CAST(doc_id AS VARCHAR) AS posting_unique_id, c_name AS institution, c_mktsegment AS job_title,
             strftime(o_orderdate, '%d/%m/%Y') AS posting_start_date, CAST(NULL AS VARCHAR) AS posting_end_date,
             'S/. ' || format('{{:,.2f}}', o_totalprice) AS monthly_salary, CAST(day(o_orderdate) AS VARCHAR) AS number_of_vacancies,
             CAST(NULL AS VARCHAR) AS contract_type_raw,
             nullif(regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g'), '') AS experience_requirements,
             CAST(NULL AS VARCHAR) AS academic_profile, CAST(NULL AS VARCHAR) AS specialization, lang || ' & more' AS knowledge,
             CAST(NULL AS VARCHAR) AS competencies
      FROM ({SOURCES_SQL})""",
}

"""Pages to enriched postings through the stored tables, twice."""

import datetime

import pytest
from pyspark.sql import functions as F

from vacantlens import phases
from vacantlens.operators import features, profile
from vacantlens.session import scratch_path
from vacantlens.sources import sinks
from vacantlens.sources.committed import CommittedTables

LABELS = [
    ("sub-titulo", "CANTIDAD DE VACANTES", "2"), ("sub-titulo", "REMUNERACIÓN", "S/. 4,000.00"),
    ("sub-titulo", "FECHA INICIO DE PUBLICACIÓN", "05/12/2025"), ("sub-titulo", "FECHA FIN DE PUBLICACIÓN", "15/12/2025"),
    ("sub-titulo", "NÚMERO DE CONVOCATORIA", "728 X"), ("sub-titulo-2", "EXPERIENCIA", "EXPERIENCIA GENERAL: 3 AÑOS SECTOR PRIVADO"),
    ("sub-titulo-2", "FORMACIÓN ACADÉMICA", "TITULO PROFESIONAL EN DERECHO"), ("sub-titulo-2", "ESPECIALIZACIÓN", "gestion publica,archivo"),
    ("sub-titulo-2", "CONOCIMIENTO", "excel word"), ("sub-titulo-2", "COMPETENCIAS", "NO APLICA"),
]


def page(number, title="ABOGADO II", drop=None):
    items = "".join(
        f'<li><span class="{c}">{label}</span><span class="detalle-sp">{value}</span></li>' for c, label, value in LABELS if label != drop
    )
    return (
        f'<span class="sp-aviso0">{title}</span><span class="sp-aviso">MUNICIPALIDAD DE LIMA</span>'
        f'<ul><li><span class="sub-titulo-2">Nº {number}</span></li>{items}</ul>'
    )


@pytest.fixture(scope="module")
def store(spark):
    return phases.Store(scratch_path(spark, "store"))


def landed(spark, *html):
    at = datetime.datetime(2025, 12, 1)
    return spark.createDataFrame([(f"u{i}", h, at) for i, h in enumerate(html)], "url string, html string, scraped_at timestamp")


def test_phases(spark, store):
    first = landed(spark, page(1), page(2, "TECNICO CONTABLE"), page(2, "TECNICO CONTABLE"), page(3, drop="REMUNERACIÓN"), "<html></html>")
    counts = phases.extract(spark, first, store)
    assert counts == {"encountered": 5, "failed": 1, "complete": 2, "incomplete": 1, "duplicate": 1}
    again = phases.extract(spark, landed(spark, page(1), page(4)), store)
    assert again == {"encountered": 2, "failed": 0, "complete": 1, "incomplete": 0, "duplicate": 1}
    assert sorted(r.posting_unique_id for r in store.read(spark, "extracted_jobs").collect()) == ["1", "2", "4"]
    review = store.read(spark, "extracted_jobs_incomplete").collect()
    assert [(r.posting_unique_id, r.missing_fields, r.reviewed) for r in review] == [("3", "monthly_salary", False)]

    assert phases.clean_new(spark, store) == {"encountered": 3, "failed": 0, "complete": 3, "incomplete": 0, "duplicate": 0}
    assert phases.clean_new(spark, store)["duplicate"] == 3
    assert store.read(spark, "cleaned_jobs").count() == 3

    occupations = spark.createDataFrame([("2611", "Abogados"), ("3313", "Técnicos contables")], "isco_code string, descripcion string")
    offices = spark.createDataFrame(
        [("300", "MUNICIPALIDAD METROPOLITANA DE LIMA", "M", "01", "02", "03"), ("301", "MINISTERIO DE SALUD", "E", "01", "02", "03")],
        "ejecutora string, ejecutora_nombre string, nivel_gobierno string, sector string, pliego string, sec_ejec string",
    )
    courses = spark.createDataFrame(
        [("421016", "DERECHO", "0421", 6), ("999013", "DERECHO TECNICO", "0999", 3)],
        "programa_codigo string, programa_nombre string, campo_detallado_codigo string, academic_level int",
    )
    titles = phases.match_new(spark, store, "job_title_matches", "job_title", occupations, "isco_code", "descripcion", ["descripcion"])
    names = phases.match_new(
        spark, store, "institution_matches", "institution", offices, "ejecutora", "ejecutora_nombre",
        ["ejecutora_nombre", "nivel_gobierno", "sector", "pliego", "sec_ejec"],
    )
    programs = phases.match_new(
        spark, store, "academic_matches", "academic_profile", courses, "programa_codigo", "programa_nombre",
        ["programa_nombre", "campo_detallado_codigo"], levels=True,
    )
    assert titles.count() == 4 and {r.programa_codigo for r in programs.collect()} == {"421016"}
    # A second run finds no pending key and leaves the candidates as they are.
    again = phases.match_new(
        spark, store, "job_title_matches", "job_title", occupations, "isco_code", "descripcion", ["descripcion"], version="_v2"
    )
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, titles.select(again.columns).collect()), key=str)

    out = phases.transform(spark, store, titles, names, programs, fitted_topics=2, iterations=2)
    rows = {r.posting_unique_id: r for r in out.collect()}
    assert set(rows) == {1, 2, 4}
    row = rows[1]
    assert (row.job_title, row.isco_code, rows[2].isco_code) == ("ABOGADO", "2611", "3313")
    assert (row.ejecutora, row.nivel_gobierno, row.contract_regime) == ("300", "M", "D.LEG 728")
    assert (row.programa_codigo, row.thesis_required, row.experience_general_years, row.sector_private_required) == ("421016", 1, 3, 1)
    assert row.competencies_topic_0 == row.competencies_topic_1 == 0.5
    assert row.knowledge_topic_0 + row.knowledge_topic_1 == pytest.approx(1)
    assert out.select(F.max("salary_amount")).first()[0] == 4000.0


def rows_of(table):
    return sorted(map(tuple, table.collect()), key=str)


def test_a_killed_run_shows_nothing_and_is_repeated(spark):
    tables = CommittedTables(spark, scratch_path(spark, "committed"))
    one, two = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(2,)], "id int")
    assert tables.read("complete") is None
    first = tables.run("monday")
    first.append("complete", one)  # killed before the second table
    assert tables.read("complete") is None and not tables.run("monday").done()
    again = tables.run("monday")
    again.append("complete", one)
    again.append("review", two)
    assert again.commit() and tables.run("monday").done()
    # Done twice under its name, a run changes nothing.
    twice = tables.run("monday")
    twice.append("complete", one)
    assert not twice.commit()
    assert rows_of(tables.read("complete")) == [(1,)] and rows_of(tables.read("review")) == [(2,)]
    later = tables.run()
    later.append("complete", two)
    later.replace("review", one)
    later.commit()
    assert rows_of(tables.read("complete")) == [(1,), (2,)] and rows_of(tables.read("review")) == [(1,)]


def test_features_are_computed_once(spark):
    tables = CommittedTables(spark, scratch_path(spark, "features"))
    asked = []

    def encode(texts):
        asked.extend(r["text"] for r in texts.collect())
        return features.hashed_words(8)(texts)

    first = spark.createDataFrame([(1, "Abogado"), (2, "Abogado"), (3, None), (4, "")], "id int, name string")
    got = {r["id"]: r["vector"] for r in features.with_features(first, "name", tables, "f", encode).collect()}
    assert got[1] == got[2] and sum(x * x for x in got[1]) == pytest.approx(1) and got[3] == got[4] == [0.0] * 8
    second = spark.createDataFrame([(5, "Abogado"), (6, "Médico"), (7, "Médico")], "id int, name string")
    more = {r["id"]: r["vector"] for r in features.with_features(second, "name", tables, "f", encode).collect()}
    assert more[5] == got[1] and more[6] == more[7] and sorted(asked) == ["", "Abogado", "Médico"]


def test_stored_runs_score_vectors_and_score_a_key_once(spark):
    store = phases.Store(scratch_path(spark, "store"))
    phases.clean_new(spark, store)
    assert store.read(spark, "cleaned_jobs") is None
    run = store.tables(spark).run()
    run.append("cleaned_jobs", spark.createDataFrame([("ABOGADO", "SIN NIVEL"), ("TECNICO CONTABLE", None)], "job_title string, academic_profile string"))
    run.commit()
    titles = spark.createDataFrame([("2611", "Abogados"), ("3313", "Técnicos contables")], "isco_code string, descripcion string")
    got = phases.match_new(spark, store, "titles", "job_title", titles, "isco_code", "descripcion", ["descripcion"], k=1)
    scores = {r["job_title"]: (r["isco_code"], r["semantic_confidence"], r["fuzzy_confidence"], r["best_confidence"]) for r in got.collect()}
    assert {k: v[0] for k, v in scores.items()} == {"ABOGADO": "2611", "TECNICO CONTABLE": "3313"}
    assert all(sem > 0 and best == max(sem, fuz) for _, sem, fuz, best in scores.values())
    programs = spark.createDataFrame([("421016", "DERECHO", 6)], "programa_codigo string, programa_nombre string, academic_level int")
    for _ in range(2):  # no level, no candidates: scored once all the same
        out = phases.match_new(spark, store, "programs", "academic_profile", programs, "programa_codigo", "programa_nombre", [], levels=True)
        assert out.count() == 0
        assert rows_of(store.read(spark, "programs_keys")) == [("SIN NIVEL",)]


def test_only_changed_months_are_written_again(spark, tmp_path):
    path = str(tmp_path / "enriched")

    def months(*rows):
        table = spark.createDataFrame([(i, m, code) for i, m, code in rows], "id int, m string, isco_code string")
        return table.select("id", "isco_code", F.to_date("m").alias("year_month"))

    def files():
        return {f.parent.name: sorted(x.name for x in f.parent.glob("*.parquet")) for f in (tmp_path / "enriched").glob("*/*.parquet")}

    first = [(1, "2025-01-01", "a"), (2, "2025-02-01", "b"), (3, None, "c")]
    assert len(sinks.refresh_enriched(months(*first), path, sort=["isco_code"])) == 3
    before = files()
    assert sinks.refresh_enriched(months(*first), path) == [] and files() == before
    second = [*first[:1], (2, "2025-02-01", "B"), first[2], (4, "2025-03-01", "d"), (4, "2025-03-01", "d")]
    assert sorted(map(str, sinks.refresh_enriched(months(*second), path))) == ["2025-02-01", "2025-03-01"]
    after = files()
    kept = [m for m in before if after[m] == before[m]]
    assert sorted(kept) == ["year_month=2025-01-01", "year_month=__HIVE_DEFAULT_PARTITION__"] and len(after) == 4
    assert rows_of(spark.read.parquet(path).select("id", "isco_code")) == [(1, "a"), (2, "B"), (3, "c"), (4, "d"), (4, "d")]
    # A month that is gone leaves the table too.
    sinks.refresh_enriched(months(*second[:1]), path)
    assert rows_of(spark.read.parquet(path).select("id")) == [(1,)]


def test_distinct_counts_merge_over_months(spark):
    rows = spark.range(40000).select((F.col("id") % 4).alias("month"), (F.col("id") % 17000).alias("v"), F.lit("x").alias("one"), F.lit(None).cast("string").alias("none"))
    sketches = profile.distinct_sketches(rows, ["v", "one", "none"], ["month"])
    got = {r["column_name"]: r["distinct_values"] for r in profile.distinct_estimates(sketches).collect()}
    assert got["one"] == 1 and got["none"] == 0 and abs(got["v"] - 17000) < 17000 * 0.06
    by_month = profile.distinct_estimates(sketches.where("column_name = 'v'"), ["month"]).collect()
    assert len(by_month) == 4 and all(abs(r["distinct_values"] - 4250) < 4250 * 0.08 for r in by_month)

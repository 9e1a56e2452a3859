"""Cleaning runs, pages, sheets, features and the stream, end to end."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantlens import config
from vacantlens.operators import clean, enrich, topics, vectors
from vacantlens.sources import pages, sinks, tables
from vacantlens.sources.schemas import OCCUPATION_CSV, RAW_POSTINGS
from vacantlens.session import scratch_path
from vacantlens.streaming.ingest import ingest, read_landed, read_stored

GOOD = {
    "posting_unique_id": "735144", "job_title": "UN/A ANALISTA (A) II", "institution": "MINISTERIO",
    "monthly_salary": "S/. 4,000.00", "number_of_vacancies": "2", "posting_start_date": "05/12/2025",
    "posting_end_date": "15/12/2025", "contract_type_raw": "276 X", "experience_requirements": "- SECTOR PÚBLICO",
    "academic_profile": "TITULO PROFESIONAL", "specialization": "a,b", "knowledge": "c;d", "competencies": "e",
}


def raw(spark, *changes, at=0):
    rows = []
    for i, change in enumerate(changes):
        row = {**GOOD, **change, "scraped_at": datetime.datetime(2025, 12, 1, 0, 0, at + i)}
        rows.append(tuple(row[f.name] for f in RAW_POSTINGS.fields))
    return spark.createDataFrame(rows, RAW_POSTINGS)


def test_each_null_field_is_the_reason(spark):
    names = [f for f in config.FIELD_ORDER if f != "posting_unique_id"]
    df = raw(spark, *[{"posting_unique_id": str(i), n: None} for i, n in enumerate(names)])
    got = {r.posting_unique_id: r.failed_fields for r in clean.clean_split(df, None, ["scraped_at"]).collect()}
    renamed = {"monthly_salary": "salary_amount", "contract_type_raw": "contract_type"}
    assert got == {i: [renamed.get(n, n)] for i, n in enumerate(names)}


def test_split_partitions_the_input(spark):
    df = raw(
        spark, {}, {"posting_unique_id": "735144B"}, {"posting_unique_id": "S/N"}, {"posting_unique_id": None},
        {"posting_unique_id": "2", "posting_end_date": "31/02/2025"}, {"posting_unique_id": "3"}, {"posting_unique_id": "4", "institution": " - "},
    )
    known = spark.createDataFrame([(3,)], "posting_unique_id long")
    split = clean.clean_split(df, known, ["scraped_at"])
    assert {(r.posting_unique_id, r.outcome) for r in split.collect()} == {(735144, "complete"), (2, "incomplete"), (4, "complete")}
    stats = {r.statistic: r.rows for r in clean.run_statistics(df, split).collect()}
    assert stats == {"encountered": 7, "complete": 2, "incomplete": 1, "failed": 2, "duplicate": 2, "new_rows": 3}
    assert clean.failed_rows(df).count() == 2
    bad = clean.quarantine_rows(split).first()
    assert (bad.failed_fields, bad.reviewed, bad.notes) == ("posting_end_date", False, None)
    # 'NO INFO' institutions count as present unless asked otherwise.
    strict = clean.clean_postings(df, null_no_info=True).where("posting_unique_id = 4").first()
    assert strict.failed_fields == ["institution"]


def test_second_run_adds_nothing(spark):
    df = raw(spark, {}, {"posting_unique_id": "8B", "competencies": None})
    complete, bad = scratch_path(spark, "complete"), scratch_path(spark, "bad")
    sinks.write_split(clean.clean_split(df, None, ["scraped_at"]), complete, bad)
    stored = [spark.read.parquet(p) for p in (complete, bad)]
    assert {r.status: r.rows for r in clean.stored_counts(*stored).collect()} == {"complete": 1, "incomplete": 1}
    known = stored[0].select("posting_unique_id").union(stored[1].select("posting_unique_id"))
    assert clean.clean_split(df, known, ["scraped_at"]).count() == 0


def test_enrich_and_write_by_month(spark):
    split = clean.clean_split(raw(spark, {}, {"posting_unique_id": "9", "job_title": "OTRO"}), None, ["scraped_at"])
    titles = spark.createDataFrame([("ANALISTA", "2411")], "job_title string, isco_code string")
    topic_rows = spark.createDataFrame([(735144, 0.5)], "posting_unique_id long, knowledge_topic_0 double")
    path = scratch_path(spark, "enriched")
    sinks.write_enriched(enrich.enrich(clean.complete_rows(split), titles, topics=topic_rows), path, sort=["isco_code"])
    got = {r.posting_unique_id: r for r in spark.read.parquet(path).collect()}
    row = got[735144]
    assert (row.isco_code, row.contract_regime, row.contract_temporal_nature, row.thesis_required, row.sector_public_required) == (
        "2411", "D.LEG 276", "PERMANENT", 1, 1,
    )
    assert row.knowledge_topic_0 == 0.5 and row.year_month == datetime.date(2025, 12, 1)
    assert got[9].isco_code is None and got[9].knowledge_topic_0 is None


PAGE = """<html><body><span class="sp-aviso0"> JEFE  DE ÁREA </span><span class='sp-aviso'>MUNI &amp; CIA</span>
<ul><li><span class="sub-titulo-2">N° 735144</span></li>
<li><span class="sub-titulo">CANTIDAD DE
  VACANTES:</span><i>x</i><span class="detalle-sp">3</span></li>
<li><span class="sub-titulo">REMUNERACIÓN:</span></li>
<li><span class="sub-titulo">REMUNERACIÓN MENSUAL:</span><div class="a detalle-sp"> S/. <b>4,000.00</b> </div></li>
<li><span class="sub-titulo-2">EXPERIENCIA</span><span class="detalle-sp">uno
dos &lt;3</span><span class="detalle-sp">otro</span></li>
<li><span class="sub-titulo">CONOCIMIENTO</span><span class="detalle-sp">wrong class</span></li>
<li><span class="sub-titulo-2">COMPETENCIAS</span></li></ul></body></html>"""


def test_posting_page(spark):
    df = spark.createDataFrame([("u", PAGE), ("v", "<html></html>"), ("w", None)], "url string, html string")
    rows = {r.url: r.asDict() for r in pages.posting_fields(df, "html", ["url"]).collect()}
    found = {k: v for k, v in rows["u"].items() if v is not None and k != "url"}
    assert found == {
        "posting_unique_id": "735144", "institution": "MUNI & CIA", "job_title": "JEFE  DE ÁREA", "monthly_salary": "S/. 4,000.00",
        "number_of_vacancies": "3", "experience_requirements": "uno\ndos <3",
    }
    assert all(rows[u][f] is None for u in "vw" for f in config.FIELD_ORDER)


def fields_of(spark, body):
    df = spark.createDataFrame([(body,)], "html string")
    return {k: v for k, v in pages.posting_fields(df, "html", []).first().asDict().items() if v is not None}


def test_long_page_does_not_exhaust_the_matcher(spark):
    body = "<li><span class='sub-titulo-2'>EXPERIENCIA</span><span class='detalle-sp'>" + "palabra<br>" * 20000 + "</span></li>"
    assert len(fields_of(spark, "<p>x</p>" * 5000 + body)["experience_requirements"]) == 7 * 20000


def test_values_nest_to_any_depth(spark):
    deep = "<div class='a'>" * 7 + "x<div>y</div>" + "</div>" * 7
    page = f"<ul><li><span class='sub-titulo-2'>EXPERIENCIA</span><div class='b detalle-sp'>{deep} end</div> no</li></ul>"
    assert fields_of(spark, page) == {"experience_requirements": "xy end"}


def test_labels_with_markup_and_entities(spark):
    page = """<LI><SPAN CLASS="sub-titulo">REMUNERACI&Oacute;N<b>:</b></SPAN><br/><img src="a>b.png" alt='<b>'>
      <p class=detalle-sp>S/.&nbsp;1&#48;&#x30;0 &euro;&#128; &amp;lt; &unknown; a<3&nbsp;</p></LI>
      <li><span class='sub-titulo'><i>CANTIDAD</i>&nbsp;DE\n<b>VACANTES</b></span><span class='detalle-sp'>2</span></li>
      <li><span class='sub-titulo-2'>N&ordm; <b>77</b></span></li>
      <!-- <span class='sub-titulo-2'>EXPERIENCIA</span><span class='detalle-sp'>no</span> -->"""
    assert fields_of(spark, page) == {
        "monthly_salary": "S/.\u00a01000 \u20ac\u20ac &lt; &unknown; a<3", "number_of_vacancies": "2", "posting_unique_id": "77",
    }


def test_values_are_later_siblings_only(spark):
    label = "<span class='sub-titulo-2'>CONOCIMIENTO</span>"
    value = "<span class='detalle-sp'>{}</span>"
    other = "<li>" + value.format("other") + "</li>"
    assert fields_of(spark, f"<ul><li>{value.format('before')}{label}</li>{other}</ul>") == {}
    assert fields_of(spark, f"<ul><li>{label}<div>{value.format('inside')}</div></li>{other}</ul>") == {}
    # A label without value leaves the field to the next one that has one; two labels may share a value.
    again = f"<ul><li>{label}</li><li>{label}<span class='sub-titulo-2'>EXPERIENCIA</span>{value.format('mine')}{value.format('later')}</li></ul>"
    assert fields_of(spark, again) == {"knowledge": "mine", "experience_requirements": "mine"}
    assert fields_of(spark, f"<div>{label}{value.format('open')[:-7]}") == {"knowledge": "open"}


def test_sheets_with_extra_and_missing_columns(spark):
    base = scratch_path(spark, "sheets")
    spark.createDataFrame([("1", "A", "x", "more")], "a string, b string, c string, d string").write.csv(f"{base}/one")
    spark.createDataFrame([("1", "B")], "a string, b string").write.csv(f"{base}/two")
    got = tables.read_sheets(spark, [(f"{base}/one", "one", 2), (f"{base}/two", "two", 3)], ["p", "q"])
    assert {(r.row_number, r.p, r.q, r.extra_0, r.source_sheet, r.source_sheet_index) for r in got.collect()} == {
        (1, "A", "x", "more", "one", 2), (1, "B", None, None, "two", 3),
    }


def test_csv_codes_keep_zeros(spark):
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame([("0", "01", "011", "0113", "Jefes, otros")], OCCUPATION_CSV)
    sinks.export_csv(df, path)
    assert tuple(tables.read_csv(spark, path, OCCUPATION_CSV).first()) == ("0", "01", "011", "0113", "Jefes, otros")


@pytest.fixture(scope="module")
def corpus(spark):
    themes = ["excel word oficina", "derecho ley juez", "salud clinica paciente"]
    rows = [(i, f"{themes[i % 3]} {themes[i % 3].split()[i % 2]} comun") for i in range(60)] + [(60, None), (61, "NO APLICA")]
    return spark.createDataFrame(rows, "id int, t string")


def test_topics_sum_to_one_and_reload_equally(spark, corpus):
    texts = topics.topic_text(corpus, "id", "t", blank_values=True)
    model = topics.fit_topics(texts, topics=3, iterations=5)
    first = {r.id: list(r)[1:] for r in topics.topic_features(model, texts, "id", "k").collect()}
    assert len(first) == 62 and all(len(w) == 3 and sum(w) == pytest.approx(1) for w in first.values())
    assert first[60] == first[61] == [pytest.approx(1 / 3)] * 3
    path = scratch_path(spark, "model")
    topics.save_topics(model, path)
    again = {r.id: list(r)[1:] for r in topics.topic_features(topics.load_topics(path), texts, "id", "k").collect()}
    assert again == {k: pytest.approx(v) for k, v in first.items()}
    words = topics.top_words(model, 4).collect()
    assert len(words) == 12 and {r["rank"] for r in words} == {1, 2, 3, 4}
    assert "comun" not in {r.word for r in words}  # in more than 80% of the texts
    kept = topics.topic_text(corpus, "id", "t", blank_values=False).where("id = 61").first().text
    assert kept == "NO APLICA"


def test_vectors_have_unit_length_and_zeros_for_null(spark, corpus):
    model = vectors.fit_text_vectors(corpus, "t", width=32)
    got = {r.id: r.vector for r in vectors.text_vectors(model, corpus, "t", ["id"]).collect()}
    assert sum(x * x for x in got[0]) == pytest.approx(1) and set(got[60]) == {0.0}


def test_pca_is_centred(spark):
    import numpy as np

    data = np.random.default_rng(1).normal(size=(80, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1]) + 100
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(data)], "id int, v array<double>")
    model = vectors.fit_pca(df, "v", 2)
    got = np.array([r.components for r in vectors.pca_features(model, df, "v", ["id"]).orderBy("id").collect()])
    _, s, vt = np.linalg.svd(data - data.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((data - data.mean(axis=0)) @ vt[:2].T), atol=1e-6)
    assert vectors.explained_variance(model) == pytest.approx(list((s**2 / (s**2).sum())[:2]))


def test_clusters_find_the_themes(spark, corpus):
    rows = vectors.text_clusters(corpus, "t", ks=(2, 3), restarts=2).collect()
    assert [r.k for r in rows] == [2, 3] and rows[1].silhouette > rows[0].silhouette


def test_stream_equals_batch_over_several_deliveries(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("t", T.StringType())])
    landing, target, checkpoint = (scratch_path(spark, p) for p in ("landing", "target", "checkpoint"))
    start = datetime.datetime(2025, 1, 1)

    def deliver(ids, day):
        rows = [(i, start + datetime.timedelta(days=day), "x" if i % 3 else None) for i in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)

    def split(batch):
        return batch.withColumn("outcome", F.when(F.col("t").isNull(), "incomplete").otherwise("complete"))

    def run():
        query = ingest(read_landed(spark, landing, schema), "id", "ts", split, target, checkpoint, delay="2 days")
        query.awaitTermination()

    deliver([1, 2, 3, 3, 2], 0)
    run()
    deliver([3, 4, 5], 10)
    run()
    # Days later and beyond the watermark: the state has forgotten id 1, the stored table has not.
    deliver([1, 6], 30)
    run()
    deliver([5, 6, 1], 60)
    run()
    stored = read_stored(spark, target, split(read_landed(spark, landing, schema)).schema)
    assert sorted((r.id, r.outcome) for r in stored.collect()) == [
        (1, "complete"), (2, "complete"), (3, "incomplete"), (4, "complete"), (5, "complete"), (6, "incomplete"),
    ]


def test_scratch_follows_the_session_setting(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")

    class Conf:
        def get(self, key, default=None):
            return "hdfs://shared/folder/"

    class Session:
        conf = Conf()

    assert scratch_path(Session(), "x").startswith("hdfs://shared/folder/x-")


def test_append_new_and_newest_first(spark):
    path = scratch_path(spark, "phase")
    first = raw(spark, {}, {"posting_unique_id": "2"})
    first.write.parquet(path)
    batch = raw(spark, {"posting_unique_id": "2"}, {"posting_unique_id": "3", "job_title": "B"}, {"posting_unique_id": "3"}, at=10)
    for _ in range(2):
        sinks.append_new(spark.read.parquet(path), batch, ["posting_unique_id"], ["scraped_at"], path)
    newest = tables.phase_table(spark, path, "scraped_at", ["posting_unique_id"], limit=2).collect()
    assert [(r.posting_unique_id, r.job_title) for r in newest] == [("3", "B"), ("2", GOOD["job_title"])]
    assert tables.phase_table(spark, path, "scraped_at", ["posting_unique_id"]).count() == 3

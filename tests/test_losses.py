"""Rows and values that must not be lost or changed silently."""

import pytest
from pyspark.sql import functions as F

from vacantlens.functions import parsing
from vacantlens.functions.numeric import fixed_mean, fixed_sum
from vacantlens.operators import enrich, incremental, maintain, match
from vacantlens.sources import pages, sinks, tables
from vacantlens.sources.committed import CommittedTables
from vacantlens.sources.schemas import strings
from vacantlens.streaming.ingest import ingest, read_landed, read_stored
from vacantlens.streaming.keystore import KeyStore


def test_sums_keep_small_and_huge_values(spark):
    df = spark.createDataFrame([(0.001,), (0.004,), (0.003,)], "v double")
    row = df.agg(fixed_mean(F.col("v")), fixed_sum(F.col("v"))).first()
    assert abs(row[0] - 0.008 / 3) < 1e-15 and row[1] == 0.008
    huge = spark.createDataFrame([(1e19,), (2.0,), (None,)], "v double")
    assert huge.agg(fixed_sum(F.col("v"))).first()[0] == 1e19 + 2.0
    assert huge.where("v IS NULL").agg(fixed_sum(F.col("v"))).first()[0] is None


def test_refresh_keeps_unvalidated_rows_that_hold_null(spark):
    schema = "k string, code string, validated int"
    stored = spark.createDataFrame([("a", "1", None), ("b", "2", 0), ("c", "3", 1)], schema)
    fresh = spark.createDataFrame([("b", "9", 0)], schema)
    got = {tuple(r) for r in maintain.refresh_candidates(stored, fresh, "k", "code").collect()}
    assert got == {("a", "1", None), ("b", "9", 0), ("c", "3", 1)}


def test_patches_never_multiply_rows(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, n string, v double")
    patch = spark.createDataFrame([(1, "x", None, 1), (1, None, 7.0, 2), (1, "y", None, 3)], "id long, n string, v double, at int")
    got = {tuple(r) for r in maintain.apply_patches(base, patch, "id", ["n", "v"], order="at").collect()}
    assert got == {(1, "y", 7.0), (2, "b", 2.0)}


def test_one_candidate_per_code_over_levels(spark):
    keys = spark.createDataFrame([("k", "alpha beta", ["1", "2"])], "key string, text string, levels array<string>")
    rows = [("A", "1", "alpha beta", 1), ("A", "2", "alpha beta", 2), ("B", "2", "alpha", 3)]
    catalog = spark.createDataFrame(rows, "code string, level string, name string, pos long")
    got = match.match_topk(
        keys, catalog, key="key", code="code", order="pos", k=2, threshold=0, key_text="text", catalog_text="name", level="level", search_levels="levels"
    )
    assert [r["code"] for r in got.orderBy("rank").collect()] == ["A", "B"]


def test_csv_and_sheets_keep_cells(spark, tmp_path):
    text = 'he said "hi, there" ok\nsecond line'
    sinks.export_csv(spark.createDataFrame([("1", text), ("2", "x")], "id string, text string"), str(tmp_path / "csv"))
    back = tables.read_csv(spark, str(tmp_path / "csv"), strings("id", "text"))
    assert {tuple(r) for r in back.collect()} == {("1", text), ("2", "x")}
    (tmp_path / "sheet.csv").write_text('1,a\n2,b,c,d\n3,"e,f"\n')
    sheet = tables.read_sheets(spark, [(str(tmp_path / "sheet.csv"), "s", 1)], ["one"])
    assert [tuple(r)[:4] for r in sheet.orderBy("row_number").select("row_number", "one", "extra_0", "extra_1").collect()] == [
        (1, "a", None, None), (2, "b", "c", "d"), (3, "e,f", None, None)]


def test_value_with_an_inner_tag_of_its_name(spark):
    html = '<li><span class="lab">PAY</span><span class="val">S/. <span>4</span> mil</span></li>'
    got = spark.createDataFrame([(html,)], "h string").select(pages.labelled_field(F.col("h"), "PAY", "lab", "val"))
    assert got.first()[0] == "S/. 4 mil"


def test_new_checkpoint_keeps_stored_rows(spark, tmp_path):
    def run(ids, name):
        landed = str(tmp_path / name)
        spark.createDataFrame([(i, "2024-01-01 00:00:00") for i in ids], "id long, at string").select("id", F.col("at").cast("timestamp")).write.parquet(landed)
        stream = read_landed(spark, landed, spark.read.parquet(landed).schema)
        split = lambda b: b.withColumn("outcome", F.lit("complete"))
        ingest(stream, "id", "at", split, str(tmp_path / "target"), str(tmp_path / f"check-{name}")).awaitTermination()
        return split(spark.read.parquet(landed)).schema

    run([1, 2], "one")
    schema = run([2, 3], "two")
    got = sorted(r["id"] for r in read_stored(spark, str(tmp_path / "target"), schema).collect())
    assert got == [1, 2, 3]


def test_cells_behind_a_line_break_stay(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text('1,a,"x\ny",b,c\n2,"d ""quoted"", twice",e\n')
    sheet = tables.read_sheets(spark, [(str(tmp_path / "sheet.csv"), "s", 1)], ["one", "two"])
    rows = sheet.orderBy("row_number").select("row_number", "one", "two", "extra_0", "extra_1").collect()
    assert [tuple(r) for r in rows] == [(1, "a", "x\ny", "b", "c"), (2, 'd "quoted", twice', "e", None, None)]


def test_tiny_values_are_not_lost(spark):
    rows = spark.createDataFrame([(1e-20,), (3e-20,)], "v double")
    assert rows.select(fixed_mean(F.col("v"))).first()[0] == pytest.approx(2e-20)


def test_a_persons_code_counts(spark):
    schema = "k string, code string, name string, best_confidence int, rank int, validated int, validated_code string"
    rows = [("a", "A", "for A", 99, 1, 0, None), ("a", "X", "for X", 50, 2, 1, "B"), ("b", "C", "for C", 80, 1, None, "D"), ("c", "E", "for E", 70, 1, 1, None)]
    catalog = spark.createDataFrame([("A", "for A"), ("B", "for B")], "code string, name string")
    got = enrich.best_candidates(spark.createDataFrame(rows, schema), "k", "code", ["code", "name"], catalog=catalog)
    assert sorted(map(tuple, got.collect())) == [("a", "B", "for B"), ("b", "C", "for C"), ("c", "E", "for E")]


def test_years_in_brackets(spark):
    text = spark.createDataFrame([("EXPERIENCIA GENERAL: TRES (03) AÑOS",)], "t string")
    plain, read = (text.select(parsing.parse_experience(F.col("t"), paren_years=flag)["experience_general_years"]).first()[0] for flag in (False, True))
    assert plain is None and read == 3


def test_lost_checkpoint_overwrites_nothing(spark, tmp_path):
    """A checkpoint lost and made again at the same path: batch 0 of another query."""
    schema = None
    for n, ids in enumerate(([1, 2], [2, 3])):
        landed, checkpoint = str(tmp_path / f"landed-{n}"), tmp_path / "check"
        spark.createDataFrame([(i, "2024-01-01 00:00:00") for i in ids], "id long, at string").select("id", F.col("at").cast("timestamp")).write.parquet(landed)
        split = lambda b: b.withColumn("outcome", F.lit("complete"))
        schema = split(spark.read.parquet(landed)).schema
        ingest(read_landed(spark, landed, spark.read.parquet(landed).schema), "id", "at", split, str(tmp_path / "target"), str(checkpoint)).awaitTermination()
        checkpoint.rename(tmp_path / f"lost-{n}")
    assert sorted(r["id"] for r in read_stored(spark, str(tmp_path / "target"), schema).collect()) == [1, 2, 3]


def test_key_store_knows_all_ids_and_reads_few_files(spark, tmp_path):
    tables = CommittedTables(spark, str(tmp_path / "store"))
    store = KeyStore(tables, "id", per_file=50, fanout=3)
    assert store.files(spark.range(5)) == []
    merged = 0
    for n in range(7):
        run = tables.run(f"batch {n}")
        store.add(run, f"b{n}", spark.range(n * 1000, n * 1000 + 200).union(spark.createDataFrame([(None,)], "id long")))
        run.commit()
        run = tables.run(f"merge {n}")
        if store.merge(run, f"m{n}"):
            run.commit()
            merged += 1
    filters = tables.read("keys_filters")
    assert merged == 2 and sorted({(r["level"], r["batch"]) for r in filters.collect()}) == [(0, "b6"), (1, "m2"), (1, "m5")]
    # All stored ids are known; of new ones hardly a file is read, one file for an id that is stored.
    everything = spark.createDataFrame([(n * 1000 + i,) for n in range(7) for i in range(200)], "id long")
    assert store.unknown(everything).count() == 0
    fresh = spark.range(500, 900).unionByName(spark.createDataFrame([(None,)], "id long"))
    assert store.unknown(fresh).count() == 401
    assert len(store.files(spark.range(500, 520))) <= 1 and len(store.files(spark.range(3005, 3006))) == 1 < filters.count() // 10


def test_copies_go_before_the_first_shuffle(spark):
    target = spark.createDataFrame([(1,)], "id long")
    batch = spark.range(100).select((F.col("id") % 3).alias("id"), F.col("id").alias("at"))
    out = incremental.insert_or_ignore(target, batch, ["id"], ["at"])
    assert {r["id"] for r in out.collect()} == {0, 2}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_documents_without_an_order_are_postings(spark, tmp_path):
    """Every document reaches the cleaning queries, with or without an order or customer of its number."""
    import check
    from __spark_entry__ import oracle_sql, queries

    source = "/root/testdata/sf0.001"
    for name in check.TABLES:
        (tmp_path / f"{name}.parquet").symlink_to(f"{source}/{name}.parquet")
    for name, kept in (("orders", "o_orderkey % 3 <> 0"), ("customer", "c_custkey % 5 <> 0")):
        (tmp_path / f"{name}.parquet").unlink()
        spark.read.parquet(f"{source}/{name}.parquet").where(kept).coalesce(1).write.parquet(str(tmp_path / "made" / name))
        (part,) = (tmp_path / "made" / name).glob("*.parquet")
        part.rename(tmp_path / f"{name}.parquet")
    root, con = str(tmp_path), check.connect(str(tmp_path))
    for name in ("clean_split", "failed_rows", "classify_contract", "posting_page_fields", "variant_counts", "pair_drilldown"):
        assert check.compare(queries()[name](spark, root), con, oracle_sql()[name]) == "", name
    assert queries()["classify_contract"](spark, root).count() == con.execute("SELECT count(*) FROM documents").fetchone()[0]


def test_csv_whose_rows_are_lines_is_read_in_splits(spark, tmp_path):
    path = str(tmp_path / "csv")
    rows = [(str(i), f'a "quoted", cell {i}') for i in range(5000)]
    sinks.export_csv(spark.createDataFrame(rows, "id string, text string").coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        whole = tables.read_csv(spark, path, strings("id", "text"))
        split = tables.read_csv(spark, path, strings("id", "text"), line_breaks=False)
        assert split.rdd.getNumPartitions() > whole.rdd.getNumPartitions()
        assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect())) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

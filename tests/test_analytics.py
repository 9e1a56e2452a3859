"""Quantiles, describe, histograms, frontier and forward fill against brute force."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vacantlens.operators import dispersion, filters, hierarchy, incremental, profile, repeats, scan
from vacantlens.operators.brackets import bracketed
from vacantlens.operators.quantiles import describe, exact_quantiles, histogram, value_bucket


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.sampled_from(["a", "b", None]), st.floats(-1e9, 1e9) | st.integers(-50, 50).map(float) | st.none()),
        min_size=1,
        max_size=60,
    )
)
def test_quantiles_equal_pandas(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", [0.0, 0.25, 0.5, 0.995, 1.0]).collect()}
    want = pd.DataFrame(rows, columns=["k", "v"]).dropna()
    assert set(got) == set(want.k)
    for key, part in want.groupby("k"):
        row = got[key]
        assert row.n == len(part)
        for prob, name in ((0.0, "q0"), (0.25, "q25"), (0.5, "q50"), (0.995, "q99_5"), (1.0, "q100")):
            assert row[name] == pytest.approx(np.quantile(part.v, prob), rel=1e-12, abs=1e-9)


def test_buckets_never_decrease(spark):
    values = sorted([0.0, 1e-320, 1e-300, 0.5, 0.999999, 1.0, 2.0, 7.999999, 8.0, 8.000001, 1e15, 1e300, 1.7e308])
    values = [-v for v in reversed(values[1:])] + values
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    buckets = [r[0] for r in df.orderBy("i").select(value_bucket(F.col("v"))).collect()]
    assert buckets == sorted(buckets)


def test_quantiles_of_one_hot_value_and_one_hot_key(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 100).cast("string"))).alias("k"),
        F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.col("id") / 7).alias("v"),
    )
    got = {r.k: r.q50 for r in exact_quantiles(df, ["k"], "v", [0.5]).collect()}
    want = df.toPandas().groupby("k").v.median().to_dict()
    assert got == pytest.approx(want)


def test_describe_single_row_has_no_deviation(spark):
    row = describe(spark.createDataFrame([(3.0,)], "v double"), "v").first()
    assert (row["count"], row["mean"], row["std"], row["q50"]) == (1, 3.0, None, 3.0)


def test_histogram_without_key_closes_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 10, 10]], "v double")
    assert {r.bin: r.rows for r in histogram(df, "v", bins=5).collect()} == {0: 2, 1: 1, 4: 2}
    same = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert [(r.bin, r.rows) for r in histogram(same, "v", bins=50).collect()] == [(25, 2)]


def test_pay_dispersion_thresholds_labels_and_order(spark):
    rows = [("10", f"i{n % 3}", 2000.0 + 100 * n) for n in range(6)] + [("20", f"i{n}", 3000.0) for n in range(4)] + [("30", "i1", 2000.0)]
    rows += [("10", "i9", 50.0), (None, "i1", 2000.0)]
    labels = spark.createDataFrame([("10", "ten")], "codigo string, descripcion string")
    df = spark.createDataFrame(rows, "code string, inst string, pay double")
    got = dispersion.pay_dispersion(df, labels, "code", "inst", "pay", min_postings=4, min_institutions=3).collect()
    assert [(r.code, r.descripcion, r.postings, r.institutions, r.median_salary) for r in got] == [
        ("10", "ten", 6, 3, 2250.0), ("20", None, 4, 4, 3000.0),
    ]
    assert got[1].cv_salary == 0.0 and got[0].cv_salary == pytest.approx(8.3)


def test_zscores_equal_row_level_definition(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(
        {"o": rng.choice(["x", "y"], 300), "t": rng.choice(["E", "R", None], 300), "i": rng.choice([f"i{k}" for k in range(9)], 300),
         "p": rng.normal(3000, 500, 300).round(2)}
    )
    pdf = pd.concat([pdf, pd.DataFrame({"o": ["z"] * 3, "t": ["E"] * 3, "i": ["i0"] * 3, "p": [1.0, 2.0, 3.0]})], ignore_index=True)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "o string, t string, i string, p double")
    got = {(r.o, r.t, r.i): r for r in dispersion.tier_zscores(df, "o", "t", "i", "p", z_limit=0.3).collect()}
    rows = pdf.dropna(subset=["t"]).copy()
    g = rows.groupby(["o", "t"]).p
    n, std = g.transform("count"), g.transform("std")
    rows["z"] = np.where((n >= 5) & (std > 0), (rows.p - g.transform("mean")) / std, np.nan)
    want = rows.groupby(["o", "t", "i"]).agg(n=("p", "count"), med=("p", "median"), z=("z", "mean"))
    want = want[want.n >= 2]
    assert set(got) == set(want.index)
    for key, row in want.iterrows():
        if np.isnan(row.z):
            assert got[key].avg_z_score is None and got[key].flagged is False
        else:
            assert got[key].avg_z_score == pytest.approx(row.z, abs=1e-9)
            assert got[key].flagged == (abs(row.z) > 0.3)
        assert got[key].median_salary == pytest.approx(row.med)


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum(" Exchange " in line and "Reused" not in line for line in plan.splitlines())


def test_bracketed_levels_equal_numpy(spark):
    rng = np.random.default_rng(5)
    n = 6000
    pdf = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 6, n).astype(str)), "i": rng.integers(0, 3, n).astype(str),
        "v": np.where(rng.random(n) < 0.3, 7.25, np.round(rng.lognormal(3, 2, n), 2) * rng.choice([-1, 1], n)),
    })
    pdf.loc[::50, "v"] = None
    df = spark.createDataFrame([(a, b, None if pd.isna(v) else float(v)) for a, b, v in pdf.itertuples(index=False)] + [("only", "0", None), (None, "0", 1.0)], "k string, i string, v double")
    probs = {0.0: "a", 0.25: "b", 0.5: "c", 0.995: "d", 1.0: "e"}
    # 40 is coarse enough that brackets leave most rows of most keys out.
    got = bracketed(df, [["k", "i"], ["k"], []], "v", probs, {"n": F.count("v")}, accuracy=40)
    assert exchanges(got) <= 6
    rows = {(r._level, r.k, r.i): r for r in got.collect()}
    want = {(0, *key): g for key, g in pdf.groupby(["k", "i"])} | {(1, key, None): g for key, g in pdf.groupby("k")} | {(2, None, None): pdf}
    assert set(rows) == set(want) | {(0, "only", "0"), (1, "only", None)}
    for key, g in want.items():
        v = g.v.dropna()
        assert rows[key].n == len(v)
        assert [rows[key][name] for name in probs.values()] == pytest.approx(list(np.quantile(v, list(probs))), abs=1e-9)
    assert rows[(1, "only", None)].c is None and rows[(1, "only", None)].n == 0


def test_pay_reports_read_facts_once(spark):
    rows = [("o%d" % (i % 3), "s%d" % (i % 11), "t%d" % (i % 11 % 2), float(i * 37 % 101)) for i in range(500)]
    df = spark.createDataFrame(rows, "o string, s string, t string, p double")
    for report in (
        dispersion.institution_pay(df, ["o"], "s", "p"), dispersion.tier_pay(df, ["o"], "t", "p"), dispersion.tier_zscores(df, "o", "t", "s", "p"),
    ):
        # What is left to do reads stored tables only.
        assert "Scan ExistingRDD" not in report._jdf.queryExecution().executedPlan().toString()
        assert exchanges(report) <= 6


def brute_frontier(events, threshold):
    out = {}
    for source, seq, dup, saved in sorted(events, key=lambda e: (e[0], e[1])):
        state = out.setdefault(source, {"run": 0, "longest": 0, "frontier": None})
        state["run"] = 0 if saved else state["run"] + dup
        if state["run"] >= threshold and state["frontier"] is None:
            state["frontier"] = seq
        state["longest"] = max(state["longest"], state["run"])
    return {k: (v["longest"], v["frontier"]) for k, v in out.items()}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("dddsn")), min_size=1, max_size=60), st.integers(1, 4), st.integers(1, 7))
def test_frontier_equals_sequential_scan(spark, kinds, threshold, block):
    events = [(source, i, int(kind == "d"), kind == "s") for i, (source, kind) in enumerate(kinds)]
    df = spark.createDataFrame(events, "src string, seq long, dup int, saved boolean")
    got = incremental.duplicate_run_frontier(df, "src", "seq", "dup", "saved", threshold, block_rows=block).collect()
    assert {r.src: (r.longest_run, r.frontier) for r in got} == brute_frontier(events, threshold)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["x", "y", None]), st.sampled_from(["1", None])), min_size=1, max_size=40), st.integers(1, 6))
def test_forward_fill_equals_pandas(spark, cells, block):
    rows = [(s, i, a, b) for i, (s, a, b) in enumerate(cells)]
    df = spark.createDataFrame(rows, "sheet string, n long, a string, b string")
    got = {r.n: (r.a, r.b) for r in hierarchy.forward_fill(df, ["a", "b"], "sheet", "n", block_rows=block).collect()}
    pdf = pd.DataFrame(rows, columns=["sheet", "n", "a", "b"])
    want = pdf.groupby("sheet")[["a", "b"]].ffill()
    assert got == {n: tuple(None if pd.isna(v) else v for v in want.loc[n]) for n in want.index}


def test_blocks_are_even_however_positions_lie(spark):
    # Ids spread over 10^12, most of them crowded at the start; one part holds most rows.
    ids = spark.range(20000).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") % 10 < 9, F.concat(F.lit("p"), F.col("id") % 500)).alias("part"),
        F.when(F.col("id") < 15000, F.col("id")).otherwise(F.col("id") * 50_000_000 - 10).alias("n"),
        F.when(F.col("id") % 97 == 0, F.col("id")).alias("v"),
    )
    blocks = [tuple(r) for r in scan.balanced_blocks(ids, "part", "n", 1000).groupBy("_block").agg(
        F.count("*"), F.min(F.struct("part", "n")), F.max(F.struct("part", "n"))).orderBy("_block").collect()]
    assert len(blocks) >= 15 and max(b[1] for b in blocks) <= 2000 and sum(b[1] for b in blocks) == 20000
    order = lambda x: (x.part is not None, x.part or "", x.n)
    assert all(order(a[3]) < order(b[2]) for a, b in zip(blocks, blocks[1:]))
    got = {(r.part, r.n): r.v for r in hierarchy.forward_fill(ids, ["v"], "part", "n", 1000).collect()}
    last, want = {}, {}
    for r in sorted(ids.collect(), key=order):
        last[r.part] = r.v if r.v is not None else last.get(r.part)
        want[(r.part, r.n)] = last[r.part]
    assert got == want


def test_program_rows_drop_headers_and_bad_levels(spark):
    df = spark.createDataFrame(
        [("s", 1, "A", None, "Codigo", "nivel"), ("s", 2, None, None, "p1", "001016"), ("s", 3, "B", "b", None, "001016"),
         ("s", 4, None, None, "p2", "001012"), ("s", 5, None, None, "p1", "001013")],
        "sheet string, n long, a string, b string, p string, l string",
    )
    got = hierarchy.program_rows(df, "sheet", "n", ["a", "b"], "p", "l").orderBy("n").collect()
    assert [(r.a, r.b, r.p, r.academic_level) for r in got] == [("A", None, "p1", 6), ("B", "b", "p1", 3)]


def test_levels_keep_leading_zeros_and_roll_up(spark):
    df = spark.createDataFrame([("0", "01", "011", "0113", "x"), ("0", "01", "011", "0114", "y"), (None, None, None, None, "z")],
                               "a string, b string, c string, d string, t string")
    levels = [hierarchy.hierarchy_level(df.withColumn("l", F.concat(F.lit("L"), c)), c, "l", i) for i, c in enumerate("abcd", 1)]
    rows = hierarchy.roll_up(levels).orderBy("code_4").collect()
    assert [(r.code_4, r.code_3, r.code_2, r.code_1, r.label_1) for r in rows] == [
        ("0113", "011", "01", "0", "L0"), ("0114", "011", "01", "0", "L0"),
    ]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, None, None), (None, "c", 99.0)], "id int, t string, v double")
    got = df.select("id", filters.missing_fields(["id", "t", "v"]).alias("m"), filters.outcome("id", ["id", "t", "v"]).alias("o"),
                    filters.plausibility(F.col("v"), 10, 50).alias("f")).collect()
    assert [(r.m, r.o, r.f) for r in got] == [
        ([], "complete", "implausible_low"), (["t", "v"], "incomplete", "ok"), (["id"], "failed", "implausible_high"),
    ]
    names = spark.createDataFrame([(1, "100%_ok"), (2, "100 OK"), (3, "x100%_OKx")], "id int, n string")
    assert [r.id for r in filters.containing(names, "n", "100%_ok", "id", ["n"]).collect()] == [3, 1]


def test_profiles_skip_nulls(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("a", None), ("b", None)], "k string, v int")
    assert {(r.column_name, r.missing, r.percent) for r in profile.null_profile(df).collect()} == {("k", 1, 25.0), ("v", 2, 50.0)}
    assert {(r.k, r.rows) for r in profile.key_counts(df, "k").collect()} == {("a", 2), ("b", 1)}
    assert {(r.metric, r.rows) for r in profile.coverage(df, {"k": "k", "v": "v"}, "all").collect()} == {("k", 3), ("v", 2), ("all", 1)}
    variants = repeats.with_variant(spark.createDataFrame([("Técnico superior",), ("otro",), (None,)], "t string"), "t", "TÉCNICO SUPERIOR", "S", "P")
    assert [r.variant for r in variants.collect()] == ["S", "P", None]


def test_values_of_small_keys_are_shuffled_once_and_dropped_keys_stay_out(spark):
    df = spark.range(9000).selectExpr("if(id < 6000, id % 3, id) as k", "if(id % 7 = 0, null, pmod(id * 37, 101) - 50.0d) as v")
    few = df.where("k >= 2000")
    plan = bracketed(few, [["k"]], "v", {0.5: "m"}, {"n": F.count("v")})
    assert exchanges(plan) <= 2  # the values once, the statistics once
    got = bracketed(df, [["k"], []], "v", {0.5: "m"}, {"n": F.count("v")}, having=(F.col("n") == 0) | (F.col("n") > 1) & F.coalesce(F.col("k") != 1, F.lit(True)), accuracy=200)
    values, want = df.toPandas(), {}
    for k, own in values.groupby("k")["v"]:
        n = int(own.count())
        if n != 1 and k != 1:
            want[0, k] = (n, float(own.median()) if n else None)
    want[1, None] = (int(values["v"].count()), float(values["v"].median()))
    assert {(r["_level"], r["k"]): (r["n"], r["m"]) for r in got.collect()} == want

"""Every registered query: agrees with its SQL check, or runs with a stable schema."""

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

ROOT = "/root/testdata/sf0.001"
SLOW = {"topic_top_words", "topic_perplexity", "topic_reload", "cluster_silhouette"}


@pytest.fixture(scope="module")
def con():
    return check.connect(ROOT)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert check.compare(queries()[name](spark, ROOT), con, oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - SLOW))
def test_query_without_sql_runs(spark, name):
    assert queries()[name](spark, ROOT).count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns[0] == "code" and df.count() > 0


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries())

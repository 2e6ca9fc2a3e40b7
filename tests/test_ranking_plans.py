"""Ranking moves no postings by term, splits texts once, and only what can be among the best meets the chunks."""

import contextlib

from memloom.operators import index as ix
from memloom.plans import catalogue, rules
from tests.test_catalogue import DATA, pytestmark as needs_tables


@contextlib.contextmanager
def conf(spark, **values):
    keys = {k.replace("_", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@needs_tables
def test_postings_stay_and_texts_are_split_once(spark):
    with conf(spark, spark_sql_autoBroadcastJoinThreshold="-1", spark_sql_adaptive_enabled="false"):
        for made in (rules.phrase_search(spark, DATA), catalogue.bm25_batch(spark, DATA)):
            text = plan(made)
            assert "SortMergeJoin [term" not in text and "SortMergeJoin [query_id" not in text
            assert text.count("posexplode(concat(") == 1


def test_leading_keeps_ties(spark):
    rows = [("q", f"d{i}", r) for i, r in enumerate([5.0, 4.0, 4.0, 4.0, 3.0, 1.0])] + [("p", "d9", 1.0), (None, "d1", 2.0)]
    table = spark.createDataFrame(rows, "query_id string, id string, rank double")
    assert {(r["query_id"], r["id"]) for r in ix.leading(table, 2).collect()} == {("q", "d0"), ("q", "d1"), ("q", "d2"), ("q", "d3"), ("p", "d9"), (None, "d1")}
    assert "WindowGroupLimit" in plan(ix.leading(table, 2))

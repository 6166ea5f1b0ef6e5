"""Contents are joined and kept once per hash without being sorted for a join, in tasks that do not grow with the table."""

import re

import pytest
from pyspark.sql import functions as F

from treeledger.operators.skew import spread_join
from workload import inputs


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_streamed_join_sorts_no_contents(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        keys, rows = spark.createDataFrame([("a", 1), ("x", 2), (None, 3)], "k string, n int"), spark.createDataFrame([("a", "t"), ("b", "u")], "k string, text string")
        found = spread_join(keys, rows, ["k"], ["n"], "left", stream_right=True)
        assert "SortMergeJoin" not in _plan(found)
        assert {tuple(r) for r in found.collect()} == {("a", 1, "t"), ("x", 2, None), (None, 3, None)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("copies", [2, 10_000])
def test_contents_once_per_hash(spark, monkeypatch, copies):
    monkeypatch.setattr(inputs, "MANY_COPIES", copies)
    rows = spark.createDataFrame([("h", "x")] * 5 + [("g", "y")] * 2 + [("k", "z"), (None, None), (None, None)], "hash string, content string")
    found = inputs.once_per_hash(rows, rows, 100 * inputs.CONTENT_BYTES)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("h", "x"), ("g", "y"), ("k", "z"), (None, None)], key=str)
    # at most one shuffle of the contents that few rows share, to as many tasks as their size asks for
    assert re.search(r"hashpartitioning\(hash#\d+, 100\)", _plan(found))

"""Texts compared in order meet in tasks of a bounded number of pairs, after one join that does not sort contents."""

import re

import pytest
from pyspark.sql import functions as F

from treeledger.operators import lines, skew


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def _pairs(spark, n):
    rows = spark.range(n).select(F.concat(F.lit("b"), "id").alias("base_file_hash"), F.concat(F.lit("t"), "id").alias("target_file_hash"))
    one = rows.select(F.col("base_file_hash").alias("hash"), F.encode(F.lit("a\nb\n"), "UTF-8").alias("content"))
    other = rows.where("target_file_hash <> 't3'").select(F.col("target_file_hash").alias("hash"), F.encode(F.lit("a\nc\n"), "UTF-8").alias("content"))
    return rows, one.unionByName(other)


@pytest.mark.parametrize("most", [0, 500_000])
def test_both_texts(spark, monkeypatch, most):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", most)
    monkeypatch.setattr(lines, "PAIRS_PER_TASK", 2)
    pairs, blobs = _pairs(spark, 20)
    found = lines._both_texts(pairs, blobs)
    assert "SortMergeJoin" not in _plan(found)
    got = {tuple(r) for r in found.collect()}
    assert got == {(f"b{i}", f"t{i}", "a\nb\n", None if i == 3 else "a\nc\n") for i in range(20)}
    # tasks are as many as the pairs ask for
    tasks = re.search(r"hashpartitioning\(base_file_hash#\d+, target_file_hash#\d+, (\d+)\)", _plan(found))
    assert tasks and int(tasks[1]) >= 10

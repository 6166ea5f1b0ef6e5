"""Texts of very many lines lose lines in time that grows with the lines."""

import time

from pyspark.sql import functions as F

from treeledger.llm.line_dedup import without_lines


def test_without_lines(spark):
    rows = [("a\nb\n\nc", [1, 2]), ("a\nb", None), ("a\nb", [0, 1]), ("", [0]), (None, None), ("a\n", [1])]
    docs = spark.createDataFrame(rows, "text string, deleted array<int>")
    got = [r.text for r in docs.select(without_lines(F.col("text"), F.col("deleted")).alias("text")).collect()]
    assert got == ["a\nc", "a\nb", "", "", None, "a"]


def test_long_text(spark):
    lines = [f"line number {i}" for i in range(100_000)]
    docs = spark.createDataFrame([("\n".join(lines), list(range(0, 100_000, 3)))], "text string, deleted array<int>")
    begun = time.perf_counter()
    got = docs.select(without_lines(F.col("text"), F.col("deleted")).alias("text")).first().text
    assert time.perf_counter() - begun < 30
    assert got.split("\n") == [line for i, line in enumerate(lines) if i % 3]

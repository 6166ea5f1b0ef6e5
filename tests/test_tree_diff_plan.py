"""Diffs of commit pairs sort their rows once, after the shuffle."""

from treeledger.operators import trees


def test_rows_are_not_sorted_before_the_shuffle(spark):
    rows = [("c0", "a", "h1"), ("c0", "b", "h2"), ("c0", "b", "h2"), ("c1", "a", "h3"), ("c1", "c", "h4"), ("c1", None, "h5")]
    entries = spark.createDataFrame(rows, "commit_hash string, path string, hash string")
    pairs = spark.createDataFrame([("c0", "c1")], "base_commit_hash string, target_commit_hash string")
    for chosen in (pairs, ("c0", "c1")):
        found = trees.tree_diff(entries, chosen)
        assert {(r.target_path, r.diff_change_type) for r in found.collect()} == {("a", "M"), ("b", "D"), ("c", "A"), (None, "A")}
        plan = found._jdf.queryExecution().executedPlan().toString()
        shuffle = plan.index("REPARTITION_BY_COL")
        assert "Aggregate" in plan[:shuffle] and "Aggregate" not in plan[shuffle:].split("Initial Plan")[0]

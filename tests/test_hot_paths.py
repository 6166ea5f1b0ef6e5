"""Hot keys are looked for in few rows, and found all the same."""

from treeledger.operators import skew, stats


def test_hot_keys_within_hot_groups_only(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_FLOOR", 5)
    rows = [("r1", "p1")] * 6 + [("r1", "p2")] * 2 + [("r2", f"p{k}") for k in range(9)] + [("r3", "p1")] * 4 + [(None, "p1")] * 7
    table = spark.createDataFrame(rows, "run string, path string")
    assert [tuple(r) for r in skew.hot_keys(table, ["run", "path"], within=["run"]).collect()] == [("r1", "p1", 1)]
    few = table.where("run = 'r3'")
    none = skew.hot_keys(few, ["run", "path"], within=["run"])
    assert none.isEmpty() and none.columns == ["run", "path", "_parts"]


def test_authors_over_runs_make_no_table_to_find_hot_runs(spark, monkeypatch):
    looked = []
    monkeypatch.setattr(skew, "hot_keys", lambda *args, **more: looked.append(args) or None)
    commits = spark.createDataFrame([("a", "1", "h1", "ann"), ("a", "1", "h1", "ann"), ("a", "1", "h2", "bob"), ("a", "2", "h1", "ann")], "repo string, run string, hash string, author_name string")
    diffs = spark.createDataFrame([("a", "1", "h1", "x"), ("a", "1", "h2", "y"), ("a", "2", "h1", "x"), ("a", "3", "h9", "z")], "repo string, run string, target_commit_hash string, target_path string")
    groups = spark.createDataFrame([("a", r, g) for r in "123" for g in ("all", f"run {r}")] * 2, "repo string, run string, group string")
    tables = stats.RunTables(groups.select("repo", "run").distinct(), diff_results=diffs, commits=commits)
    assert {tuple(r) for r in stats.unique_authors_over(tables, groups).collect()} == {("all", 2), ("run 1", 2), ("run 2", 1), ("run 3", 0)}
    assert not looked


def test_change_types_take_known_hot_paths(spark, monkeypatch):
    counts = spark.createDataFrame([("a", "1", "x", "h1", 3.0), ("a", "1", "x", "h0", 5.0), ("a", "1", "y", "h1", 1.0)], "repo string, run string, path string, commit_hash string, count double")
    diffs = spark.createDataFrame([("a", "1", "x", "M", "h1")], "repo string, run string, target_path string, diff_change_type string, target_commit_hash string")
    hot = spark.createDataFrame([("a", "1", "x", 3)], "repo string, run string, path string, _parts int")
    rows = {tuple(r) for r in stats.attach_diff_metadata(counts, diffs, hot).collect()}
    assert rows == {("a", "1", "x", "h1", 3.0, "M"), ("a", "1", "y", "h1", 1.0, "")} == {tuple(r) for r in stats.attach_diff_metadata(counts, diffs).collect()}

"""Run manifests, statistics, files and jobs, checked against plain Python on small inputs."""

import json
import os
import random
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from test_functions import reference_report_stack
from treeledger import schemas
from treeledger.functions.paths import ALL_LABEL, DEFAULT_STACKS, SIZE_BINS, UNCATEGORIZED_LABEL
from treeledger.operators import history, stats
from treeledger.plans import jobs
from treeledger.sinks import files as sinks
from treeledger.sources import checkout, run_files
from treeledger.sources.tables import RepoTables, load_repo_catalog, load_repo_tables, save_repo_catalog

RUNS = [
    ("p", "20240103-000000", "snapshot", None),
    ("p", "a-run", "diff", "2024-01-02T00:00:00+00:00Z"),
    ("p", "b-run", "diff", None),
    ("p", "c-run", None, " 2024-01-01T00:00:00 "),
    ("p", "d-run", "other", "nope"),
    ("q", "a-run", "snapshot", "2024-02-01T09:00:00+09:00Z"),
    ("q", "b-run", "diff", "2024-01-05T00:00:00Z"),
]


@pytest.fixture
def runs(spark):
    return history.with_labels(spark.createDataFrame(RUNS, "repo string, run string, run_type string, ended_at string"))


def test_labels_and_order(runs):
    found = {(r.repo, r.run): (r.display_label, r.trend_label) for r in runs.collect()}
    assert found["p", "20240103-000000"] == ("2024-01-03 00:00:00", "2024-01-03")
    assert found["q", "a-run"] == ("2024-02-01 00:00:00", "2024-02-01")
    assert found["p", "d-run"] == ("d-run", "d-run")
    order = [r.run for r in history.chronological(runs).where("repo = 'p'").collect()]
    assert order == ["b-run", "d-run", "c-run", "a-run", "20240103-000000"]


def test_history_limits(spark, runs):
    raw = spark.createDataFrame(RUNS, "repo string, run string, run_type string, ended_at string")
    kept = history.load_history(raw, limit=2).collect()
    assert [(r.repo, r.run) for r in kept] == [("p", "d-run"), ("p", "c-run"), ("q", "b-run"), ("q", "a-run")]
    data = spark.createDataFrame([("p", "d-run", 1), ("p", "b-run", 1), ("q", "a-run", 1)], "repo string, run string, x int")
    kept = history.load_history(raw, limit=2, with_data=data).collect()
    assert [(r.repo, r.run) for r in kept] == [("p", "d-run"), ("q", "a-run")]
    many = spark.createDataFrame([("r", f"{i:04}") for i in range(500)] + [("s", "x")], "repo string, run string")
    newest = sorted(r.run for r in history.newest_runs(many, 70).where("repo = 'r'").collect())
    assert newest == [f"{i:04}" for i in range(430, 500)]
    assert [r.run for r in history.list_runs(runs, "q").collect()] == ["b-run", "a-run"]
    assert [r.repo for r in history.list_repos(runs).collect()] == ["p", "q"]
    assert history.select_runs(runs, "diff", ["a-run"]).count() == 1
    assert history.run_types(runs).count() == 6


def test_manifest_rows(spark):
    start = datetime(2024, 5, 6, 7, 8, 9)
    requests = [("p", "snap", "abcdef0123", "", start), ("p", "diffb", "main", "feature-x", start), ("q", "hist", "", "", start)]
    schema = "project_id string, mode string, base string, target string, started timestamp_ntz"
    made = history.new_runs(spark.createDataFrame(requests, schema))
    assert made.columns == schemas.RUN_MANIFEST.names
    got = [(r.run_id, r.run_type, r.scope_key, r.started_at, r.status) for r in made.collect()]
    assert got == [
        ("snap_20240506-070809-abcdef0", "snapshot", "abcdef0123", "2024-05-06T07:08:09+00:00Z", None),
        ("diffb_20240506-070809-feature", "diff", "main..feature-x", "2024-05-06T07:08:09+00:00Z", None),
        ("hist_20240506-070809-run", "snapshot", "", "2024-05-06T07:08:09+00:00Z", None),
    ]
    done = history.finish_runs(made.limit(1), F.lit(datetime(2024, 5, 6, 8)), F.array(F.lit("data/commits.csv")))
    listed = history.project_runs(done.unionByName(made.where("project_id = 'q'"))).collect()
    assert [(r.status, r.completed_at) for r in listed] == [("success", "2024-05-06T08:00:00+00:00Z"), (None, None)]
    view = {r.id: r for r in history.project_view(made).collect()}
    assert (view["p"].latest_run, view["p"].run_count) == ("snap_20240506-070809-abcdef0", 2)


def test_extra_fields():
    def producer(**context):
        return {"sprint": 1, "run_id": "mine", "none": None, "project": context["project"]}

    fields, warnings = history.extra_fields(producer, schemas.RESERVED_RUN_FIELDS, project="p")
    assert fields == {"sprint": "1", "none": "", "project": "p"} and not warnings
    fields, warnings = history.extra_fields(lambda **c: 1 / 0, (), project="p")
    assert not fields and "division" in warnings[0]
    assert history.extra_fields(None, ()) == ({}, [])


# -- statistics ----------------------------------------------------------------------------------------------------


def random_tables(spark, runs, seed):
    rng = random.Random(seed)
    names = ["config/a.py", "src/b.java", "tests/c.py", "d.md", "e.xml", "f.XML", "g"]
    files, diffs, results, commits = [], [], [], []
    for repo, run, *_ in RUNS:
        if run == "d-run":
            continue
        for name in names:
            if rng.random() < 0.6 and run != "b-run":
                files.append((repo, run, "t", name, None, "h"))
            if rng.random() < 0.6 and run != "20240103-000000":
                letter = rng.choice(["A", "M", "R", "D", "T", None, "m"])
                diffs.append((repo, run, "b", rng.choice(["t", "t", "t2", None]), name, rng.choice([name, "/" + name]), letter))
            for commit in ("b", "t", "t2", None):
                if rng.random() < 0.6:
                    for _ in range(rng.randint(1, 2)):
                        results.append((repo, run, commit, name, "FileCharCount", rng.choice([0, 5, 999, 1000, 2500, 60000, None]), None))
                results.append((repo, run, commit, name, "FileLineCount", 10**6, None))
        commits += [(repo, run, "t", "ann"), (repo, run, "t2", rng.choice(["bob", "ann", None]))]
    frame = spark.createDataFrame
    lead = "repo string, run string, "
    return stats.RunTables(
        runs,
        frame(files, lead + "commit_hash string, path string, tech_stack string, hash string"),
        frame(diffs, lead + "base_commit_hash string, target_commit_hash string, base_path string, target_path string, diff_change_type string"),
        frame(results, lead + "commit_hash string, path string, analyzer_type string, count bigint, content string"),
        frame(commits, lead + "hash string, author_name string"),
    ), files, diffs, results, commits


def in_stack(path, label):
    stack = reference_report_stack(path, DEFAULT_STACKS)
    return label == ALL_LABEL or (stack is None if label == UNCATEGORIZED_LABEL else stack == label)


def plain_bin(value):
    for b in SIZE_BINS:
        if value >= b.lower and (b.upper is None or value < b.upper):
            return b.label
    return SIZE_BINS[-1].label


def plain_distribution(run, kind, diffs, results, label):
    """Size bins of one run, step by step as a person would do it with a spreadsheet."""
    rows = {}
    for repo, name, commit, path, analyzer, count, _ in results:
        if (repo, name) == run and analyzer == "FileCharCount" and count is not None and in_stack(path, label):
            key = (path.replace("\\", "/").strip("/"), commit or "")
            rows[key] = max(rows.get(key, -1), count)
    if not rows:
        return None
    mine = [d for d in diffs if d[:2] == run and in_stack(d[5], label)]
    kept, known = [], False
    for (path, commit), count in rows.items():
        matches = [d for d in mine if d[5].strip("/") == path] if kind == "diff" else []
        if not matches:
            kept.append((path, count, "", commit))
        for d in matches:
            if not d[3] or d[3] == commit:
                kept.append((path, count, (d[6] or "").upper(), commit))
                known = known or bool(d[6])
    best = {}
    for path, count, letter, commit in kept:
        best[path] = max(best.get(path, (-1, "", "")), (count, letter, commit))
    if not best:
        return None
    out = {}
    for b in SIZE_BINS:
        here = [letter for count, letter, _ in best.values() if plain_bin(count) == b.label]
        split = kind == "diff" and known
        out[b.label] = (
            len(here),
            sum(x == "A" for x in here) if split else None,
            sum(x in ("M", "R") for x in here) if split else None,
        )
    return out


@pytest.mark.parametrize("label", [ALL_LABEL, "Python", "XML", UNCATEGORIZED_LABEL])
@pytest.mark.parametrize("seed", [1, 2])
def test_statistics(spark, runs, label, seed):
    tables, files, diffs, results, commits = random_tables(spark, runs, seed)
    found = jobs.statistics_job(tables, stack=label)

    has_files, has_diffs = {f[:2] for f in files}, {d[:2] for d in diffs}
    n_files = Counter(f[:2] for f in files if in_stack(f[3], label))
    n_diffs = Counter(d[:2] for d in diffs if in_stack(d[5], label))
    want = {}
    for repo, run, kind, _ in RUNS:
        key = (repo, run)
        a = n_files[key] if key in has_files else None
        b = n_diffs[key] if key in has_diffs else None
        want[key] = a if kind == "snapshot" else b if kind == "diff" else (a if a is not None else b)
    got = {(r.repo, r.run): r.value for r in found["record_count"].collect()}
    assert got == want

    letters = defaultdict(Counter)
    for d in diffs:
        if in_stack(d[5], label):
            letters[d[:2]][d[6]] += 1
    kinds = {(r[0], r[1]): r[2] for r in RUNS}
    want = {k: (c["A"], c["M"] + c["R"], c["D"]) for k, c in ((k, letters[k]) for k in has_diffs) if kinds[k] == "diff"}
    got = {(r.repo, r.run): (r.added, r.changed, r.deleted) for r in found["diff_change_counts"].collect()}
    assert got == want

    authors = {}
    for key in has_diffs:
        targets = {d[3] for d in diffs if d[:2] == key and in_stack(d[5], label)}
        authors[key] = len({c[3] for c in commits if c[:2] == key and c[2] in targets and c[3]})
    assert {(r.repo, r.run): r.value for r in found["unique_authors"].collect()} == authors

    want = {k: plain_distribution(k, kind, diffs, results, label) for k, kind in kinds.items()}
    got = defaultdict(dict)
    for r in found["char_count_distribution"].collect():
        got[r.repo, r.run][r.range] = (r.total, r.added, r.changed)
    assert got == {k: v for k, v in want.items() if v is not None}


def test_trends(spark, runs):
    tables, *_ = random_tables(spark, runs, 4)
    found = jobs.statistics_job(tables, trend=True, run_type="diff")
    assert set(found) == {"record_count", "diff_change_counts", "unique_authors"}
    assert [(r.repo, r.run) for r in found["record_count"].collect()] == [("p", "a-run"), ("q", "b-run")]
    assert [r.label for r in found["unique_authors"].collect()] == ["b-run", "2024-01-02 00:00:00", "2024-01-05 00:00:00"]
    one = jobs.statistics_job(tables, trend=True, run_type="diff", runs=["a-run"])
    assert one["record_count"].count() == 1


def test_author_column_and_missing_tables(spark, runs):
    diffs = spark.createDataFrame([("p", "a-run", "a.py", "x"), ("p", "a-run", "b.py", "y"), ("p", "a-run", "c", None)], "repo string, run string, target_path string, author string")
    tables = stats.RunTables(runs, diff_results=diffs.withColumn("diff_change_type", F.lit("A")))
    assert [tuple(r) for r in stats.unique_authors(tables).collect()] == [("p", "a-run", 2)]
    assert stats.unique_authors(tables.of_stack("Python")).first().value == 2
    assert set(jobs.statistics_job(tables)) == {"record_count", "diff_change_counts"}
    assert [r.value for r in stats.record_count(stats.RunTables(runs)).collect()] == [None] * 7


def test_registered_statistics(spark, runs):
    class RunCount(stats.Statistic):
        name = "run_count"

        def single(self, tables):
            return tables.runs.groupBy("repo").count()

    stats.register_statistic(RunCount())
    try:
        assert jobs.statistics_job(stats.RunTables(runs))["run_count"].count() == 2
        assert "run_count" not in jobs.statistics_job(stats.RunTables(runs), trend=True)
    finally:
        stats._STATISTICS.pop("run_count")


# -- files ---------------------------------------------------------------------------------------------------------

MESSAGE = ' first "quoted" line\r\nsecond, with comma\\ and backslash\\"\n\n'


def commit_rows(spark, n=1):
    when = datetime(2024, 1, 2, 3, 4, 5, 6000)
    data = [("r", "b", f"h{i}", MESSAGE, "ann", None, when, "", "c@x", None) for i in range(n)]
    return spark.createDataFrame(data, schemas.COMMITS)


def test_csv_layout_and_round_trip(spark, tmp_path):
    base = str(tmp_path)
    path = f"{base}/my project+%20/runs/run 1/data/commits.csv"
    assert sinks.write_csv(commit_rows(spark), path)
    part = next(f for f in os.listdir(path) if f.startswith("part-"))
    with open(f"{path}/{part}", newline="") as file:
        assert file.read().startswith('"repository","branch","hash"')
    row = run_files.read_run_csv(spark, base, "commits").first()
    assert (row.repo, row.run, row.message) == ("my project+%20", "run 1", MESSAGE)
    assert row.author_date == datetime(2024, 1, 2, 3, 4, 5, 6000) and row.author_email is None and row.commit_date is None
    assert run_files.read_run_csv(spark, base, "diff_results") is None
    texts = sinks.stringify(commit_rows(spark)).first()
    assert texts.author_date == "2024-01-02T03:04:05.006000" and texts.author_email == ""


def test_csv_append_and_empty(spark, tmp_path):
    path = f"{tmp_path}/t.csv"
    assert not sinks.write_csv(commit_rows(spark).limit(0), path) and not os.path.exists(path)
    sinks.write_csv(commit_rows(spark, 2), path)
    sinks.write_csv(commit_rows(spark, 3), path, append=True)
    options = dict(header=True, multiLine=True, quote='"', escape='"')
    assert spark.read.options(**options).csv(path).count() == 5
    with pytest.raises(ValueError):
        sinks.write_csv(commit_rows(spark).select("hash", "message"), path, append=True)
    sinks.write_csv(commit_rows(spark, 1), path)
    assert spark.read.options(**options).csv(path).count() == 1


def test_a_single_plain_file_is_read(spark, tmp_path):
    data = tmp_path / "p" / "runs" / "r" / "data"
    data.mkdir(parents=True)
    (data / "analysis_results.csv").write_text('"commit_hash","path","analyzer_type","count","content"\r\n"c","a.py","X","7",""\r\n"c","b.py","X","bad","{""a"": 1}"\r\n')
    rows = run_files.read_run_csv(spark, str(tmp_path), "analysis_results").orderBy("path").collect()
    assert [(r["count"], r.content) for r in rows] == [(7, None), (None, '{"a": 1}')]


def test_manifests(spark, tmp_path):
    good = '{"run_id": "g", "run_type": "diff", "sprint": "S1", "data_files": ["a"]}'
    for run, text in {"good": good, "empty": " ", "none": "", "cut": '{"run_id": "c"'}.items():
        folder = tmp_path / "p" / "runs" / run
        folder.mkdir(parents=True)
        (folder / "run.json").write_text(text)
    (tmp_path / "p" / "project.json").write_text(json.dumps({"id": "p", "latest_run": "g", "runs": [{"run_id": "g", "run_type": "diff"}, {"run_id": "h"}]}))
    found = {r.run: r for r in run_files.read_run_manifest(spark, str(tmp_path)).collect()}
    assert found["good"].run_type == "diff" and found["good"].extra == {"sprint": "S1"}
    assert found["empty"].run_id is None and found["empty"].extra == {}
    assert found["cut"].status is None
    projects = run_files.read_projects(spark, str(tmp_path))
    assert [(r.repo, r.run_id) for r in run_files.project_run_rows(projects).collect()] == [("p", "g"), ("p", "h")]
    assert run_files.read_run_manifest(spark, str(tmp_path / "p")) is None
    table = spark.createDataFrame([("p", "good", "x"), ("p", "none", "y")], "repo string, run string, v string")
    known = run_files.known_runs(run_files.read_run_manifest(spark, str(tmp_path)), {"commits": table})
    assert sorted((r.run, r.run_type) for r in known.collect()) == [("cut", None), ("empty", None), ("good", "diff"), ("none", None)]


def test_load_report(spark):
    commits = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "b")], "repo string, run string")
    report = {(r.run, r.table_name): (r.row_count, r.status) for r in run_files.load_report({"commits": commits, "diff_results": None}).collect()}
    assert len(report) == 8
    assert report["a", "commits"] == (2, "loaded") and report["b", "diff_results"] == (None, "missing")


def test_partitioned_runs(spark, tmp_path):
    rows = spark.createDataFrame([("p", "a b", "c", "x", "N", 1, None), ("q", "z", "c", "y", "N", 2, "{}")], "repo string, run string, commit_hash string, path string, analyzer_type string, count bigint, content string")
    sinks.write_run_parquet(rows, f"{tmp_path}/analysis_results")
    back = run_files.read_run_parquet(spark, str(tmp_path), "analysis_results")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    plan = back.where("run = 'z'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan
    assert run_files.read_run_parquet(spark, str(tmp_path), "commits") is None


def test_uniqueness_and_insert_if_absent(spark):
    rows = spark.createDataFrame([("c", "a", 1), ("c", "b", 2)], "commit_hash string, path string, n int")
    keys = ["commit_hash", "path"]
    sinks.check_unique(rows, keys)
    sinks.check_unique(rows, keys, rows.withColumn("path", F.lit("z")))
    for existing, batch in ((None, rows.union(rows)), (rows, rows)):
        with pytest.raises(ValueError):
            sinks.check_unique(batch, keys, existing)
    stored = commit_rows(spark, 2)
    fresh = sinks.new_commits(commit_rows(spark, 4).union(commit_rows(spark, 4)), stored)
    assert sorted(r.hash for r in fresh.collect()) == ["h2", "h3"] and fresh.columns == schemas.COMMITS.names


def test_result_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS ledger_test")
    try:
        sinks.reset_tables(spark, "ledger_test")
        assert sinks.create_tables(spark, "ledger_test") == []
        spark.sql("DROP TABLE ledger_test.git_commit")
        assert sinks.create_tables(spark, "ledger_test") == ["git_commit"]
        sinks.append_table(commit_rows(spark, 2), "git_commit", "ledger_test")
        sinks.append_table(commit_rows(spark, 3), "git_commit", "ledger_test")
        assert spark.table("ledger_test.git_commit").count() == 3
        results = spark.createDataFrame([("c", "p", "N", 1, None)], schemas.ANALYSIS_RESULTS)
        sinks.append_table(results, "git_analysis_result", "ledger_test")
        with pytest.raises(ValueError):
            sinks.append_table(results, "git_analysis_result", "ledger_test")
        sinks.reset_tables(spark, "ledger_test")
        assert spark.table("ledger_test.git_commit").isEmpty()
    finally:
        spark.sql("DROP DATABASE ledger_test CASCADE")


def test_checkout(spark, tmp_path):
    (tmp_path / ".github").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "HEAD").write_text("x")
    (tmp_path / "a" / "_b").mkdir(parents=True)
    (tmp_path / ".github" / "x.yml").write_bytes(b"hello")
    (tmp_path / "a" / "_b" / "run.sh").write_bytes(b"\x00\xff")
    os.chmod(tmp_path / "a" / "_b" / "run.sh", 0o755)
    os.symlink("a/_b", tmp_path / "link")
    got = {r.path: (r.mode, bytes(r.content), r.hash) for r in checkout.read_tree(spark, str(tmp_path), "c").collect()}
    assert set(got) == {".github/x.yml", "a/_b/run.sh", "link"}
    assert got[".github/x.yml"] == ("100644", b"hello", "b6fc4c620b67d95f953a5c1c1230aaab5db5a1b0")
    assert got["a/_b/run.sh"][:2] == ("100755", b"\x00\xff")
    assert got["link"][:2] == ("120000", b"a/_b")


# -- jobs ----------------------------------------------------------------------------------------------------------


def lake(spark):
    when = datetime(2024, 1, 1)
    commits = [("r", "main", h, f"message {h}", "ann", "a@x", when, "ann", "a@x", when) for h in ("c0", "c1", "c2", "side")]
    trees = [
        ("c0", "config/a.py", "100644", "h1"),
        ("c0", "b.xml", "100644", "h2"),
        ("c1", "config/a.py", "100644", "h3"),
        ("c1", "c.java", "100644", "h4"),
        ("c1", "data/x.py", "100644", "h1"),
        ("c2", "config/a.py", "100644", "h3"),
        ("side", "readme", "100644", "h1"),
    ]
    blobs = [("h1", b"x\n"), ("h2", b"<a><b/></a>"), ("h3", b"x\ny\n"), ("h4", b"class A {}")]
    return RepoTables(
        spark.createDataFrame(commits, schemas.COMMITS),
        spark.createDataFrame([("c1", "c0", 0), ("c2", "c1", 0)], schemas.COMMIT_PARENTS),
        spark.createDataFrame([("r", "main", "c2", True), ("r", "old", "c0", False), ("r", "side", "side", False)], schemas.REFS),
        spark.createDataFrame(trees, schemas.TREE_ENTRIES),
        spark.createDataFrame(blobs, schemas.BLOBS),
    )


def test_snapshot_job(spark, tmp_path):
    results = jobs.snapshot_job(lake(spark), "c1", keep_texts=True)
    run, warnings = jobs.write_run(
        spark,
        results,
        str(tmp_path),
        "proj",
        project_metadata=lambda **c: {"title": "T", "latest_run": "no", "team": "x"},
        run_metadata=lambda **c: {"mode": c["mode"], "run_id": "no", "status": "mine"},
        started=datetime(2024, 1, 1, 10),
    )
    assert run == "snap_20240101-100000-c1" and not warnings
    files = run_files.read_run_csv(spark, str(tmp_path), "commit_files").collect()
    assert sorted((r.path, r.tech_stack) for r in files) == [("c.java", "Java"), ("config/a.py", "Python")]
    analysis = run_files.read_run_csv(spark, str(tmp_path), "analysis_results").collect()
    counts = {(r.path, r.analyzer_type): r["count"] for r in analysis}
    assert counts == {
        ("c.java", "FileLineCount"): 1,
        ("c.java", "FileCharCount"): 10,
        ("c.java", "JavaClassCount"): 1,
        ("config/a.py", "FileLineCount"): 3,
        ("config/a.py", "FileCharCount"): 4,
    }
    detail = next(r.content for r in analysis if r.analyzer_type == "JavaClassCount")
    assert next(iter(json.loads(detail).values())) == {"count": 1, "matches": [["A", "", ""]]}
    manifest = run_files.read_run_manifest(spark, str(tmp_path)).first()
    assert (manifest.run, manifest.status, manifest.run_type, manifest.scope_key) == (run, "success", "snapshot", "c1")
    assert manifest.data_files == ["data/analysis_results.csv", "data/commit_files.csv", "data/commits.csv"]
    assert manifest.extra == {"mode": "snap"}
    project = run_files.read_projects(spark, str(tmp_path)).first()
    assert (project.repo, project.title, project.latest_run) == ("proj", "T", run)
    assert os.path.isdir(tmp_path / "proj" / "runs" / run / "data" / "file_snapshots.csv")


def test_snapshot_checks(spark):
    tables = lake(spark)
    assert jobs.snapshot_job(tables).base == "c2"
    assert jobs.history_job(tables, branch="old").mode == "hist"
    for commit, branch in (("side", "main"), ("c2", "old"), ("nope", "main"), ("c0", "gone")):
        with pytest.raises(ValueError):
            jobs.snapshot_job(tables, commit, branch)


def test_diff_job(spark, tmp_path):
    results = jobs.diff_branch_job(lake(spark), "old", "main")
    run, _ = jobs.write_run(spark, results, str(tmp_path), "proj")
    assert run.startswith("diffb_") and run.endswith("-main")
    diff = run_files.read_run_csv(spark, str(tmp_path), "diff_results").collect()
    assert sorted((r.target_path, r.diff_change_type) for r in diff) == [("b.xml", "D"), ("config/a.py", "M")]
    assert [r.branch for r in run_files.read_run_csv(spark, str(tmp_path), "commits").orderBy("hash").collect()] == ["old", "main"]
    analysis = run_files.read_run_csv(spark, str(tmp_path), "analysis_results").collect()
    counts = {(r.commit_hash, r.path, r.analyzer_type): r["count"] for r in analysis}
    assert counts["c0", "b.xml", "XMLElementCount"] == 2 and counts["c2", "b.xml", "XMLElementCount"] == 0
    assert counts["c0", "config/a.py", "FileCharCount"] == 2 and counts["c2", "config/a.py", "FileCharCount"] == 4
    assert len(counts) == 10
    empty, _ = jobs.write_run(spark, jobs.diff_job(lake(spark), "c1", "c1"), str(tmp_path), "other")
    assert run_files.read_run_csv(spark, f"{tmp_path}/none", "diff_results") is None
    assert not os.path.exists(tmp_path / "other" / "runs" / empty / "data" / "diff_results.csv")


def test_many_pairs_in_one_job(spark):
    pairs = spark.createDataFrame([("c0", "c1", "r1"), ("c0", "c2", "r2")], "base_commit_hash string, target_commit_hash string, run string")
    diff, analysis = jobs.diff_tables(lake(spark), pairs, jobs.Settings())
    assert Counter(r.run for r in diff.collect()) == {"r1": 3, "r2": 2}
    one = jobs.diff_tables(lake(spark), ("c0", "c2"), jobs.Settings())[1].drop("run")
    assert analysis.where("run = 'r2'").drop("run").exceptAll(one).isEmpty() and one.count() == 10
    files, rows = jobs.snapshot_tables(lake(spark), ["c0", "c1", "side"], jobs.Settings())
    assert files.count() == 5 and rows.select("commit_hash").distinct().count() == 2


def test_unknown_analyzers_are_skipped(spark):
    rules = (*jobs.DEFAULT_ANALYZERS, jobs.AnalyzerRule("Ghost", "GhostAnalyzer", ("All",)))
    settings = jobs.Settings(analyzers=rules)
    assert settings.skipped_analyzers() == ["Ghost"] and len(settings.bound()) == 4


def test_repo_tables(spark, tmp_path):
    tables = lake(spark)
    for name in ("commits", "commit_parents", "refs", "tree_entries", "blobs"):
        getattr(tables, name).write.parquet(f"{tmp_path}/{name}")
    assert load_repo_tables(spark, str(tmp_path)).tree_entries.count() == 7
    spark.sql("CREATE DATABASE IF NOT EXISTS lake_test")
    try:
        save_repo_catalog(tables, "lake_test", 4)
        stored = load_repo_catalog(spark, "lake_test")
        _, analysis = jobs.snapshot_tables(stored, ["c1"], jobs.Settings())
        assert analysis.count() == 5
    finally:
        spark.sql("DROP DATABASE lake_test CASCADE")

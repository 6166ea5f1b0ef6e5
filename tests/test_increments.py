"""Statistics brought up run by run against statistics over all runs at once, and run tables of many layouts."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from treeledger import schemas
from treeledger.operators import history, stats
from treeledger.plans import increments, jobs
from treeledger.sinks import files as sinks
from treeledger.sources import run_files


def diffs(spark, run, n, author="ann"):
    schema = "base_commit_hash string, target_commit_hash string, target_path string, diff_change_type string, author string"
    rows = [("b", f"t{i % 3}", f"src/{run}{i}.py", "AMD"[i % 3], f"{author}{i % 4}") for i in range(n)]
    return spark.createDataFrame(rows, schema)


def put_run(spark, base, run, n, append=False, author="ann"):
    sinks.write_csv(diffs(spark, f"{run}{author}", n, author), f"{base}/p/runs/{run}/data/diff_results.csv", append=append)
    os.makedirs(f"{base}/p/runs/{run}", exist_ok=True)
    with open(f"{base}/p/runs/{run}/run.json", "w") as file:
        file.write('{"run_type": "diff", "ended_at": "2024-01-0%dT10:00:00Z"}' % n)


def at_once(spark, base):
    table = run_files.read_run_csv(spark, base, "diff_results")
    runs = history.with_labels(run_files.known_runs(run_files.read_run_manifest(spark, base), {"d": table}))
    return stats.RunTables(runs, diff_results=table)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


CHOSEN = {s.name: s for s in (stats.RecordCountStatistic(), stats.DiffFileChangeCountStatistic())}


class Authors(stats.Statistic):
    name = "authors"
    needs = ("diff_results",)

    def single(self, tables):
        return stats.unique_authors(tables)


def same(spark, base, store, statistics):
    tables = at_once(spark, base)
    for name, table in jobs.statistics_job(tables, statistics=statistics).items():
        assert rows(increments.stored_statistic(spark, store, name).select(*table.columns)) == rows(table)


def test_new_changed_and_gone_runs(spark, tmp_path, monkeypatch):
    base, store = f"{tmp_path}/base", f"{tmp_path}/store"
    assert set(increments.update_statistics(spark, base, store, statistics=CHOSEN).values()) == {0}
    assert increments.stored_statistic(spark, store, "record_count") is None
    for run, n in (("r 1", 3), ("r+2", 5), ("r[3]", 4)):
        put_run(spark, base, run, n)
    assert set(increments.update_statistics(spark, base, store, statistics=CHOSEN).values()) == {3}
    same(spark, base, store, CHOSEN)
    assert set(increments.update_statistics(spark, base, store, statistics=CHOSEN).values()) == {0}

    put_run(spark, base, "r[3]", 7, append=True, author="bob")
    put_run(spark, base, "r4", 2)
    chosen = {**CHOSEN, "authors": Authors()}
    opened = []
    read = run_files.read_run_csv
    monkeypatch.setattr(run_files, "read_run_csv", lambda *a, **k: opened.append(k["runs"]) or read(*a, **k))
    counts = increments.update_statistics(spark, base, store, statistics=chosen)
    monkeypatch.undo()
    assert counts == {"runs": 2, "record_count": 2, "diff_change_counts": 2, "authors": 4}
    assert sorted(opened[0]) == [("p", "r4"), ("p", "r[3]")]
    same(spark, base, store, chosen)

    os.rename(f"{base}/p/runs/r+2", f"{tmp_path}/away")
    assert set(increments.update_statistics(spark, base, store, statistics=chosen).values()) == {1}
    same(spark, base, store, chosen)
    os.rename(f"{tmp_path}/away", f"{base}/p/runs/r+2")
    assert set(increments.update_statistics(spark, base, store, statistics=chosen).values()) == {1}
    same(spark, base, store, chosen)
    for name in CHOSEN:
        trend = increments.stored_trend(spark, store, CHOSEN[name], "diff")
        assert trend.collect() == CHOSEN[name].trend(at_once(spark, base)).collect()
        assert trend.first().timestamp == datetime(2024, 1, 2, 10)


def test_a_table_that_several_statistics_need_is_read_once(spark, tmp_path, monkeypatch):
    base, store = f"{tmp_path}/base", f"{tmp_path}/store"
    plans = []

    class Watched(Authors):
        def single(self, tables):
            plans.append(tables.diff_results._jdf.queryExecution().optimizedPlan().toString())
            return super().single(tables)

    chosen = {"diff_change_counts": stats.DiffFileChangeCountStatistic(), "authors": Watched()}
    for n, named_runs in ((3, 20_000), (4, 0)):
        monkeypatch.setattr(increments, "NAMED_RUNS", named_runs)
        put_run(spark, base, "r1", n, append=True)
        increments.update_statistics(spark, base, store, statistics=chosen)
    assert len(plans) == 2 and all("parquet" in plan and "csv" not in plan for plan in plans)
    same(spark, base, store, {**chosen, "authors": Authors()})


def test_a_job_that_ends_early_counts_nothing_twice(spark, tmp_path, monkeypatch):
    base, store = f"{tmp_path}/base", f"{tmp_path}/store"
    chosen = {"record_count": CHOSEN["record_count"]}
    put_run(spark, base, "a", 3)
    increments.update_statistics(spark, base, store, statistics=chosen)
    put_run(spark, base, "b", 5)
    # rows of the next batch without a ledger, and then with only a part of it
    half = spark.createDataFrame([("p", "a", 99), ("p", "b", 99)], "repo string, run string, value bigint")
    half.write.parquet(f"{store}/record_count/rows/batch=2")
    assert rows(increments.stored_statistic(spark, store, "record_count")) == [("p", "a", 3)]
    part = spark.createDataFrame([("p", "a", "x", 2)], "repo string, run string, state string, size bigint")
    part.write.parquet(f"{store}/record_count/ledger/batch=2")
    assert rows(increments.stored_statistic(spark, store, "record_count")) == [("p", "a", 3)]
    assert increments.update_statistics(spark, base, store, statistics=chosen)["record_count"] == 1
    same(spark, base, store, chosen)
    monkeypatch.setattr(increments, "NAMED_RUNS", 0)
    put_run(spark, base, "c", 4)
    put_run(spark, base, "b", 2, append=True, author="cat")
    assert increments.update_statistics(spark, base, store, statistics=chosen)["record_count"] == 2
    same(spark, base, store, chosen)


class Unfit(stats.Statistic):
    name = "unfit"
    needs = ("diff_results",)

    def __init__(self, column):
        self.column = column

    def single(self, tables):
        return tables.diff_results.groupBy("repo", "run").agg(F.max(self.column).alias("value"))


def test_an_unfit_statistic_is_tried_again(spark, tmp_path):
    base, store = f"{tmp_path}/base", f"{tmp_path}/store"
    put_run(spark, base, "a", 3)
    with pytest.warns(UserWarning, match="unfit"):
        assert increments.update_statistics(spark, base, store, statistics={"unfit": Unfit("nowhere")})["unfit"] == 0
    assert increments.update_statistics(spark, base, store, statistics={"unfit": Unfit("author")})["unfit"] == 1
    # the first run with commits: runs without any count as they do over all runs
    chosen = {"unique_authors": stats.UniqueAuthorsStatistic()}
    assert increments.update_statistics(spark, base, store, statistics=chosen)["unique_authors"] == 1
    assert increments.stored_statistic(spark, store, "unique_authors") is None
    commits = spark.createDataFrame([("c", "m", "ann")], "hash string, message string, author_name string")
    put_run(spark, base, "b", 2)
    sinks.write_csv(commits, f"{base}/p/runs/b/data/commits.csv")
    assert increments.update_statistics(spark, base, store, statistics=chosen)["unique_authors"] == 2
    assert rows(increments.stored_statistic(spark, store, "unique_authors")) == [("p", "a", 3), ("p", "b", 2)]


@pytest.mark.parametrize("multi_line", [True, False])
def test_many_layouts_in_one_scan(spark, tmp_path, multi_line):
    standard = schemas.ANALYSIS_RESULTS.names
    expected = []
    for k in range(60):
        names = standard[k % 5 :] + standard[: k % 5] + [f"own{k}"]
        if k % 7 == 0:
            names.remove("content")
        values = {"commit_hash": "c", "path": f"f{k}", "analyzer_type": "X", "count": "bad" if k == 9 else str(k), "content": 'a "q", b'}
        data = tmp_path / "p" / "runs" / f"r{k}" / "data"
        data.mkdir(parents=True)
        cells = [values.get(n, f"v{k}").replace('"', '""') for n in names]
        text = "\ufeff" * (k % 2) + ",".join(names) + "\n" + ",".join(f'"{c}"' for c in cells) + "\n"
        (data / "analysis_results.csv").write_text(text, encoding="utf-8")
        expected.append((f"r{k}", f"f{k}", None if k == 9 else k, None if k % 7 == 0 else 'a "q", b', f"v{k}"))
    back = run_files.read_run_csv(spark, str(tmp_path), "analysis_results", multi_line)
    own = [f"own{k}" for k in range(60)]
    found = [(r.run, r.path, r["count"], r.content, [r[c] for c in own if r[c] is not None]) for r in back.collect()]
    assert sorted(found) == sorted((*row[:4], [row[4]]) for row in expected)
    assert back._jdf.queryExecution().optimizedPlan().toString().count("] csv") == 1
    some = run_files.read_run_csv(spark, str(tmp_path), "analysis_results", runs=[("p", "r3"), ("p", "r4")])
    assert sorted(r.path for r in some.collect()) == ["f3", "f4"] and len(some.inputFiles()) >= 2


def test_parquet_by_buckets(spark, tmp_path):
    schema = "repo string, run string, commit_hash string, path string, analyzer_type string, count bigint, content string"
    rows = [("p", f"r{i % 50}", "c", f"f{i}", "X", i, None) for i in range(500)]
    df = spark.createDataFrame(rows, schema)
    sinks.write_run_parquet(df, f"{tmp_path}/analysis_results", buckets=4)
    assert sorted(d for d in os.listdir(f"{tmp_path}/analysis_results") if "=" in d) == [f"bucket={b}" for b in range(4)]
    back = run_files.read_run_parquet(spark, str(tmp_path), "analysis_results")
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(rows)

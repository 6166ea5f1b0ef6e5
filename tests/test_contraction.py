"""Forests made smaller in rounds give the chains and ancestors that following every link gives."""

import random

import pytest

from treeledger.operators import lineage, skew


def furthest(parents):
    best = {n: (0, n) for n in parents}
    for n in parents:
        at, steps = n, 0
        while (at := parents[at]) is not None:
            steps += 1
            best[at] = max(best[at], (steps, n))
    return best


@pytest.mark.parametrize("reach", [1, 4, 300])
def test_furthest_above(spark, monkeypatch, reach):
    monkeypatch.setattr(lineage, "PLAIN_NODES", 3)
    rng = random.Random(reach)
    parents = {n: None if n in (0, 150) else max(0, n - rng.randint(1, reach)) for n in range(300)}
    start = spark.createDataFrame(list(parents.items()), "node bigint, first bigint")
    found = lineage._furthest_above(start).collect()
    assert len(found) == 300 and {r.node: (r.above, r.last) for r in found} == furthest(parents)


def test_rounds_leave_a_fraction_of_a_long_line(spark):
    forest = spark.range(1000).selectExpr(
        "id AS node", "IF(id > 0, id - 1, NULL) AS parent", "1L AS steps", "0L AS above", "id AS last",
        "IF(id < 999, 1L, 0L) AS kids", "IF(id < 999, id + 1, 0L) AS kid", "IF(id < 999, 1L, 0L) AS kid_steps",
    )
    for turn in range(3):
        before = forest.count()
        forest = lineage._contracted(forest, turn).where("NOT done").drop("done").localCheckpoint()
        assert forest.count() < 0.8 * before


def test_ancestors_over_many_chains(spark, monkeypatch):
    """Every third commit of a line starts a side line from which the next one goes on, so ways lead over many chains."""
    monkeypatch.setattr(lineage, "PLAIN_NODES", 5)
    parents, tip = {}, 0
    for k in range(12):
        line = [tip, *range(100 * (k + 1), 100 * (k + 1) + 60 - 5 * k)]
        parents.update(zip(line[1:], line, strict=False))
        tip = line[3]
    index = lineage.index_history(spark.createDataFrame([(f"n{c}", f"n{p}") for c, p in parents.items()], "child string, parent string"))
    asked = [(f"n{c}", s) for c in parents for s in (0, 1, 2, 5, 17, 36, 90)]
    expected = {}
    for name, steps in asked:
        at = int(name[1:])
        for _ in range(steps):
            at = parents.get(at)
        expected[name, steps] = None if at is None else f"n{at}"
    specs = spark.createDataFrame(asked, "hash string, steps int")
    assert len(index.lifts) == 2
    assert {(r.hash, r.steps): r.ancestor for r in lineage.ancestors(None, specs, index).collect()} == expected
    monkeypatch.setattr(lineage, "HOT_FLOOR", 1)
    monkeypatch.setattr(skew, "HOT_FLOOR", 5)
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 2)
    assert {(r.hash, r.steps): r.ancestor for r in lineage.ancestors(None, specs, index).collect()} == expected
    assert [t.count() for t in index.jumps][:1] == [len(parents)]

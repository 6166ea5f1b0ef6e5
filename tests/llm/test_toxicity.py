import random

import numpy as np
import pytest

from treeledger.llm import toxicity

DOCS = "doc_id long, text string, grade int, severity string, features string"
LABELS = "doc_id long, grade int, text string"


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(500)]
    bad = ["zzbad", "zzworse", "zzawful"]
    rows, labels = [], []
    for k in range(1600):
        text = rng.choices(words, k=rng.randint(5, 60))
        grade = rng.choice([0, 0, 0, 1, 2])
        for _ in range([0, 1, 3][grade]):
            text[rng.randrange(len(text))] = rng.choice(bad)
        if grade:
            text.append(bad[0])
        rows.append((k, " ".join(text), 1, "x", "y"))
        if k < 1000:
            labels.append((k, grade, "t"))
    truth = {r[0]: any(w in bad for w in r[1].split()) for r in rows}
    rows += [(None, "ZZBAD!", None, None, None), (5000, None, None, None, None), (5001, "", 0, "", ""), rows[0], rows[0]]
    labels += [(None, 1, ""), (3, None, ""), (7, 9, ""), (99999, 1, ""), labels[0]]
    return rows, labels, truth


@pytest.mark.parametrize("split", [False, True])
def test_held_out_accuracy(spark, tables, split):
    rows, labels, truth = tables
    if split:
        labels = [(i, None if g is None else min(g, 1), t) for i, g, t in labels]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    model = toxicity.fit(docs, spark.createDataFrame(labels, LABELS), 3, limit=300, split_by_evidence=split)
    assert (np.diff(model.thresholds) > 0).all()
    out = toxicity.predict(docs, model).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.doc_id is not None and 1000 <= r.doc_id < 1600]
    assert sum(r.toxic == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.severity <= 2 and r.toxic == (r.p_toxic >= 0.5) for r in out)
    mean = lambda least, most: np.mean([r.severity for r in held if least <= bad_words(rows, r) <= most])
    assert mean(0, 0) < 0.2 < mean(1, 2) < mean(4, 9)
    by_id = {r.doc_id: r for r in out}
    assert by_id[None].toxic and not by_id[5000].toxic and by_id[5000].severity == by_id[5001].severity


def bad_words(rows, r):
    return sum(w.startswith("zz") for w in rows[r.doc_id][1].split())


def test_nothing_to_learn_from(spark, tables):
    docs = spark.createDataFrame(tables[0], DOCS)
    for labels in ([], [(1, 0, ""), (2, 0, "")], [(1, 1, "")]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, LABELS), 3)
        assert {r.toxic for r in toxicity.predict(docs, model).collect()} == {False}
    assert toxicity.predict(docs.where("false"), model).count() == 0


def test_gradient_steps_reach_a_good_likelihood():
    rng = np.random.default_rng(0)
    rows = [sorted(set(rng.integers(0, 20, 5).tolist())) for _ in range(500)]
    true = rng.standard_normal(20) * 2
    score = np.array([true[r].sum() for r in rows])
    grades = (score > 0).astype(int) + (score > 3)
    weights, thresholds = toxicity.fit_ordinal(rows, grades, np.ones(500), 20, 3)
    above = toxicity.link(np.array([weights[r].sum() for r in rows]), thresholds)
    assert ((above > 0.5).sum(1) == grades).mean() > 0.95

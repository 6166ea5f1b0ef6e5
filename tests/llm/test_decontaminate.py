import random

import numpy as np
import pytest

from treeledger.llm import decontaminate

SCHEMA = "doc_id long, text string, item_id string, coverage int, doc string"
ITEMS = "item_id long, text string, doc_id int, seeds string"


def plain_tiles(doc, item, least):
    """Greedy string tiling by comparing all positions, round by round."""
    least = min(least, len(item))
    used_d, used_i, total = set(), set(), 0
    while least:
        best, at = least - 1, []
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while j + n < len(item) and i + n < len(doc) and item[j + n] == doc[i + n] and j + n not in used_i and i + n not in used_d:
                    n += 1
                if n > best:
                    best, at = n, []
                if n == best and n >= least:
                    at.append((j, i))
        if not at:
            return total
        for j, i in at:
            if not used_i & set(range(j, j + best)) and not used_d & set(range(i, i + best)):
                used_i |= set(range(j, j + best))
                used_d |= set(range(i, i + best))
                total += best
    return total


@pytest.mark.parametrize("seed", range(6))
def test_tiles_against_plain_tiling(seed):
    rng = random.Random(seed)
    for _ in range(40):
        item = [rng.randrange(6) for _ in range(rng.randint(0, 14))]
        doc = [rng.randrange(6) for _ in range(rng.randint(0, 40))] + item[5:] + [9] + item[:6]
        got = sum(n for _, _, n in decontaminate.tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 3))
        assert got == plain_tiles(doc, item, 3)


def sample():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 40))), 1, "s") for k in range(25)]
    items += [(100, None, 1, ""), (101, "", 1, ""), (None, "w1 w2 w3 w4 w5 w6", 1, ""), items[3], (102, items[5][1], 1, "")]
    rows = []
    for k in range(80):
        text = rng.choices(words, k=rng.randint(0, 120))
        if k % 3 == 0:
            part = items[rng.randrange(25)][1].split()
            half = len(part) // 2
            part = [part, part[half:] + ["x"] + part[:half], part[: len(part) // 3]][k % 9 // 3]
            text[5:5] = [w.upper() + "," for w in part]
        rows.append((10**15 + k, " ".join(text), "i", 1, "d"))
    rows += [(1, None, None, None, None), (2, "", "", 0, ""), (None, items[7][1], "", 0, ""), rows[0], rows[0]]
    return rows, items


@pytest.mark.parametrize("most_sent", [10**6, 0])
def test_against_brute_force(spark, most_sent, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_SENT", most_sent)
    rows, items = sample()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = decontaminate.contamination(frame, spark.createDataFrame(items, ITEMS)).collect()
    assert len(out) == len(rows)
    texts = {r[0]: decontaminate.words_of(r[1] or "") for r in rows}
    asked = {i[0]: decontaminate.words_of(i[1] or "") for i in items if i[0] is not None}
    for r in out:
        found = [(-plain_tiles(texts[r.doc_id], w, 5) / len(w), k) for k, w in asked.items() if w]
        found = [f for f in found if f[0]]
        coverage, item = min(found, default=(0, None))
        assert (r.item_id, pytest.approx(r.coverage)) == (item, -coverage), r
        assert r.contaminated == (-coverage >= 0.5) and r.n_items == sum(-c >= 0.5 for c, _ in found)
    assert {r.contaminated for r in out} == {True, False}


def test_empty_tables(spark):
    rows, items = sample()
    none = spark.createDataFrame([], SCHEMA)
    assert decontaminate.contamination(none, spark.createDataFrame(items, ITEMS)).count() == 0
    out = decontaminate.contamination(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], ITEMS)).collect()
    assert len(out) == len(rows) and not any(r.contaminated for r in out)

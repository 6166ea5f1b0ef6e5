import random

import pytest

from treeledger.llm import near_dup
from treeledger.llm.common import components

SCHEMA = "doc_id long, text string, id string, tokens int, part string"
NO_ID = -(2**63)


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(rows):
    sets = {NO_ID if r[0] is None else r[0]: shingles(r[1]) for r in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: (len(sets[k]), find(k), find(k) == k) for k in ids}


def sample(seed):
    rng = random.Random(seed)
    words = [f"W{k}" for k in range(300)]
    common = rng.choices(words, k=20)
    rows, ids = [], iter(rng.sample(range(10**15, 10**15 + 10**6), 1000))
    for size in (1, 1, 2, 3, 40, 5, 1, 1, 25, 2, 60):
        base = rng.choices(words, k=rng.randint(30, 160)) + (common if rng.random() < 0.6 else [])
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 50))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            text = rng.choice([" ", "\n"]).join(copy)
            rows.append((next(ids), rng.choice([text, text.lower()]), "x", 1, "y"))
    rows += [(next(ids), " ".join(rng.choices(words, k=30) + common), "", 0, "") for _ in range(80)]
    rows += [(5, "a b", None, None, None), (6, "A  b", None, None, None), (7, "b a", None, None, None), (8, "one two three four Five", "", 0, "")]
    rows += [(9, None, None, None, None), (10, "", "", 0, ""), (11, " \n", "", 0, ""), (None, rows[3][1], None, None, None), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("seed", [1])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL_WORK", 40)
    rows = sample(seed)
    expected = brute(rows)
    out = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(out) == len(rows)
    for r in out:
        key, part = (NO_ID if v is None else v for v in (r.doc_id, r.component_id))
        assert (r.n_shingles, part, r.kept) == expected[key], r


def test_empty_table(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(200, k) for k in range(201, 260)] + [(7, 7), (None, 3)]
    out = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "test").collect()}
    assert all(out[k] == 0 for k in range(1, 61)) and all(out[k] == 200 for k in range(201, 260))

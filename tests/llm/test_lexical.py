import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from treeledger.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, item_id long, score string, n int"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    found = [(doc_id, terms(text)) for doc_id, text, *_ in docs]
    n_docs, n_terms = sum(1 for _, t in found if t), sum(len(t) for _, t in found)
    df = Counter(t for _, words in found for t in set(words))
    wanted = {}
    for item_id, text in items:
        wanted.setdefault(item_id, set()).update(terms(text))
    out = set()
    for item_id, words in wanted.items():
        scored = []
        for doc_id, own in found:
            tf = Counter(own)
            m = 100 - 50 + (50 * len(own) * n_docs) // max(1, n_terms)
            score = 0
            for t in words & set(own):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.add((item_id, rank, doc_id, -score))
    return out


def sample(seed):
    rng = random.Random(seed)
    words = ["the", "The", "ein", "é", "中文", "x1", "É", "_", "a-b", "ſ"] + [f"w{k}" for k in range(120)]
    weights = [40, 30, 20, 10, 5, 5, 3, 3, 2, 2] + [100 / (k + 3) for k in range(120)]

    def text(size):
        return rng.choice([" ", "\n", ", ", "\x00"]).join(rng.choices(words, weights, k=size))

    docs = [(i, text(int(rng.paretovariate(0.7)) % 300 + 1), i, "", 0) for i in rng.sample(range(10**12), 400)]
    docs += [(10**13 + k, "w5 w6 the", 0, "", 0) for k in range(60)] + [(None, "w5 w6 the", 0, "", 0), (7, None, 0, "", 0), (8, "-- !", 0, "", 0)]
    docs += [(5, docs[0][1], 0, "", 0)] * 3
    items = [(k, text(rng.randint(1, 40))) for k in range(25)] + [(90, None), (91, "the"), (92, "unknownword"), (None, "w5 w6"), (3, text(5)), (3, text(5))]
    return docs, items


@pytest.mark.parametrize(("seed", "per_lists", "read"), [(1, 8192, 1), (2, 64, 8)])
def test_against_all_scores(spark, seed, per_lists, read, monkeypatch):
    monkeypatch.setattr(lexical, "DOCS_PER_LISTS", per_lists)
    monkeypatch.setattr(lexical, "FIRST_READ", read)
    monkeypatch.setattr(lexical, "ITEMS_PER_BLOCK", 12)
    docs, items = sample(seed)
    found = lexical.search(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string"), 7)
    out = [tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()]
    assert len(out) == len(set(out)) or seed  # repeated rows tie in everything but their rank
    assert set(out) == brute(docs, items, 7)


def test_stops_before_the_end():
    """Once the kth score is strictly above what unmet documents can reach, lists are not read on."""
    rng = np.random.default_rng(5)
    count, width = 4000, 3
    docs = np.repeat(np.arange(count), width)
    terms_ = np.tile(np.arange(width), count)
    impacts = rng.integers(1, 100, count * width)
    impacts[docs < 10] = 1000
    lists = lexical.ImpactLists.build(count, width, docs, terms_, impacts)
    found, scores, seen = lists.search(np.arange(width), 10, 0)
    assert set(found[np.argsort(-scores)[:10]].tolist()) == set(range(10)) and seen < 200
    # A tie with the kth score is read to its end.
    tied = lexical.ImpactLists.build(count, 1, np.arange(count), np.zeros(count, int), np.full(count, 5))
    assert len(tied.search(np.array([0]), 10, 0)[0]) == count


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs, some).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "a b", 0, "", 0)], SCHEMA), items).count() == 0

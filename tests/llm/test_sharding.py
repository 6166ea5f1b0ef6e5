import random
import zlib
from itertools import accumulate

import pytest

from treeledger.llm import sharding
from treeledger.llm.sharding import Block, Blocks

SCHEMA = "doc_id long, text string, shard string, size int, number long"


def ordered_groups(rows):
    """(sum of sizes, rows) of groups of equal texts, by their smallest id; ties are only among sizes that the test does not tell apart."""
    groups = {}
    for doc_id, text, *_ in rows:
        first, size, count = groups.get(text or "", (None, 0, 0))
        ids = [x for x in (first, doc_id) if x is not None]
        groups[text or ""] = (min(ids, default=None), size + len((text or "").encode()) + 1, count + 1)
    found = sorted(groups.values(), key=lambda g: (g[0] is not None, g[0] or 0))
    return [(size, count) for _, size, count in found]


def least_capacity(sizes, shards):
    """By dynamic programming over all cuts."""
    sums = [0, *accumulate(sizes)]
    best = sums[:]
    for _ in range(shards - 1):
        best = [min(max(best[i], sums[j] - sums[i]) for i in range(j + 1)) for j in range(len(sums))]
    return best[-1]


def sample(seed, count, hot):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("ab é\n", k=int(rng.paretovariate(0.8)) % 400)) for _ in range(count)]
    texts += ["the same text " * 3] * hot
    rng.shuffle(texts)
    ids = rng.sample(range(-(10**15), 10**15), len(texts))
    return [(i, t, "x", 1, None) for i, t in zip(ids, texts, strict=True)]


@pytest.mark.parametrize(("seed", "count", "hot", "shards"), [(1, 150, 0, 8), (2, 120, 80, 8), (3, 5, 0, 8), (4, 90, 30, 3)])
def test_against_all_cuts(spark, seed, count, hot, shards, monkeypatch):
    monkeypatch.setattr(sharding, "SPLIT_BITS", 2)
    monkeypatch.setattr(sharding, "SPLIT_BLOCKS", 3)
    rows = sample(seed, count, hot)
    out = sharding.shard(spark.createDataFrame(rows, SCHEMA).repartition(5), shards).collect()
    texts = {r[0]: r[1] for r in rows}
    assert sorted(r.doc_id for r in out) == sorted(texts)
    filled, of_text = {}, {}
    for r in out:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        filled.setdefault(r.shard, []).append(r)
        assert of_text.setdefault(texts[r.doc_id], r.shard) == r.shard
    for members in filled.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    assert set(filled) <= set(range(shards))
    sizes = [size for size, _ in ordered_groups(rows)]
    assert max(sum(r["size"] for r in members) for members in filled.values()) == least_capacity(sizes, shards)
    # Shards follow the order of the groups' smallest ids.
    first = {}
    for doc_id, text in texts.items():
        first[text] = min(first.get(text, doc_id), doc_id)
    in_order = [of_text[t] for t in sorted(first, key=first.get)]
    assert in_order == sorted(in_order)


def test_defined_cases(spark):
    rows = [(None, None, None, None, None), (3, "", "", 0, None), (3, "", "", 0, None), (None, "x", None, None, None), (1, "y" * 100_000, "", 0, None)]
    out = sharding.shard(spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert sorted((r.doc_id or 0, r["size"]) for r in out) == [(0, 1), (0, 2), (1, 100_001), (3, 1), (3, 1)]
    assert len({(r.shard, r.slot) for r in out}) == 5
    assert len({r.shard for r in out if r["size"] == 1}) == 1
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0


def test_even_cuts_beside_a_large_group():
    """A group larger than an even part sets the capacity; the other shards share the rest."""
    sizes = [10] * 40 + [300] + [10] * 30
    known = Blocks([Block(0, k, 1, 1, size) for k, size in enumerate(sizes)])
    capacity = known.capacity(8, False)
    cuts, unknown = known.even_cuts(capacity, 8)
    parts = [b - a for a, b in zip([0, *cuts], [*cuts, sum(sizes)], strict=True)]
    assert capacity == 300 and not unknown and max(parts) == 300 and min(parts) >= 30 and len(parts) == 8

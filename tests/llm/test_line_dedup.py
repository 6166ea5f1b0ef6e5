import random

import pytest

from treeledger.llm import line_dedup

SCHEMA = "doc_id long, text string, keys string, first int, partners string"
NO_ID = -(2**63)


def brute(rows):
    """Every later document against every earlier one that holds the first copy of a rare line of it."""
    texts = {NO_ID if r[0] is None else r[0]: r[1] or "" for r in rows}
    lines = {k: [x.strip() for x in t.split("\n")] for k, t in texts.items()}
    holders = {}
    for k in sorted(lines):
        for line in {x for x in lines[k] if len(x) >= line_dedup.LEAST_LINE}:
            holders.setdefault(line, []).append(k)
    out = {}
    for k, own in lines.items():
        shared = {x: holders[x] for x in own if len(holders.get(x, ())) > 1 and holders[x][0] < k}
        least = min((len(h) for h in shared.values()), default=0)
        deleted, partners = set(), set()
        for first in {h[0] for h in shared.values() if len(h) <= line_dedup.RARE or len(h) == least}:
            numbers = {x: n + 1 for n, x in enumerate({x for x in own + lines[first] if x})}
            as_keys = [[numbers.get(x, 0) for x in side] for side in (lines[first], own)]
            gone = line_dedup.common_blocks(*as_keys, [len(x) for x in own])
            if gone:
                deleted.update(gone)
                partners.add(first)
        kept = "\n".join(x for n, x in enumerate(texts[k].split("\n")) if n not in deleted)
        out[k] = (len(deleted), sorted(partners), kept)
    return out


def sample(seed):
    rng = random.Random(seed)
    pool = [f"line number {k} of the common pool" for k in range(150)] + ["short", "", "  ", "All rights reserved."]
    rows = []
    for k in rng.sample(range(10**15, 10**15 + 900), 90):
        lines = [f"own line {k} {n} with some words" for n in range(rng.randint(0, 6))]
        at = rng.randrange(100)
        lines[1:1] = pool[at : at + rng.randint(0, 8)]
        lines += rng.choices(pool[-4:], k=2) + rng.choices(pool, k=1)
        rows.append((k, "\n".join(lines), "k", 1, "p"))
    rows += [(1, rows[4][1], None, None, None), (2, None, None, None, None), (3, "", "", 0, ""), (None, rows[6][1], "", 0, "")]
    return rows + [rows[0], rows[0], (4, "\n".join(pool[:60]), "", 0, "")]


@pytest.mark.parametrize("seed, rare", [(1, 50), (2, 2)])
def test_against_brute_force(spark, seed, rare, monkeypatch):
    monkeypatch.setattr(line_dedup, "RARE", rare)
    rows = sample(seed)
    expected = brute(rows)
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(out) == len(rows)
    for r in out:
        n_deleted, partners, kept = expected[NO_ID if r.doc_id is None else r.doc_id]
        assert [NO_ID if p is None else p for p in r.partners] == partners, r
        assert r.n_deleted == n_deleted and (r.text or "") == kept
    assert {r.text for r in out if r.doc_id == 2} == {None}
    assert out[0].keys is not None and sum(r.n_deleted for r in out) > 20


def test_empty_table(spark):
    out = line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and {"keys", "first", "partners", "n_lines"} <= set(out.columns)


def test_alignment_keeps_order_and_finds_moved_blocks():
    assert line_dedup.patience_matches([1, 2, 3, 4], [1, 3, 2, 4]) in ([(0, 0), (1, 2), (3, 3)], [(0, 0), (2, 1), (3, 3)])
    assert line_dedup.patience_matches([1, 9, 1, 2], [1, 2]) == [(0, 0), (3, 1)]
    assert line_dedup.patience_matches([], [1]) == [] == line_dedup.patience_matches([2], [1])
    assert line_dedup.common_blocks([5, 6, 7], [1, 5, 6, 7, 2], [20] * 5) == [1, 2, 3]
    assert line_dedup.common_blocks([5, 6, 7], [1, 5, 8, 7, 2], [20] * 5) == []
    assert line_dedup.common_blocks([5], [5], [40]) == [0] and line_dedup.common_blocks([5], [5], [39]) == []


def test_longest_chain():
    rng = random.Random(0)
    for _ in range(50):
        first = rng.sample(range(30), 9)
        chain = line_dedup.rising_chain(list(zip(first, range(9))))
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(chain, chain[1:]))
        best = [1] * 9
        for j in range(9):
            best[j] = 1 + max((best[i] for i in range(j) if first[i] < first[j]), default=0)
        assert len(chain) == max(best)

import hashlib
import random

import numpy as np
import pytest

from treeledger.llm import suffix_dedup

SCHEMA = "doc_id long, text string, chunk string, start string, starts int"
NO_ID = -(2**63)


def brute(rows, width=100):
    """Results by the definition, with every string of ``width`` bytes kept as it is."""
    seen, out = set(), {}
    for doc_id, text in sorted({(NO_ID if r[0] is None else r[0], r[1] or "") for r in rows}):
        data = text.encode()
        covered = np.zeros(len(data), bool)
        for k in range(len(data) - width + 1):
            piece = data[k : k + width]
            if piece in seen:
                covered[k : k + width] = True
            seen.add(piece)
        edges = np.diff(np.concatenate([[0], covered.astype(int), [0]]))
        kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
        out[doc_id] = (len(data), int(covered.sum()), int((edges > 0).sum()), hashlib.sha256(kept).hexdigest())
    return out


def sample(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)] + ["été", "字字", "—"]
    passages = [" ".join(rng.choices(words, k=rng.randint(15, 90))) for _ in range(6)]
    rows = []
    for k in rng.sample(range(10**16, 10**16 + 5000), 100):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(3)] + rng.choices(passages, k=rng.randint(0, 2))
        rng.shuffle(parts)
        rows.append((k, "\n".join(parts), "c", "s", 1))
    near = list(rows[5][1] + " " + rows[6][1])
    for k in range(40):
        near[rng.randrange(len(near))] = "#"
        rows.append((10**17 + k, "".join(near), "c", "s", 1))
    rows += [(3, "a" * 350, None, None, None), (4, None, None, None, None), (5, "", "", "", 0), (6, "ab" * 120, "", "", 0), (7, "a" * 100, "", "", 0)]
    rows += [(8, "a" * 99, "", "", 0), (9, passages[0] * 3, "", "", 0), (None, rows[0][1], None, None, None), (10, rows[0][1], None, None, None)]
    return rows + [rows[1], rows[1]]


@pytest.mark.parametrize("seed, chunk", [(1, 4000), (2, 10**6)])
def test_against_brute_force(spark, seed, chunk, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", chunk)
    rows = sample(seed)
    expected = brute(rows)
    out = suffix_dedup.dedup_bytes(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(out) == len(rows)
    for r in out:
        key = NO_ID if r.doc_id is None else r.doc_id
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[key], key
        assert sum(s.end - s.begin for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    assert sum(v[1] for v in expected.values()) > 10000


def test_empty_table(spark):
    assert suffix_dedup.dedup_bytes(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_repeated_windows_against_a_dictionary(seed):
    rng = np.random.default_rng(seed)
    block = rng.integers(0, [2, 4, 256][seed % 3], 400).astype(np.uint8)
    data = np.concatenate([block, block[37:301], rng.integers(0, 3, 150).astype(np.uint8), block[:250], block[101:260]])
    if seed == 7:
        data = np.zeros(500, np.uint8)
    starts = np.sort(rng.choice(len(data) - 99, size=len(data) - 150, replace=False))
    seen, expected = set(), []
    for s in starts.tolist():
        piece = data[s : s + 100].tobytes()
        expected.append(piece in seen)
        seen.add(piece)
    assert suffix_dedup.repeated_windows(data, starts).tolist() == expected


def test_sliding_extremes():
    values = np.random.default_rng(0).integers(0, 100, 50).astype(np.uint64)
    for width in (1, 2, 3, 7, 8, 50, 51):
        expected = [values[k : k + width].min() for k in range(len(values) - width + 1)]
        assert suffix_dedup.sliding(values, width, np.minimum).tolist() == expected


def test_every_repeated_string_shares_a_chosen_gram():
    rows = sample(3)
    texts = [r[1] or "" for r in rows]
    owner, grams = suffix_dedup.chosen_grams(texts)
    counted = dict(zip(*np.unique(grams, return_counts=True)))
    data, begins, ends, of, least, _ = suffix_dedup.representatives(texts)
    pieces = {}
    for k in np.nonzero(of >= 0)[0].tolist():
        pieces.setdefault(data[k : k + 100].tobytes(), []).append(least[k])
    assert all(len(set(v)) == 1 for v in pieces.values())
    assert all(counted[v[0]] > 1 for v in pieces.values() if len(v) > 1)
    assert len(owner) == len(grams)

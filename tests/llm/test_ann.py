import numpy as np
import pytest
from pyspark.sql import functions as F

from treeledger.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, list int, query_id string"


def brute(rows, k, every):
    vectors = {}
    for vec_id, vector, *_ in rows:
        if vec_id is None or vector is None or len(vector) != 12 or any(v is None or not np.isfinite(v) for v in vector):
            continue
        if any(vector):
            vectors[vec_id] = np.array(vector, np.float32).astype(float)
    out = {}
    for q in vectors:
        if q % every == 0:
            scores = []
            for c, v in vectors.items():
                if c != q:
                    scores.append((-(v @ vectors[q]) / np.sqrt((v @ v) * (vectors[q] @ vectors[q])), c))
            out[q] = [(c, -s) for s, c in sorted(scores)[:k]]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((8, 12))
    rows = []
    for k in range(1500):
        vector = centers[k % 8] + 0.3 * rng.standard_normal(12) if k % 3 else rng.standard_normal(12) * 10
        rows.append((k * 7, [float(x) for x in vector.astype(np.float32)], 1, 2, "q"))
    same = rows[5][1]
    rows += [(100000 + k, same, None, None, None) for k in range(300)]
    rows += [(20, None, 1, 1, ""), (40, [0.0] * 12, 1, 1, ""), (60, [float("nan")] * 12, 1, 1, ""), (80, [None] * 12, 1, 1, "")]
    rows += [(99, [1.0, 2.0], 1, 1, ""), (None, same, 1, 1, ""), rows[0], rows[0], (120, [float("inf")] * 12, 1, 1, "")]
    return rows


def test_recall_order_and_scores(spark, rows, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 20)
    monkeypatch.setattr(ann, "LIST_SIZE", 60)
    monkeypatch.setattr(ann, "SAMPLE", 700)
    frame = spark.createDataFrame(rows, SCHEMA)
    out = ann.nearest_neighbours(frame, F.col("vec_id") % 20 == 0, 5).collect()
    expected = brute(rows, 5, 20)
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(expected)
    hits = sum(len({c for c, _ in got[q]} & {c for c, _ in expected[q]}) for q in got)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    vectors = {r[0]: np.array(r[1], float) for r in rows if r[0] is not None and r[1] and len(r[1]) == 12 and None not in r[1]}
    for q, found in got.items():
        assert len(found) == 5 and q not in [c for c, _ in found]
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        for c, score in found:
            a, b = vectors[q], vectors[c]
            assert abs(score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_few_vectors_and_none(spark):
    rows = [(0, [1.0, 0.0], 1, 1, ""), (50, [1.0, 1.0], 1, 1, ""), (7, [0.0, -2.0], 1, 1, "")]
    out = ann.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in out) == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]
    assert ann.nearest_neighbours(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame(rows[:1], SCHEMA)
    assert ann.nearest_neighbours(one, F.col("vec_id") % 50 == 0).count() == 0


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(1)
    data = rng.standard_normal((3000, 64))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    columns = [np.ascontiguousarray(data[:, c : c + 8]) for c in range(0, 64, 8)]
    lost = 0
    for q in range(50):
        true = set(np.argsort(((data - data[q]) ** 2).sum(1))[:6])
        kept = set(ann.scan(columns, [data[q, c : c + 8] for c in range(0, 64, 8)], 64, 6).tolist())
        lost += len(true - kept)
    assert lost <= 3

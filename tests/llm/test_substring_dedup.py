import hashlib
import random

import pytest

from treeledger.llm import sketch, substring_dedup

SCHEMA = "doc_id long, text string, chunk string, start string, starts int"


def brute(rows, width):
    """Results by the definition, with windows kept as tuples of words."""
    seen, out = {}, {}
    ordered = sorted({(-(2**63) if r[0] is None else r[0], r[1] or "") for r in rows})
    for doc_id, text in ordered:
        words = text.encode().split()
        covered = set()
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            if window in seen:
                covered.update(range(k, k + width))
            seen.setdefault(window, (doc_id, k))
        kept = b" ".join(w for k, w in enumerate(words) if k not in covered)
        out[doc_id] = (len(words), len(covered), hashlib.sha256(kept).hexdigest())
    return out


def results(frame):
    return [(-(2**63) if r.doc_id is None else r.doc_id, (r.n_words, r.n_removed, r.kept_sha256)) for r in frame.collect()]


def sample(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["é　x", "a\x1cb"]
    passages = [" ".join(rng.choices(words, k=rng.randint(15, 45))) for _ in range(6)]
    rows = []
    for k in rng.sample(range(10**16, 10**16 + 5000), 120):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(3)]
        parts += rng.choices(passages, k=rng.randint(0, 2))
        rng.shuffle(parts)
        rows.append((k, rng.choice([" ", "\n", "\t\x0b"]).join(parts), "c", "s", 1))
    rows += [(3, "x " * 300, None, None, None), (4, None, None, None, None), (5, "", "", "", 0), (6, "\n \t", "", "", 0)]
    rows += [(None, rows[0][1], None, None, None), (8, rows[0][1], None, None, None), rows[1], rows[1]]
    return rows


@pytest.mark.parametrize("seed, width", [(1, 20), (2, 3)])
def test_against_brute_force(spark, seed, width, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 7000)
    rows = sample(seed)
    got = results(substring_dedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA).repartition(5), width))
    expected = brute(rows, width)
    assert len(got) == len(rows)
    assert {k for k, _ in got} == set(expected)
    for key, value in got:
        assert value == expected[key], key
    assert any(v[1] for _, v in got)


def test_kept_text_is_the_input_without_removed_words(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, "", "", 0), (2, f"new {text} end", "", "", 0)]
    out = {r.doc_id: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[1].kept_text == text and out[2].kept_text == "new end"


def test_empty_table(spark):
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cells_survive_packing():
    import numpy as np

    for cells in ([0, 1, 255, 256, 2**27 - 1], [5], [0], [1, 2, 3]):
        cells = np.array(cells, np.uint64)
        assert sketch._unpacked(sketch._packed(cells)).tolist() == cells.tolist()

import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeledger.llm import language_id as lid

SCHEMA = "doc_id long, text string, lang string, score string, words int"


def plain_viterbi(codes, scores, penalty):
    """Best sum by dynamic programming over one document; returns the sum."""
    best = list(scores[codes[0]])
    for code in codes[1:]:
        best = [max(b - (k != l) * penalty for k, b in enumerate(best)) + scores[code][l] for l in range(len(best))]
    return max(best)


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_reaches_the_best_sum(seed):
    rng = np.random.default_rng(seed)
    scores = rng.standard_normal((30, 4)) * 3
    codes = [rng.integers(0, 30, n) for n in [5, 0, 1, 40, 7, 40, 2]]
    for path, code in zip(lid.viterbi(codes, scores, 2.0), codes):
        assert len(path) == len(code)
        if len(code):
            got = scores[code, path].sum() - 2.0 * (path[1:] != path[:-1]).sum()
            assert got == pytest.approx(plain_viterbi(code, scores, 2.0))


def test_sequences_match_a_plain_count():
    words = ["ab", "é", "longer", "a"]
    buckets, begins = lid.sequences_of(words)
    sizes = np.diff(np.append(begins, len(buckets)))
    for word, size in zip(words, sizes):
        padded = b" " + word.encode() + b" "
        expected = sum(1 for n in range(1, 5) for k in range(len(padded) - n + 1) if padded[k : k + n] != b" ")
        assert size == expected
    again, _ = lid.sequences_of(["longer"])
    assert sorted(again.tolist()) == sorted(buckets[begins[2] : begins[3]].tolist())


def test_scripts():
    words = ["word", "слово", "λέξη", "字", "ﬁ", "한국"]
    assert [lid.SCRIPTS[k] for k in lid.scripts_of(words)] == ["latin", "cyrillic", "greek", "han", "other", "hangul"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    letters = {"aa": "abcdefg", "bb": "efghijk", "cc": "абвгд"}
    text = lambda l, n: " ".join("".join(rng.choices(letters[l], k=rng.randint(2, 7))) for _ in range(n))
    rows = [(k, text(l, rng.randint(3, 40)), l, "s", 1) for k, l in enumerate(rng.choices(list(letters), k=400))]
    mixed = text("aa", 30) + ". " + text("cc", 60)
    rows += [(1000, mixed, None, None, None), (1001, None, "aa", "", 0), (1002, "12 -- !", "bb", "", 0), (1003, "", None, "", 0)]
    return rows + [(None, rows[0][1], "aa", "", 0), rows[3], rows[3], (1004, "字字 字", None, "", 0)]


def test_held_out_accuracy_spans_and_edges(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = lid.fit(lid.training_rows(docs.where(~lid.held_out())))
    assert model.languages == ["aa", "bb", "cc"]
    out = lid.predict(docs, model).withColumn("held_out", lid.held_out()).collect()
    assert len(out) == len(rows)
    told = [r for r in out if r.held_out and r.lang and r.doc_id < 1000]
    assert len(told) > 50 and sum(r.lang_pred == r.lang for r in told) >= 0.97 * len(told)
    found = {r.doc_id: r for r in out}
    assert [found[k].lang_pred for k in (1001, 1002, 1003)] == ["und"] * 3 and found[1001].score == 0
    assert found[1000].lang_pred == "cc" and [s.lang for s in found[1000].spans] == ["aa", "cc"]
    assert [(s.first_word, s.n_words) for s in found[1000].spans] == [(0, 30), (30, 60)]
    assert found[1004].lang_pred in model.languages and not found[None].held_out
    for r in out:
        assert 0 <= r.score <= 1 and sum(s.n_words for s in r.spans) == r.n_words
        assert all(len(list(g)) == 1 for _, g in groupby(s.lang for s in r.spans))


def test_no_labels_and_no_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    model = lid.fit(lid.training_rows(docs.where("false")))
    assert {r.lang_pred for r in lid.predict(docs, model).collect()} == {"und"}
    assert lid.predict(docs.where("false"), model).count() == 0


def test_remainder(spark):
    import zlib

    out = spark.range(50).select("id", lid.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in out)
    assert spark.range(1).select(lid.held_out("id")).where(F.lit(True)).count() == 1


def test_words_are_hashed_in_bounded_parts_with_equal_scores(monkeypatch):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeéж字"), rng.integers(1, 12))) for _ in range(3000)] + ["x" * 700]
    weights = rng.standard_normal((lid.BUCKETS, 3)).astype(np.float32)
    model = lid.LanguageModel(["aa", "bb", "cc"], weights, rng.random((len(lid.SCRIPTS), 3)) < 2)
    plain = lid.sequences_of
    expected = np.array([weights[plain([word])[0]].sum(0, dtype=float) for word in words])
    expected = np.maximum(expected - expected.max(1, keepdims=True), lid.NO_CANDIDATE)
    sizes = []
    monkeypatch.setattr(lid, "SCORED_SIZE", 500, raising=False)
    monkeypatch.setattr(lid, "sequences_of", lambda part: (sizes.append(sum(map(len, part))), plain(part))[1])
    found = model.scores(words)
    assert len(sizes) > 30 and sorted(sizes)[-2] <= 500 and max(sizes) == 700
    assert found.dtype == np.float32 and np.allclose(found, expected, atol=1e-3)

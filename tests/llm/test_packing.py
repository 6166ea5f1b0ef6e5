import json
import zlib

import numpy as np
import pytest

from treeledger.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, sequence_id string, _rank int"


def ids_of(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    words = ["the", "one", "12", "été", "　", "<|endoftext|>", "a", "\n", "\t x", "won't"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 900))) for _ in range(60)]
    return [(k, t, "x", 1) for k, t in enumerate(texts)] + [(7, texts[7], "x", 1), (90, "", None, None), (91, None, None, None), (None, "a b", "", 2)]


def test_every_token_is_packed_once(spark, rows):
    out = packing.pack(spark.createDataFrame(rows, SCHEMA), VOCABULARY).collect()
    expected = []
    for doc_id, text, *_ in rows:
        ids = ids_of(text or "")
        cuts = [0] if len(ids) <= 1024 else list(range(len(ids) % 1024 or 1024, len(ids), 1024))
        cuts = sorted({0, *cuts})
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            expected.append((str(doc_id), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = [(str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out]
    assert sorted(got) == sorted(expected)
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in out)
    assert len(places) <= total / 1024 * 1.1 + 2


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), VOCABULARY).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_length_and_stays_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    histogram = rng.poisson(30, 1025) * (rng.random(1025) < [0.02, 0.3, 1, 0.7][seed])
    histogram[0] = 0
    plan = packing.plan_sequences(histogram)
    used = np.zeros(1025, int)
    for content, count in plan:
        assert sum(content) <= 1024 and count > 0
        for length in content:
            used[length] += count
    assert (used == histogram).all()
    # First-fit decreasing on the single lengths, as a measure.
    room = []
    for length in range(1024, 0, -1):
        for _ in range(histogram[length]):
            k = next((k for k, r in enumerate(room) if r >= length), None)
            if k is None:
                room.append(1024 - length)
            else:
                room[k] -= length
    assert sum(count for _, count in plan) <= len(room) * 1.01 + 2


def test_plan_of_nothing_and_of_full_pieces():
    histogram = np.zeros(1025, int)
    assert packing.plan_sequences(histogram) == []
    histogram[1024] = 5
    assert packing.plan_sequences(histogram) == [((1024,), 5)]


def test_fixed_values_match_the_vocabulary_file():
    with open(VOCABULARY, encoding="utf-8") as file:
        assert json.load(file)["pre_tokenizer"]["type"] == "ByteLevel"

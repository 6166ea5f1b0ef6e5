import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from treeledger.llm import packing, token_alignment
from treeledger.llm.queries import piece_vocabulary_path, vocabulary_path

SCHEMA = "doc_id long, text string, chunk string, n_a int, total long"


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(vocabulary_path())
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary_path())
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}

    def bytes_of(piece):
        if len(piece) == 6 and piece.startswith("<0x"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    kept, count = {}, Counter()
    for k, (_, text, *_) in enumerate(rows):
        a = first.encode(" " + text, add_special_tokens=False) if text else None
        b = second.encode(text) if text else []
        parts_a = [bytes(byte_of[c] for c in t) for t in a.tokens] if a else []
        parts_b = [bytes_of(second.id_to_piece(i)) for i in b]
        if not text or not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            continue
        spans = []
        for ids, parts in ((a.ids, parts_a), (b, parts_b)):
            at, own = 0, []
            for i, part in zip(ids, parts, strict=True):
                own.append((i, at, at + len(part)))
                at += len(part)
            spans.append(own)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        both = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups = [[",".join(str(t[0]) for t in own if low < t[2] <= high) for own in spans] for low, high in zip([0, *both[:-1]], both, strict=True)]
        kept[k] = (len(a.ids), len(b), len(groups), links, ";".join("|".join(g) for g in groups))
        count.update(links)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for k, row in enumerate(rows):
        if k not in kept:
            out.append((row[0], 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, text = kept[k]
        best = sum(count[x] == most[x[1]] for x in links)
        out.append((row[0], n_a, n_b, n_groups, len(links), best, sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def sample(seed):
    rng = random.Random(seed)
    words = ["the", "Straße", "naïve", "中文字符", "🙂🙃", "don't", "foo_bar(x)", "<|endoftext|>", "</s>", "<0x41>", "éé", "ﬁ", "12345", "a" * 40, "\tx", "▁"]
    rows = [(k, rng.choice([" ", "  ", "\n", ""]).join(rng.choices(words, k=rng.randint(1, 60))), "c", 1, 2) for k in range(90)]
    rows += [(100 + k, "the very same text again", "", 0, 0) for k in range(50)]
    rows += [(None, "x y", None, None, None), (7, None, None, None, None), (8, "", "", 0, 0), (9, " ", "", 0, 0), (10, "  lead", "", 0, 0), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize(("seed", "text_size", "chunk_size"), [(1, 1_000_000, 16_000_000), (2, 300, 900)])
def test_against_all_pairs(spark, seed, text_size, chunk_size, monkeypatch):
    monkeypatch.setattr(token_alignment, "TEXT_SIZE", text_size)
    monkeypatch.setattr(token_alignment, "CHUNK_CHARACTERS", chunk_size)
    rows = sample(seed)
    out = token_alignment.align(spark.createDataFrame(rows, SCHEMA).repartition(3), vocabulary_path(), piece_vocabulary_path()).collect()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(map(tuple, out), key=key) == sorted(brute(rows), key=key)


def test_bitmaps():
    rng = np.random.default_rng(3)
    size = 1 << token_alignment.CHUNK_BITS
    times = {(int(p), int(d)): int(t) for p, d, t in zip(rng.integers(0, 40, 9000), rng.integers(0, size, 9000), rng.geometric(0.3, 9000), strict=True)}
    times |= {(97, d): 1 for d in range(size // 16)} | {(96, d): 1 for d in range(size // 16 - 1)}
    times |= {(99, d): 1 for d in range(0, size, 2)} | {(98, 5): 1_000_000}
    keys = sorted(times)
    pairs, places = np.array(keys, np.int64).T
    bits = token_alignment.planes_of(pairs, places, np.array([times[k] for k in keys], np.int64))
    half = [bits[::2], bits[1::2], bits[:100]]
    assert (token_alignment.merged(half) == bits).all()
    found, n_docs, n_links = token_alignment.counted(bits)
    for p, n, links in zip(found.tolist(), n_docs.tolist(), n_links.tolist(), strict=True):
        own = [t for (pair, _), t in times.items() if pair == p]
        assert (n, links) == (len(own), sum(own))
    pairs, planes = token_alignment.packed(bits)
    again = {}
    for p, own in zip(pairs.tolist(), planes, strict=True):
        for j, plane in enumerate(own):
            for d in token_alignment.unpacked([plane])[0].tolist():
                again[p, d] = again.get((p, d), 0) + (1 << j)
    assert again == times
    assert max(len(plane) for plane in planes[pairs.tolist().index(99)]) == size // 8


def test_empty_table_and_long_texts(spark):
    args = vocabulary_path(), piece_vocabulary_path()
    assert token_alignment.align(spark.createDataFrame([], SCHEMA), *args).count() == 0
    rows = [(1, " " * 300_000 + "x", "", 0, 0), (2, "word and " * 40_000, "", 0, 0)]
    out = {r.doc_id: r for r in token_alignment.align(spark.createDataFrame(rows, SCHEMA), *args).collect()}
    assert out[2].n_links >= out[2].n_groups > 0


def test_long_white_space_gets_the_ids_of_the_slow_encoder():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(vocabulary_path()), packing.load_tokenizer(vocabulary_path())
    for text in (" " * 2_000_000 + "x", "\n" * 2_000_000, "a <|endoftext|> b" + "\t \n" * 400_000 + "end"):
        slow.encode_special_tokens = False
        expected = slow.encode(text, add_special_tokens=False).ids
        assert packing.encode_plain(fast, vocabulary_path(), text, added_tokens=True) == expected

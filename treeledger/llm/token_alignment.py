"""Cross-tokenizer alignment: which tokens of two vocabularies overlap, counted over the corpus by inverted pair bitmaps."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from treeledger.scratch import materialize

from .common import row_batches
from .packing import encode_plain, load_tokenizer

# Documents, and characters of their texts, of one chunk: a bitmap covers the documents of a chunk.
CHUNK_BITS = 13
CHUNK_CHARACTERS = 16_000_000
TEXT_SIZE = 1_000_000
SPACE = "▁"


@dataclass
class Vocabulary:
    """The bytes of every token, their number, and the token's id in decimal before each separator."""

    tokens: list[bytes]
    sizes: np.ndarray = field(init=False)
    inside: np.ndarray = field(init=False)
    last: np.ndarray = field(init=False)
    separator: str = ";"

    def __post_init__(self) -> None:
        self.sizes = np.array([len(token) for token in self.tokens], np.int64)
        self.inside = np.array([f"{k}," for k in range(len(self.tokens))], object)
        self.last = np.array([f"{k}{self.separator}" for k in range(len(self.tokens))], object)


@functools.lru_cache(maxsize=2)
def load_bytes(path: str) -> Vocabulary:
    """The byte-level vocabulary."""
    tokenizer = load_tokenizer(path)
    by_id = dict(zip(map(tokenizer.encode_single_token, tokenizer.token_byte_values()), tokenizer.token_byte_values(), strict=True))
    return Vocabulary([by_id.get(k, b"") for k in range(max(by_id) + 1)], separator="|")


@functools.lru_cache(maxsize=2)
def load_pieces(path: str):
    """The processor of a piece vocabulary, and the bytes of its pieces."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [processor.id_to_piece(k) for k in range(processor.get_piece_size())]
    tokens = [bytes([int(n[1:-1], 16)]) if processor.is_byte(k) else n.replace(SPACE, " ").encode() for k, n in enumerate(names)]
    return processor, Vocabulary(tokens)


@dataclass
class Aligned:
    """Texts as tokens of both vocabularies, one after the other: ids, ends in bytes, and the texts' numbers of tokens."""

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    counts_a: np.ndarray
    counts_b: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of an A and a B token, by place, that share a byte."""
        starts_a = np.append(0, self.ends_a[:-1])
        starts_b = np.append(0, self.ends_b[:-1])
        first = np.searchsorted(self.ends_b, starts_a, "right")
        each = np.searchsorted(starts_b, self.ends_a, "left") - first
        before = np.cumsum(each) - each
        left = np.repeat(np.arange(len(each)), each)
        return left, np.arange(len(left)) + np.repeat(first - before, each)

    def groups(self, vocabulary_a: Vocabulary, vocabulary_b: Vocabulary) -> tuple[np.ndarray, list[str]]:
        """Of every text the number of groups and the groups as written."""
        cut_a = self.ends_b[np.searchsorted(self.ends_b, self.ends_a)] == self.ends_a
        cut_b = self.ends_a[np.searchsorted(self.ends_a, self.ends_b)] == self.ends_b
        # The tokens of both in the order in which they are written: by group, A before B.
        side = np.repeat([0, 1], [len(self.a), len(self.b)])
        group = np.concatenate([np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b])
        names = [np.where(cut, v.last[ids], v.inside[ids]) for cut, v, ids in ((cut_a, vocabulary_a, self.a), (cut_b, vocabulary_b, self.b))]
        written = np.concatenate(names)[np.argsort(2 * group + side, kind="stable")].tolist()
        cuts = np.append(0, np.cumsum(self.counts_a + self.counts_b)).tolist()
        texts = ["".join(written[x:y])[:-1] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        owner = np.repeat(np.arange(len(self.counts_a)), self.counts_a)
        return np.bincount(owner, cut_a, len(self.counts_a)).astype(np.int64), texts


def encode(texts: list[str], path_a: str, path_b: str) -> tuple[np.ndarray, Aligned]:
    """Which texts have tokens, and these texts' tokens: both vocabularies must give back a space and the text."""
    tokenizer, bytes_a = load_tokenizer(path_a), load_bytes(path_a)
    processor, bytes_b = load_pieces(path_b)
    all_b = processor.encode(texts, num_threads=1)
    found: list[int] = []
    ids_a: list[list[int]] = []
    ids_b: list[list[int]] = []
    for k, (text, b) in enumerate(zip(texts, all_b, strict=True)):
        data = b" " + text.encode()
        if not text or b"".join(map(bytes_b.tokens.__getitem__, b)) != data:
            continue
        a = encode_plain(tokenizer, path_a, " " + text)
        if b"".join(map(bytes_a.tokens.__getitem__, a)) == data:
            found.append(k)
            ids_a.append(a)
            ids_b.append(b)
    flat = [np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b)]
    ends = [np.cumsum(v.sizes[ids]) for v, ids in zip((bytes_a, bytes_b), flat, strict=True)]
    counts = [np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b)]
    return np.array(found, np.int64), Aligned(*flat, *ends, *counts)


# Bitmaps. Those of one chunk are kept together: for every pair, plane and document a bit is set for, one number, sorted.


def planes_of(pairs: np.ndarray, places: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The multiplicity planes of pairs in documents: plane j of a pair has the documents in whose multiplicity bit j is set."""
    out = [np.empty(0, np.int64)]
    for j in range(int(times.max(initial=0)).bit_length()):
        here = (times >> j) & 1 == 1
        out.append((((pairs[here] << 6) | j) << CHUNK_BITS) | places[here])
    return np.sort(np.concatenate(out))


def merged(bitmaps: list[np.ndarray]) -> np.ndarray:
    """The union (OR) of bitmaps."""
    return np.unique(np.concatenate([np.empty(0, np.int64), *bitmaps]))


def counted(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every pair: its number of documents, the bits of the union of its planes, and of links, every plane's bits weighed."""
    pair, plane = bits >> (CHUNK_BITS + 6), (bits >> CHUNK_BITS) & 63
    documents = np.unique((pair << CHUNK_BITS) | (bits & ((1 << CHUNK_BITS) - 1))) >> CHUNK_BITS
    pairs, n_docs = np.unique(documents, return_counts=True)
    n_links = np.zeros(len(pairs), np.int64)
    np.add.at(n_links, np.searchsorted(pairs, pair), np.int64(1) << plane)
    return pairs, n_docs, n_links


def packed(bits: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Of every pair its planes as bytes: the sorted places of 16 bits each, or one bit for every place where that is not longer;
    only the latter has as many bytes as a chunk has bits."""
    keys, begins = np.unique(bits >> CHUNK_BITS, return_index=True)
    places = (bits & ((1 << CHUNK_BITS) - 1)).astype("<u2")
    data = places.tobytes()
    cuts = [*begins.tolist(), len(places)]
    pairs, firsts = np.unique(keys >> 6, return_index=True)
    planes: list[list[bytes]] = [[] for _ in pairs]
    owner = np.repeat(np.arange(len(pairs)), np.diff(np.append(firsts, len(keys)))).tolist()
    for k, (own, plane) in enumerate(zip(owner, (keys & 63).tolist(), strict=True)):
        x, y = cuts[k], cuts[k + 1]
        content = data[2 * x : 2 * y]
        if y - x >= 1 << (CHUNK_BITS - 4):
            row = np.zeros(1 << CHUNK_BITS, bool)
            row[places[x:y]] = True
            content = np.packbits(row).tobytes()
        planes[own].extend([b""] * (plane - len(planes[own])))
        planes[own].append(content)
    return pairs, planes


def unpacked(planes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The places of many planes, and how many each has."""
    dense = 1 << (CHUNK_BITS - 3)
    parts = [np.nonzero(np.unpackbits(np.frombuffer(p, np.uint8)))[0].astype("<u2").tobytes() if len(p) == dense else p for p in planes]
    return np.frombuffer(b"".join(parts), "<u2").astype(np.int64), np.array([len(p) // 2 for p in parts], np.int64)


_DOCUMENT = "place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_PAIR = "a int, b int, n_docs long, count long, planes array<binary>"


def postings(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for every document (``place`` in its ``chunk``), and one for every pair of ids linked in a chunk (``a``, ``b``),
    with the pair's planes over the chunk's documents, its number of documents there, and its links (``count``)."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bytes_a, (_, bytes_b) = load_bytes(path_a), load_pieces(path_b)
        chunk = TaskContext.get().partitionId() << 31
        size = characters = 0
        bitmaps: list[np.ndarray] = []

        def ended() -> Iterator[pd.DataFrame]:
            bits = merged(bitmaps)
            if not len(bits):
                return
            pairs, n_docs, n_links = counted(bits)
            columns = {"chunk": chunk, "a": pairs // len(bytes_b.tokens), "b": pairs % len(bytes_b.tokens)}
            yield pd.DataFrame(columns | {"n_docs": n_docs, "count": n_links, "planes": packed(bits)[1]})

        for batch in batches:
            texts = batch["text"].tolist()
            for first, last in row_batches(texts, TEXT_SIZE):
                for begin in range(first, last, 1 << CHUNK_BITS):
                    some = texts[begin : min(last, begin + (1 << CHUNK_BITS))]
                    added = sum(map(len, some))
                    if size and (size + len(some) > 1 << CHUNK_BITS or characters + added > CHUNK_CHARACTERS):
                        yield from ended()
                        chunk, size, characters, bitmaps = chunk + 1, 0, 0, []
                    found, aligned = encode(some, path_a, path_b)
                    left, right = aligned.links()
                    owner = np.repeat(np.arange(len(found)), aligned.counts_a)[left]
                    pair = aligned.a[left] * len(bytes_b.tokens) + aligned.b[right]
                    keys, times = np.unique((pair << CHUNK_BITS) | (size + found[owner]), return_counts=True)
                    bitmaps.append(planes_of(keys >> CHUNK_BITS, keys & ((1 << CHUNK_BITS) - 1), times))
                    n_groups, written = aligned.groups(bytes_a, bytes_b)
                    out = {name: np.zeros(len(some), np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
                    counts = aligned.counts_a, aligned.counts_b, n_groups, np.bincount(owner, minlength=len(found))
                    for name, values in zip(out, counts, strict=True):
                        out[name][found] = values
                    digests = [""] * len(some)
                    for k, text in zip(found.tolist(), written, strict=True):
                        digests[k] = hashlib.sha256(text.encode()).hexdigest()
                    rows = {"chunk": chunk, "place": np.arange(size, size + len(some)), "doc_id": batch["doc_id"].iloc[begin : begin + len(some)].array}
                    yield pd.DataFrame(rows | out | {"groups_sha256": digests})
                    size, characters = size + len(some), characters + added
        if size:
            yield from ended()

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for made in align(batches):
            yield made.assign(**{name: None for name in names if name not in made})[names]

    schema = f"chunk long, {_DOCUMENT}, {_PAIR}"
    names = [column.split()[0] for column in schema.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(whole, schema)


def pair_counts(stored: DataFrame) -> DataFrame:
    """Every pair of ids linked anywhere: ``a``, ``b``, ``n_docs``, ``count`` of links, ``best``: no other A id has more with this B id.

    Chunks have different documents, so the bits of a pair's bitmaps over all of them are the sum of each one's.
    """
    pairs = stored.where("a IS NOT NULL").groupBy("b", "a").agg(F.sum("n_docs").alias("n_docs"), F.sum("count").alias("count"))
    pairs = materialize(pairs, "pairs")
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))
    return pairs.join(most, "b").select("a", "b", "n_docs", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The alignment of every document's tokens of two vocabularies, and how usual its links are in the corpus.

    A is a byte-level vocabulary and encodes a space and the text, B one of pieces that adds the space itself. ``n_a`` and
    ``n_b`` count tokens, ``n_groups`` the groups between byte offsets at which tokens of both end, ``n_links`` the A and B tokens
    that share a byte. ``n_best`` counts links whose pair of ids has the most links of its B id, ``count_sum`` sums the links that the
    links' pairs have in the corpus; ``groups_sha256`` is the hash of the groups as written. A null or empty text, and one that
    a vocabulary does not give back, has no tokens: zeros and an empty string. Every row is a document of its own; a null id stays
    null, an empty table gives no row, other columns are not read.
    """
    stored = materialize(postings(docs, path_a, path_b), "pair-bitmaps")
    scores = pair_counts(stored).select("a", "b", F.col("count").alias("total"), "best")
    # The pairs grow with the corpus, so they are never sent to every task.
    inverted = stored.where("a IS NOT NULL").select("chunk", "a", "b", "planes").join(scores.hint("merge"), ["a", "b"])
    listed = stored.where("a IS NULL").drop("a", "b", "n_docs", "count", "planes")
    together = listed.unionByName(inverted.select("chunk", "total", "best", "planes"), allowMissingColumns=True)
    fields = [f for f in listed.schema if f.name not in ("chunk", "place")]

    def score(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        is_pair = group["total"].notna().to_numpy()
        docs, pairs = group[~is_pair].sort_values("place"), group[is_pair]
        sums, best = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        total, is_best = pairs["total"].to_numpy(np.int64), pairs["best"].to_numpy(bool)
        planes = pairs["planes"].tolist()
        for j in range(max(map(len, planes), default=0)):
            here = [k for k, own in enumerate(planes) if len(own) > j]
            places, each = unpacked([planes[k][j] for k in here])
            np.add.at(sums, places, np.repeat(total[here], each) << j)
            np.add.at(best, places, np.repeat(is_best[here].astype(np.int64), each) << j)
        docs = docs[[f.name for f in fields]].assign(n_best=best, count_sum=sums)
        return docs.astype({name: np.int64 for name in ("n_a", "n_b", "n_groups", "n_links")})

    kinds = StructType([StructField(f.name, f.dataType) for f in fields]).simpleString()[len("struct<") : -1].replace(":", " ")
    out = together.groupBy("chunk").applyInPandas(score, f"{kinds.replace(',', ', ')}, n_best long, count_sum long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

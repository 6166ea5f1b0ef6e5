"""Suffix-array dedup: byte strings that start earlier too, found by sorting suffixes with a difference cover.

Suffixes are sorted where repetitions can be. Every window of ``WINDOW`` bytes is represented by its smallest hash of ``GRAM`` bytes, which
depends on its bytes alone: equal windows have equal representatives, so windows of a representative that occurs once in
all documents (by a count-min sketch, which never counts too little) cannot repeat and are left out. The others go, as
stretches of text, to the bucket of their representative; equal windows meet there, and every bucket sorts its suffixes.
A representative with more stretches than one bucket should hold has none: its windows are grouped one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, row_batches, stage
from .sketch import RepeatedCells, repeated_cells

WINDOW = 100
GRAM = 32
# Text of one chunk of documents and of one bucket of stretches, in bytes of all text.
CHUNK_BYTES = 8_000_000
BUCKET_BYTES = 3_000_000
# Cells of the sketch per byte of text; about one byte in 35 is the place of a representative.
CELLS_PER_BYTE = 2
# Cells of the sketch that one task merges (a power of two).
BLOCK_BITS = 25
# Stands for a null id inside the operator, and so comes before every other id.
NO_ID = -(2**63)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of every run of ``size`` bytes (a power of two), built from runs of 1, 2, 4, ... bytes."""
    out = mix(data.astype(np.uint64) + np.uint64(1))
    width, base = 1, 0x9E3779B97F4A7C15
    while width < size:
        out = out[: len(out) - width] * np.uint64(base) + out[width:]
        base, width = base * base % (1 << 64), 2 * width
    return mix(out)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The smallest (or largest) of every ``width`` neighbours, from runs of 1, 2, 4, ... of them."""
    if len(values) < width:
        return values[:0]
    out, size = values, 1
    while 2 * size <= width:
        out = pick(out[: len(out) - size], out[size:])
        size *= 2
    return pick(out[: len(values) - width + 1], out[width - size : width - size + len(values) - width + 1])


def representatives(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Texts as one array of bytes, where each begins and ends, for every window its text (-1: across texts) and representative,
    and the hash of every gram."""
    coded = [text.encode() for text in texts]
    sizes = np.array([len(c) for c in coded], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(coded), np.uint8)
    if len(data) < WINDOW:
        return data, ends - sizes, ends, np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    grams = gram_hashes(data)
    least = sliding(grams, WINDOW - GRAM + 1, np.minimum)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    owner = np.where(np.arange(len(least)) + WINDOW <= ends[owner], owner, -1)
    return data, ends - sizes, ends, owner, least, grams


def chosen_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Every place that represents a window: its text and its hash. A place counts once, whatever the number of its windows."""
    _, begins, _, owner, least, grams = representatives(texts)
    if not len(least):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    span = WINDOW - GRAM
    # A gram represents a window when it equals the largest minimum of the windows around it; only windows inside a text count.
    inside = np.where(owner >= 0, least, np.uint64(0))
    padded = np.concatenate([np.zeros(span, np.uint64), inside, np.zeros(span, np.uint64)])
    largest = sliding(padded, span + 1, np.maximum)
    places = np.nonzero((grams == largest) & (largest > 0))[0]
    # Empty texts begin where the next one does; the last that begins there holds the place.
    return np.searchsorted(begins, places, "right") - 1, grams[places]


def stretches(texts: list[str], repeated: RepeatedCells):
    """Runs of windows with one representative that may be repeated: bytes, text begins and ends, and of each run its text, first
    window, number of windows, representative, and whether that may occur in the run more than once."""
    data, begins, ends, owner, least, grams = representatives(texts)
    if not len(least):
        nothing = np.empty(0, np.int64)
        return data, begins, ends, nothing, nothing, nothing, np.empty(0, np.uint64), nothing
    change = np.append(True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]))
    first = np.nonzero(change)[0]
    count = np.diff(np.append(first, len(least)))
    keep = (owner[first] >= 0) & repeated.hold(least[first])
    first, count = first[keep], count[keep]
    # A place represents up to span + 1 windows, so a longer run has several.
    span = WINDOW - GRAM
    near = np.arange(2 * span + 1)
    twice = count > span + 1
    for a in range(0, len(first), 4096):
        some = slice(a, a + 4096)
        same = grams[np.minimum(first[some, None] + near, len(grams) - 1)] == least[first[some], None]
        twice[some] |= (same & (near < count[some, None] + span)).sum(1) > 1
    return data, begins, ends, owner[first], first, count, least[first], twice


def names_of(keys: np.ndarray) -> np.ndarray:
    """The rank of every key among the different ones, from 1."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1


def triple(names: np.ndarray, step: int) -> np.ndarray:
    """The names of the triples of names at a place and one and two steps on; beyond the end there is nothing, named 0."""
    padded = np.concatenate([names, np.zeros(2 * step, np.int64)])
    bits = int(names.max()).bit_length() if len(names) else 0
    second, third = padded[step : step + len(names)], padded[2 * step : 2 * step + len(names)]
    if 3 * bits <= 62:
        return names_of((names << (2 * bits)) | (second << bits) | third)
    return names_of((names_of((names << bits) | second) << bits) | third)


def repeated_windows(data: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of the rising window starts have an equal window at an earlier start; all windows lie inside ``data``.

    Suffixes are sampled by the difference cover {1, 2} modulo 3. Sampled places are named by the rank of two triples of bytes,
    then of their triples of names, and so on, until a name stands for the order of 54 bytes; two names, and the bytes that
    are missing, then order suffixes by exactly as many bytes as are asked for. The remaining suffixes are merged through the
    sampled ones after them: with places 1 modulo 3 by a byte and the suffix after it, with places 2 by two bytes and the
    suffix after those. Adjacent suffixes with equal prefixes are windows that repeat.
    """
    assert window == 100, "the names below stand for 98, 99 and 100 bytes"
    size = len(data)
    text = np.concatenate([data.astype(np.int64), np.zeros(window + 6, np.int64)])
    # Sampled places of one remainder follow each other, so a step of three bytes is a step to the next sampled place.
    parts = [np.arange(r, size, 3) for r in (1, 2)]
    at = np.concatenate(parts)
    cut = len(parts[0])

    def split_triple(value: np.ndarray, step: int) -> np.ndarray:
        gap = np.zeros(2 * step, np.int64)  # keeps the second remainder out of the first one's triples
        return np.delete(triple(np.concatenate([value[:cut], gap, value[cut:]]), step), np.arange(cut, cut + 2 * step))

    packed = text[at]
    for k in range(1, 6):
        packed = (packed << 8) | text[at + k]
    value = names_of(packed)
    for step in (2, 6):  # names of 18 and 54 bytes
        value = split_triple(value, step)
    names = np.zeros(size + window + 6, np.int64)
    names[at] = value
    bits = max(1, int(value.max()).bit_length()) if len(value) else 1

    def ranks(places: np.ndarray, step: int) -> np.ndarray:
        """Order of the suffixes by 54 + ``step`` bytes."""
        return names_of((names[places] << bits) | names[places + step])

    marked = np.zeros(size, bool)

    def later(places: np.ndarray, keys: np.ndarray) -> None:
        """Mark places whose key equals that of an earlier one: neighbours once sorted."""
        order = np.argsort(keys)
        begins = np.nonzero(np.append(True, np.diff(keys[order]) != 0))[0]
        first = np.repeat(np.minimum.reduceat(places[order], begins), np.diff(np.append(begins, len(order))))
        marked[places[order][places[order] != first]] = True

    sampled, with_first, with_second = starts[starts % 3 > 0], starts[starts % 3 != 2], starts[starts % 3 != 1]
    if len(sampled):
        later(sampled, (ranks(sampled, 45) << 8) | text[sampled + 99])
    if len(with_first):
        later(with_first, (ranks(with_first + 1, 45) << 8) | text[with_first])
    if len(with_second):
        key = ranks(with_second + 2, 42)
        for k in (0, 1, 98, 99):
            key = (key << 8) | text[with_second + k]
        later(with_second, key)
    return marked[starts]


def sort_bucket(group: pd.DataFrame) -> pd.DataFrame:
    """The windows of a bucket's stretches that no earlier window equals: document, first window and number of windows of each run.

    Equal stretches are sorted once. A stretch that is the only one of its representative, and has that once, holds no window
    that repeats, and is not sorted at all.
    """
    group = group.sort_values(["_id", "start"], kind="stable")
    different: dict[bytes, int] = {}
    for number, text in enumerate(group["text"]):
        different.setdefault(bytes(text), number)
    rows = np.fromiter(different.values(), np.int64, len(different))
    ids, begins, grams, twice = (group[c].to_numpy()[rows] for c in ("_id", "start", "gram", "twice"))
    sizes = np.array([len(text) for text in different], np.int64)
    _, which, each = np.unique(grams, return_inverse=True, return_counts=True)
    doubtful = (each[which] > 1) | twice.astype(bool)
    plain = ~doubtful
    alone = pd.DataFrame({"_id": ids[plain], "start": begins[plain], "count": sizes[plain] - (WINDOW - 1)})
    if plain.all():
        return alone
    data = np.frombuffer(b"".join(text for text, asked in zip(different, doubtful.tolist(), strict=True) if asked), np.uint8)
    ids, begins, sizes = ids[doubtful], begins[doubtful], sizes[doubtful]
    counts = sizes - (WINDOW - 1)
    shift = np.cumsum(sizes) - sizes
    number = np.repeat(np.arange(len(sizes)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    first = ~repeated_windows(data, shift[number] + inside)
    number, inside = number[first], inside[first]
    begin = np.nonzero(np.append(True, (number[1:] != number[:-1]) | (inside[1:] != inside[:-1] + 1)))[0]
    runs = {"_id": ids[number[begin]], "start": begins[number[begin]] + inside[begin], "count": np.diff(np.append(begin, len(number)))}
    return pd.concat([alone, pd.DataFrame(runs)], ignore_index=True)


def first_windows(sent: DataFrame) -> DataFrame:
    """The windows of stretches that no earlier window equals, each by itself: ``_id``, ``start`` and ``count`` (1).

    For representatives of any number of stretches: windows are grouped by a 128-bit hash and reduced to the first before they
    meet, so neither many different windows nor many equal ones gather in one task.
    """

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 1024):
                some = batch.iloc[a : a + 1024]
                counts = [len(text) - WINDOW + 1 for text in some["text"]]
                marks = [
                    hashlib.blake2b(text[k : k + WINDOW], digest_size=16).digest()
                    for text, n in zip(map(bytes, some["text"]), counts, strict=True)
                    for k in range(n)
                ]
                inside = [k for n in counts for k in range(n)]
                starts = np.repeat(some["start"].to_numpy(), counts) + np.array(inside, np.int64)
                halves = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
                ids = np.repeat(some["_id"].to_numpy(), counts)
                yield pd.DataFrame({"high": halves[:, 0], "low": halves[:, 1], "_id": ids, "start": starts})

    windows = sent.select("_id", "start", "text").mapInPandas(describe, "high long, low long, _id long, start long")
    firsts = windows.groupBy("high", "low").agg(F.min(F.struct("_id", "start")).alias("at"))
    return firsts.select("at._id", "at.start", F.lit(1).cast("long").alias("count"))


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """Remove from every text, as UTF-8, the bytes covered by a string of ``WINDOW`` bytes that also starts earlier.

    Earlier means in a document of smaller id, or before in the same document; strings are judged on the input. Returns ``doc_id``,
    ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``spans`` (begin and end of each) and ``kept_sha256``.

    A null text is an empty one; shorter texts than a string lose nothing. Ids are whole numbers and name documents: rows that
    repeat an id are taken for repetitions of one document and get the same result each; a null id counts as an id before
    all others. An empty table gives no row; other columns are not read. Stretches that repeat within a chunk are sent once.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(BLOCK_BITS, int(total * CELLS_PER_BYTE).bit_length())
    chunks, buckets = total // CHUNK_BYTES + 1, total // BUCKET_BYTES + 1
    chunk_of = F.pmod(F.xxhash64("_id"), F.lit(chunks))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(chunk_of.alias("chunk"), "_id", "text")
    answers = stage(repeated_cells(rows, chunks, bits, chosen_grams, BLOCK_BITS), "repeated-grams")

    def send(key: tuple, group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_id", kind="stable")
        texts, ids = group["text"].tolist(), group["_id"].to_numpy()
        repeated = RepeatedCells(told, bits, BLOCK_BITS)
        sent: set[bytes] = set()
        out = []
        for begin, end in row_batches(texts):
            data, begins, _, owner, first, count, hashes, twice = stretches(texts[begin:end], repeated)
            view = data.tobytes()
            grams = hashes.view(np.int64)
            for k, (text, a, n) in enumerate(zip(owner.tolist(), first.tolist(), count.tolist(), strict=True)):
                piece = view[a : a + n + WINDOW - 1]
                mark = hashlib.blake2b(piece, digest_size=16).digest()
                if mark not in sent:
                    sent.add(mark)
                    out.append((grams[k], ids[begin + text], a - begins[text], piece, bool(twice[k])))
        made = pd.DataFrame(out, columns=["gram", "_id", "start", "text", "twice"])
        return made.astype({"gram": "int64", "_id": "int64", "start": "int64", "twice": "bool"})

    by_chunk = rows.groupBy("chunk")
    sent = by_chunk.cogroup(answers.groupBy("chunk")).applyInPandas(
        send, "gram long, _id long, start long, text binary, twice boolean"
    )
    sent = stage(sent, "stretches")
    # Representatives with more bytes of stretches than a bucket is meant for; there are at most as many as buckets of text sent.
    hot = sent.groupBy("gram").agg(F.sum(F.octet_length("text")).alias("size")).where(F.col("size") > BUCKET_BYTES).select("gram")
    hot = F.broadcast(stage(hot, "hot-grams"))
    bucket_of = F.pmod(F.xxhash64("gram"), F.lit(buckets)).alias("bucket")
    sorted_firsts = sent.join(hot, "gram", "left_anti").groupBy(bucket_of).applyInPandas(sort_bucket, "_id long, start long, count long")
    firsts = sorted_firsts.union(first_windows(sent.join(hot, "gram", "left_semi")))
    spared = firsts.groupBy("_id").agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    spared = spared.select(chunk_of.alias("chunk"), "_id", F.col("runs.start").alias("starts"), F.col("runs.count").alias("counts"))
    spared = stage(spared, "first-windows")

    def remove(key: tuple, group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        texts, ids = group["text"].tolist(), group["_id"].tolist()
        repeated = RepeatedCells(told, bits, BLOCK_BITS)
        kept = told[told["starts"].notna()]
        runs = {i: (s, c) for i, s, c in zip(kept["_id"], kept["starts"], kept["counts"], strict=True)}
        out = []
        for begin, end in row_batches(texts):
            data, begins, ends, owner, first, count, _, _ = stretches(texts[begin:end], repeated)
            # Windows that start at a byte: +1 at the start of a run of windows, -1 after it; runs of first windows are taken out.
            steps = np.zeros(len(data) + 1, np.int64)
            steps[first] += 1
            steps[first + count] -= 1
            for k in range(begin, end):
                if ids[k] in runs:
                    starts, counts = (np.asarray(x, np.int64) for x in runs[ids[k]])
                    np.subtract.at(steps, begins[k - begin] + starts, 1)
                    np.add.at(steps, begins[k - begin] + starts + counts, 1)
            places = np.nonzero(np.cumsum(steps[:-1]) > 0)[0]
            cover = np.zeros(len(data) + 1, np.int64)
            np.add.at(cover, places, 1)
            np.subtract.at(cover, places + WINDOW, 1)
            gone = np.cumsum(cover[:-1]) > 0
            for k in range(begin, end):
                a, b = begins[k - begin], ends[k - begin]
                mask = gone[a:b]
                edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
                spans = list(zip(np.nonzero(edge > 0)[0].tolist(), np.nonzero(edge < 0)[0].tolist(), strict=True))
                digest = hashlib.sha256(data[a:b][~mask].tobytes()).hexdigest()
                out.append((ids[k], int(b - a), int(mask.sum()), len(spans), spans, digest))
        return pd.DataFrame(out, columns=["_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"])

    none, zero = F.lit(None), F.lit(0).cast("long")
    no_runs = none.cast("array<long>")
    told = answers.select("chunk", "block", "cells", zero.alias("_id"), no_runs.alias("starts"), no_runs.alias("counts"))
    told = told.union(spared.select("chunk", zero, none.cast("binary"), "_id", "starts", "counts"))
    schema = "_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<begin: long, end: long>>, kept_sha256 string"
    result = by_chunk.cogroup(told.groupBy("chunk")).applyInPandas(remove, schema)
    doc_id = F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id")
    return result.select(doc_id, "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256")

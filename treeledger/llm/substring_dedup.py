"""Substring dedup: words in passages that occur earlier, found through a count-min sketch and then grouped exactly."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_batches, sliding_hash, stage, word_hashes
from .sketch import RepeatedCells, repeated_cells

WINDOW = 20
# Text of one chunk of documents, in bytes. The chunks are what answers about windows are sent back to.
CHUNK_BYTES = 8_000_000
# Cells of the sketch per byte of text, about 60 per window: a window that occurs once is taken for a repeated one in less
# than 2 % of the cases. One wide row does better here than several narrow ones, as tasks send only the cells they touch.
CELLS_PER_BYTE = 10
# Cells of the sketch that one task merges (a power of two).
BLOCK_BITS = 28
# Stands for a null id inside the operator, and so comes before every other id.
NO_ID = -(2**63)


def word_windows(texts: list[str], width: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of every text, and for every window of ``width`` words inside one text: text, start, and a 128-bit hash."""
    words = [text.encode().split() for text in texts]
    counts = np.array([len(w) for w in words], np.int64)
    hashes = word_hashes([w for text in words for w in text])
    high = sliding_hash(np.ascontiguousarray(hashes[:, 0]), width)
    low = sliding_hash(np.ascontiguousarray(hashes[:, 1]), width)
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.nonzero(np.arange(len(high)) + width <= ends[: len(high)])[0]
    owner = np.repeat(np.arange(len(words)), counts)[at]
    start = at - (np.cumsum(counts) - counts)[owner]
    return words, owner, start, high[at], low[at]


def _candidates(texts: list[str], answers: pd.DataFrame, bits: int, width: int):
    """Batches of texts with their windows whose cell is repeated: first text, words, and of each window its text, start, hash."""
    repeated = RepeatedCells(answers, bits, BLOCK_BITS)
    for begin, end in row_batches(texts):
        words, owner, start, high, low = word_windows(texts[begin:end], width)
        keep = repeated.hold(high)
        yield begin, words, owner[keep], start[keep], high[keep], low[keep]


def first_places(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Where each of the different 128-bit hashes comes first."""
    if not len(high):
        return np.empty(0, np.int64)
    # The lowest bits make room for the place, so that numbers are sorted and not places by number.
    room = (np.uint64(1) << np.uint64(len(high).bit_length())) - np.uint64(1)
    ordered = (high & ~room) | np.arange(len(high), dtype=np.uint64)
    ordered.sort()
    place = (ordered & room).astype(np.int64)
    upper = ordered & ~room

    def same() -> np.ndarray:
        a, b = high[place], low[place]
        return (a[1:] == a[:-1]) & (b[1:] == b[:-1])

    equal = same()
    if (equal != (upper[1:] == upper[:-1])).any():  # different hashes agree in the bits that were left
        place = np.lexsort((low, high))
        equal = same()
    return place[np.append(True, ~equal)]


def dedup_substrings(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Remove from every text the words covered by a window of ``width`` words that also starts earlier.

    Earlier means in a document of smaller id, or before in the same document; windows are judged on the input. Returns
    ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text`` (the kept words, joined by one space).

    A null text has no words; texts of fewer words than a window lose nothing. Ids are whole numbers and name documents: rows
    that repeat an id are taken for repetitions of one document and get the same result each; a null id counts as an id before
    all others. An empty table gives no row; other columns are not read.

    Three passes over the texts: a count-min sketch of all windows, merged by blocks; the windows whose estimate is two or
    more, grouped by a 128-bit hash of their words; the removal. No window that occurs twice has a lower estimate. A sketch
    has a fixed number of cells per byte and is never in one place: tasks send the cells they touch, and get back which of
    them are repeated. Windows that repeat within a chunk are sent once.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(BLOCK_BITS, int(total * CELLS_PER_BYTE).bit_length())
    chunks = total // CHUNK_BYTES + 1
    chunk_of = F.pmod(F.xxhash64("_id"), F.lit(chunks))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(chunk_of.alias("chunk"), "_id", "text")
    
    def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        _, owner, _, high, _ = word_windows(texts, width)
        return owner, high

    answers = stage(repeated_cells(rows, chunks, bits, hashes, BLOCK_BITS), "repeated-cells")

    def send(key: tuple, group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """The first window of every hash among the chunk's candidates."""
        group = group.sort_values("_id", kind="stable")
        texts = group["text"].tolist()
        ids = group["_id"].to_numpy()
        parts = []
        for begin, _, owner, start, high, low in _candidates(texts, told, bits, width):
            parts.append((ids[begin + owner], start, high, low))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 4
        high, low = columns[2].astype(np.uint64, copy=False), columns[3].astype(np.uint64, copy=False)
        first = first_places(high, low)
        return pd.DataFrame(
            {
                "_id": columns[0][first],
                "start": columns[1][first].astype(np.int32),
                "high": high[first].view(np.int64),
                "low": low[first].view(np.int64),
            }
        )

    by_chunk = rows.groupBy("chunk")
    sent = by_chunk.cogroup(answers.groupBy("chunk")).applyInPandas(send, "_id long, start int, high long, low long")
    # A chunk sends a window once and holds all of a document, so an id occurs once in a group.
    firsts = sent.groupBy("high", "low").agg(F.min("_id").alias("_id"), F.min_by("start", "_id").alias("start"))
    spared = firsts.groupBy("_id").agg(F.collect_list("start").alias("starts"))
    spared = stage(spared.select(chunk_of.alias("chunk"), "_id", "starts"), "first-windows")

    def remove(key: tuple, group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        texts = group["text"].tolist()
        ids = group["_id"].tolist()
        kept = told[told["starts"].notna()]
        first_starts = dict(zip(kept["_id"], kept["starts"], strict=True))
        out = []
        for begin, words, owner, start, _, _ in _candidates(texts, told, bits, width):
            counts = np.array([len(w) for w in words], np.int64)
            ends = np.cumsum(counts)
            bases = ends - counts
            # The windows of all texts that start at a word and earlier somewhere else; every one lies inside its text.
            later = np.zeros(ends[-1] + 1, bool)
            later[bases[owner] + start] = True
            for k, doc_id in enumerate(ids[begin : begin + len(words)]):
                starts = first_starts.get(doc_id)
                if starts is not None:
                    later[bases[k] + starts[starts <= counts[k] - width]] = False
            at = np.nonzero(later)[0]
            steps = np.zeros(ends[-1] + 1, np.int64)
            steps[at] += 1
            steps[at + width] -= 1
            covered = np.cumsum(steps[:-1]) > 0
            gone = np.append(0, np.cumsum(covered))
            for k, removed in enumerate((gone[ends] - gone[bases]).tolist()):
                list_of_words = words[k]
                if removed:
                    list_of_words = list(compress(list_of_words, (~covered[bases[k] : ends[k]]).tolist()))
                text = b" ".join(list_of_words)
                out.append((ids[begin + k], len(list_of_words) + removed, removed, hashlib.sha256(text).hexdigest(), text.decode()))
        return pd.DataFrame(out, columns=["_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    none, zero = F.lit(None), F.lit(0).cast("long")
    told = answers.select("chunk", "block", "cells", zero.alias("_id"), none.cast("array<int>").alias("starts"))
    told = told.union(spared.select("chunk", zero, none.cast("binary"), "_id", "starts"))
    result = by_chunk.cogroup(told.groupBy("chunk")).applyInPandas(
        remove, "_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
    return result.select(
        F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept_text"
    )

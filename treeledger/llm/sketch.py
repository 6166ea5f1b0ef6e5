"""A count-min sketch that is merged in blocks and asked by chunks of documents, and so is never in one place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import row_batches

# Items that a task counts before it sends its part of the sketch.
HELD_ITEMS = 2_000_000

Hashes = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def _cut(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin and end."""
    begins = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0] if len(keys) else np.empty(0, np.int64)
    return begins, np.append(begins[1:], len(keys)) if len(begins) else begins


def _narrow(values: np.ndarray) -> bytes:
    """The width of the largest number in bytes, then all numbers of that width."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(data: bytes) -> np.ndarray:
    width = data[0]
    wide = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return wide.view("<u8").ravel()


def _packed(cells: np.ndarray) -> bytes:
    """Cells of one block, none smaller than the one before, as the steps between them."""
    return _narrow(np.diff(cells.astype("<u8"), prepend=np.uint64(0)))


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_wide(data))


def repeated_cells(docs: DataFrame, chunks: int, bits: int, hashes: Hashes, block_bits: int) -> DataFrame:
    """Cells of the merged sketch that count at least two items, for every chunk those it touches.

    The sketch has 2 ** ``bits`` cells and is merged in blocks of 2 ** ``block_bits``, each by one task.

    ``docs`` has ``chunk`` and ``text``; ``hashes`` gives the items of a list of texts: the number of the text, and a 64-bit hash.

    Tasks send their sketch as the cells they touch and the chunks that touch them, a row for each block, with a bit for what a
    chunk counts twice or more; a block's task adds up what it gets. Counts stop at two, the only thing asked of them, so a very
    frequent item is one entry per task and chunk. The number of rows does not depend on that of the chunks: rows of a block and
    a chunk each would hold about one item once the input has some GB. Returns (``chunk``, ``block``, ``cells``).
    """
    shift = np.uint64(64 - bits)
    upper = np.uint64(block_bits)
    mask = np.uint64((1 << block_bits) - 1)
    chunk_bits = np.uint64(int(chunks - 1).bit_length())
    chunk_mask = (np.uint64(1) << chunk_bits) - np.uint64(1)

    def part(keys: list[np.ndarray]) -> pd.DataFrame:
        merged = np.concatenate(keys)
        keys.clear()
        merged.sort()
        begins, ends = _cut(merged)
        touched, twice = merged[begins], ends - begins > 1
        del merged
        cells, chunk = touched >> chunk_bits, touched & chunk_mask
        block = cells >> upper
        cells &= mask
        begins, ends = _cut(block)
        rows = [
            (number, _packed(cells[begin:end]), _narrow(chunk[begin:end]), np.packbits(twice[begin:end]).tobytes())
            for number, begin, end in zip(block[begins].tolist(), begins.tolist(), ends.tolist(), strict=True)
        ]
        return pd.DataFrame(rows, columns=["block", "cells", "chunks", "twice"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            texts = batch["text"].tolist()
            chunk = batch["chunk"].to_numpy(np.uint64)
            for begin, end in row_batches(texts):
                owner, values = hashes(texts[begin:end])
                held.append(((values >> shift) << chunk_bits) | chunk[begin:end][owner])
                size += len(values)
                if size > HELD_ITEMS:
                    yield part(held)
                    size = 0
        if size:
            yield part(held)

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # A cell, a chunk and the bit in one number each, so that a sort brings the entries of a cell together.
        entries = []
        for cells, chunk, twice in zip(group["cells"], group["chunks"], group["twice"], strict=True):
            cells = _unpacked(cells)
            more = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(cells))
            entries.append((((cells << chunk_bits) | _wide(chunk)) << np.uint64(1)) | more)
        every = np.concatenate(entries)
        del entries
        every.sort()
        cells = every >> (chunk_bits + np.uint64(1))
        repeated = every & np.uint64(1) > 0
        same = cells[1:] == cells[:-1]
        repeated[1:] |= same
        repeated[:-1] |= same
        cells, chunk = cells[repeated], (every[repeated] >> np.uint64(1)) & chunk_mask
        del every, same, repeated
        # The entries of a chunk together; those of one cell and chunk are one.
        found = np.unique((chunk << upper) | cells)
        cells, chunk = found & mask, found >> upper
        begins, ends = _cut(chunk)
        answers = [
            (number, key[0], _packed(cells[begin:end]))
            for number, begin, end in zip(chunk[begins].tolist(), begins.tolist(), ends.tolist(), strict=True)
        ]
        return pd.DataFrame(answers, columns=["chunk", "block", "cells"])

    sketches = docs.select("chunk", "text").mapInPandas(count, "block long, cells binary, chunks binary, twice binary")
    return sketches.groupBy("block").applyInPandas(merge, "chunk long, block long, cells binary")


class RepeatedCells:
    """The repeated cells that a chunk got as its answers; tells for hashes whether their cell is one of them."""

    def __init__(self, answers: pd.DataFrame, bits: int, block_bits: int):
        given = answers[answers["cells"].notna()]
        cells = [
            (np.uint64(block) << np.uint64(block_bits)) | _unpacked(data)
            for block, data in zip(given["block"], given["cells"], strict=True)
        ]
        self.cells = np.unique(np.concatenate(cells)) if cells else np.empty(0, np.uint64)
        self.shift = np.uint64(64 - bits)

    def hold(self, values: np.ndarray) -> np.ndarray:
        if not len(self.cells):
            return np.zeros(len(values), bool)
        cell = values >> self.shift
        # Rising cells are found several times as fast; a cell and its place are sorted as one number where both fit in.
        place_bits = len(values).bit_length()
        if 64 - int(self.shift) + place_bits > 64:
            return self._found(cell)
        low = np.uint64(place_bits)
        ordered = (cell << low) | np.arange(len(cell), dtype=np.uint64)
        ordered.sort()
        held = np.empty(len(cell), bool)
        held[(ordered & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)] = self._found(ordered >> low)
        return held

    def _found(self, cell: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        return self.cells[at] == cell

import random

import numpy as np
import pandas as pd
import pytest

from treeledger.llm import substring_dedup
from treeledger.llm.sketch import RepeatedCells, _unpacked, repeated_cells


def numbers():
    """Items that are given as numbers in the texts; made here, as tasks cannot import this file."""

    def items(texts):
        owner = np.repeat(np.arange(len(texts)), [len(t.split()) for t in texts])
        return owner, np.array([int(w) for t in texts for w in t.split()], np.uint64)

    return items


def documents(spark, rows):
    return spark.createDataFrame(rows, "chunk long, text string").repartition(3)


def test_rows_sent_do_not_grow_with_the_chunks(spark, monkeypatch):
    rng = random.Random(1)
    chunks, bits, block_bits = 500, 12, 9
    rows = [(k % chunks, " ".join(str(rng.getrandbits(64)) for _ in range(8))) for k in range(1500)]
    docs = documents(spark, rows)
    seen = []
    group_by = type(docs).groupBy
    monkeypatch.setattr(type(docs), "groupBy", lambda self, *by: seen.append(self) or group_by(self, *by))
    repeated_cells(docs, chunks, bits, numbers(), block_bits)
    monkeypatch.undo()
    # A row for each block and task; by block and chunk there would be some 2,000 for each task.
    assert seen[0].count() <= 3 << (bits - block_bits)


@pytest.mark.parametrize("chunks", [1, 7, 256, 257])
def test_cells_that_count_two_items(spark, chunks):
    rng = random.Random(chunks)
    bits, block_bits = 12, 9
    rows = [(rng.randrange(chunks), " ".join(str(rng.getrandbits(64)) for _ in range(rng.randint(0, 4)))) for _ in range(600)]
    rows += [(0, str(2**64 - 1)), (chunks - 1, str(2**64 - 1)), (0, "5 5"), (0, "")]
    counts, touched = {}, set()
    for chunk, text in rows:
        for item in text.split():
            cell = int(item) >> (64 - bits)
            counts[cell] = counts.get(cell, 0) + 1
            touched.add((chunk, cell))
    got = []
    for row in repeated_cells(documents(spark, rows), chunks, bits, numbers(), block_bits).collect():
        cells = _unpacked(row.cells).tolist()
        assert cells == sorted(set(cells))
        got += [(row.chunk, (row.block << block_bits) | cell) for cell in cells]
    assert len(got) == len(set(got))
    assert set(got) == {(chunk, cell) for chunk, cell in touched if counts[cell] > 1}


@pytest.mark.parametrize("bits", [12, 61])
def test_hold_finds_the_cells_in_any_order(bits):
    rng = np.random.default_rng(bits)
    values = rng.integers(0, 2**64, 500, np.uint64, endpoint=False)
    held = RepeatedCells(pd.DataFrame({"block": [], "cells": []}), bits, bits)
    assert not held.hold(values).any()
    held.cells = np.unique(values[::3] >> np.uint64(64 - bits))
    expected = np.isin(values >> np.uint64(64 - bits), held.cells)
    assert held.hold(values).tolist() == expected.tolist() and held.hold(values[:0]).tolist() == []


def test_first_places_of_hashes_that_agree_in_part():
    rng = np.random.default_rng(3)
    high = rng.integers(0, 2**64, 6, np.uint64, endpoint=False)
    for several in (high[:4], np.concatenate([high, high ^ np.uint64(1)])):  # neighbours differ in the lowest bit only
        high_of = rng.choice(several, 200)
        for low_of in (high_of, rng.integers(0, 2, 200).astype(np.uint64)):
            first = {}
            for k, pair in enumerate(zip(high_of.tolist(), low_of.tolist(), strict=True)):
                first.setdefault(pair, k)
            assert sorted(substring_dedup.first_places(high_of, low_of).tolist()) == sorted(first.values())
    assert substring_dedup.first_places(high[:0], high[:0]).tolist() == []

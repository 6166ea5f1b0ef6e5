"""Benchmark decontamination: greedy string tiling of documents with the benchmark items they share word sequences with."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_batches, sliding_hash, stage, word_hashes

# Words of the shortest match that counts; an item of fewer words must be matched whole.
LEAST_MATCH = 5
# Share of an item's words that tiles must cover for a document to be contaminated by it.
LEAST_COVERAGE = 0.5
# Distinct word sequences of the benchmark up to which they are sent to every task; beyond, they are joined.
MOST_SENT = 300_000
NO_ID = -(2**63)
_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[bytes]:
    """Runs of letters and digits, lower-cased."""
    return [word.encode() for word in _WORDS.findall(text.lower())]


def hashed(texts: list[str]) -> list[np.ndarray]:
    """The words of every text as 64-bit hashes."""
    words = [words_of(text) for text in texts]
    flat = np.ascontiguousarray(word_hashes([w for text in words for w in text])[:, 0])
    return np.split(flat, np.cumsum([len(w) for w in words])[:-1])


def tiles(doc: np.ndarray, item: np.ndarray, least: int = LEAST_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: non-overlapping matches (place in the document, place in the item, length), longest first.

    Every round looks for the longest matches of words not yet in a tile and marks them all, from the left, where they do not
    overlap; it ends when none of ``least`` words is left. Starts of matches come from running Karp-Rabin hashes of that length.
    """
    least = min(least, len(item))
    if not least or len(doc) < least:
        return []
    starts = defaultdict(list)
    in_item = sliding_hash(item, least)
    in_doc = sliding_hash(doc, least)
    for i in np.nonzero(np.isin(in_doc, in_item))[0].tolist():
        starts[int(in_doc[i])].append(i)
    begins = [(j, i) for j, value in enumerate(in_item.tolist()) for i in starts.get(value, ())]
    words, asked = doc.tolist(), item.tolist()
    used_doc, used_item = np.zeros(len(doc) + 1, bool), np.zeros(len(item) + 1, bool)
    used_doc[-1] = used_item[-1] = True
    found: list[tuple[int, int, int]] = []
    while True:
        longest, at = least, []
        alive = []
        for j, i in begins:
            size = 0
            while not used_item[j + size] and not used_doc[i + size] and asked[j + size] == words[i + size]:
                size += 1
            if size >= least:
                alive.append((j, i))
                if size > longest:
                    longest, at = size, []
                if size == longest:
                    at.append((j, i))
        if not at:
            return found
        begins = alive
        for j, i in at:
            if not used_item[j : j + longest].any() and not used_doc[i : i + longest].any():
                used_item[j : j + longest] = True
                used_doc[i : i + longest] = True
                found.append((i, j, longest))


def coverages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and an item that share a sequence of words: internal ``_id``, ``item_id``, ``n_words``, ``coverage``."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            made = hashed(batch["text"].tolist())
            yield pd.DataFrame(
                {
                    "item_id": batch["item_id"],
                    "width": [min(LEAST_MATCH, len(w)) for w in made],
                    "item": [w.view(np.int64) for w in made],
                    "seeds": [np.unique(sliding_hash(w, min(LEAST_MATCH, len(w)))).view(np.int64) if len(w) else [] for w in made],
                }
            )

    kind = benchmark.schema["item_id"].dataType.simpleString()
    given = benchmark.where(F.col("item_id").isNotNull()).select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    items = given.distinct().mapInPandas(describe, f"item_id {kind}, width int, item array<long>, seeds array<long>")
    items = stage(items.where("width > 0"), "items")
    seeds = stage(items.select("item_id", "width", F.explode("seeds").alias("seed")), "item-seeds")
    widths = [row["width"] for row in seeds.select("width").distinct().collect()]  # at most LEAST_MATCH values
    sent = None
    if seeds.count() <= MOST_SENT:
        known = seeds.select("width", "seed").distinct().collect()
        sent = {w: np.sort(np.array([r["seed"] for r in known if r["width"] == w], np.int64).view(np.uint64)) for w in widths}

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The documents' words, with those sequences that the benchmark has, or all of them where that is not known here."""
        for batch in batches:
            texts = batch["text"].tolist()
            for begin, end in row_batches(texts):
                ids, words, met, wide = [], [], [], []
                for k, doc in enumerate(hashed(texts[begin:end]), begin):
                    for width in widths:
                        here = np.unique(sliding_hash(doc, width))
                        if sent is not None:
                            here = here[np.isin(here, sent[width], assume_unique=True)]
                        if len(here):
                            ids.append(batch["_id"].iloc[k])
                            words.append(doc.view(np.int64))
                            met.append(here.view(np.int64))
                            wide.append(width)
                if ids:
                    yield pd.DataFrame({"_id": ids, "width": wide, "doc": words, "seeds": met})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    touched = rows.mapInPandas(find, "_id long, width int, doc array<long>, seeds array<long>")
    if sent is not None:
        touched = stage(touched, "touched")
    met = touched.select("_id", "width", F.explode("seeds").alias("seed"))
    pairs = stage(met.join(seeds, ["width", "seed"]).select("_id", "item_id").distinct(), "pairs")
    whole = touched.select("_id", "doc").dropDuplicates(["_id"])
    both = pairs.join(whole, "_id").join(items.select("item_id", "item"), "item_id")

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            covered = []
            for doc, item in zip(batch["doc"], batch["item"], strict=True):
                covered.append(sum(size for _, _, size in tiles(doc.view(np.uint64), item.view(np.uint64))))
            made = batch[["_id", "item_id"]].copy()
            made["n_words"] = covered
            made["coverage"] = [c / len(item) for c, item in zip(covered, batch["item"], strict=True)]
            yield made

    return both.mapInPandas(tile, f"_id long, item_id {kind}, n_words int, coverage double")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with ``contaminated``, ``coverage`` and ``item_id`` of the item they cover most, and ``n_items``.

    A document is contaminated when tiles cover at least ``LEAST_COVERAGE`` of an item's words, in any order; ``n_items`` counts such
    items. Ties go to the smaller item id; a document that shares no sequence of words with any item has coverage 0 and a null
    item. Keeps every column, and replaces columns of the added names. Null and empty texts and items share nothing, items
    without an id are not used, equal items count once. Ids are whole numbers and name documents: rows that repeat an id are
    taken for repetitions of one document and get the same result each; a null id is an id of its own. An empty table of
    documents gives no row, an empty benchmark contaminates nothing.
    """
    added = ("contaminated", "coverage", "item_id", "n_items")
    rows = docs.drop(*added, "_id").withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    found = coverages(docs, benchmark)
    order = F.struct((-F.col("coverage")).alias("order"), F.col("item_id"))
    enough = F.col("coverage") >= LEAST_COVERAGE
    best = found.groupBy("_id").agg(F.min(order).alias("best"), F.sum(enough.cast("int")).alias("n_items"))
    best = stage(best.select("_id", (-F.col("best.order")).alias("coverage"), F.col("best.item_id").alias("item_id"), "n_items"), "coverage")
    # Shuffled at any size: what is found grows with the documents, and is not for sending to every task.
    out = rows.join(best.hint("merge"), "_id", "left").drop("_id")
    out = out.withColumn("coverage", F.coalesce("coverage", F.lit(0.0))).withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    return out.withColumn("contaminated", F.col("coverage") >= LEAST_COVERAGE)

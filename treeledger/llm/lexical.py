"""Ranked lexical search: the best documents of every item, found in impact lists by the Best Position Algorithm."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeledger.scratch import materialize

from .common import row_batches

TOP = 50
# Items are searched in blocks of about so many items and bytes of their text; a block's terms go to every task.
ITEMS_PER_BLOCK = 1000
ITEM_BYTES_PER_BLOCK = 4_000_000
# Documents whose impact lists a task builds at once, and cells (document and term) of the table for direct accesses.
DOCS_PER_LISTS = 8192
CELLS = 16_000_000
# Entries read from every list before the threshold is tested again; doubled each time.
FIRST_READ = 8
# Best documents of many tasks meet in so many parts first.
MERGE_PARTS = 64

# Terms are runs of digits, ASCII letters and all characters beyond ASCII; A-Z are lower-cased. In UTF-8 these are bytes.
_FOLDED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return text.encode().translate(_FOLDED).split()


@dataclass
class Questions:
    """A block of items: its terms, and of every item the numbers of its terms."""

    ids: list[int | None]
    terms: list[bytes]
    wanted: list[np.ndarray]


def _question_blocks(items: DataFrame) -> Iterator[Questions]:
    """The items in blocks whose size does not depend on how many there are. Rows that repeat an id are one item of all their terms."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = rows.agg(F.count_distinct(F.coalesce("item_id", F.lit(0))).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = 1 + max(size["n"] // ITEMS_PER_BLOCK, (size["bytes"] or 0) // ITEM_BYTES_PER_BLOCK)
    for k in range(blocks):
        texts: dict[int | None, set[bytes]] = {}
        for row in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect():
            texts.setdefault(row["item_id"], set()).update(terms_of(row["text"]))
        terms = sorted(set().union(*texts.values()))
        number = {term: n for n, term in enumerate(terms)}
        wanted = [np.array(sorted(number[t] for t in found), np.int64) for found in texts.values()]
        yield Questions(list(texts), terms, wanted)


def _postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Of every document: its number of terms ``n``, and which of the given terms it holds (``terms``) how often (``times``)."""
    number = {term: k for k, term in enumerate(terms)}
    width = len(terms) + 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for begin, end in row_batches(texts):
                found = [terms_of(text) for text in texts[begin:end]]
                sizes = np.array([len(words) for words in found])
                ids = np.fromiter((number.get(word, -1) for words in found for word in words), np.int64, sizes.sum())
                keys = np.repeat(np.arange(len(found)), sizes) * width + ids
                keys, times = np.unique(keys[ids >= 0], return_counts=True)
                cuts = np.searchsorted(keys, np.arange(1, len(found)) * width)
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].iloc[begin:end].array,
                        "n": sizes,
                        "terms": np.split((keys % width).astype(np.int32), cuts),
                        "times": np.split(times.astype(np.int32), cuts),
                    }
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(count, "doc_id long, n long, terms array<int>, times array<int>")


@dataclass
class ImpactLists:
    """The inverted lists of some documents, each by falling impact, one after the other; and where a document stands in them."""

    starts: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    place: np.ndarray

    @classmethod
    def build(cls, count: int, width: int, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> ImpactLists:
        order = np.lexsort((docs, -impacts, terms))
        docs, terms, impacts = docs[order], terms[order], impacts[order]
        place = np.full((count, width), -1, np.int32)
        place[docs, terms] = np.arange(len(docs))
        return cls(np.searchsorted(terms, np.arange(width + 1)), docs, impacts, place)

    def search(self, wanted: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents among which are all that can be of the ``k`` best for the wanted terms, their scores, and entries read.

        Best Position Algorithm: the lists are read side by side. For every document met, the other lists are accessed
        directly, which gives its whole score and its positions in them. The best position of a list is the last one before
        which all have been seen, read or accessed. What has not been met scores at most the sum of the impacts at the best
        positions; reading stops when that is strictly below the kth score. ``floor`` is a kth score known from elsewhere.
        """
        begins, ends = self.starts[wanted], self.starts[wanted + 1]
        wanted, begins, ends = (x[begins < ends] for x in (wanted, begins, ends))
        met = np.zeros(len(self.place), bool)
        seen = np.zeros(len(self.docs), bool)
        found, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        best = begins.copy()
        depth, step = 0, FIRST_READ
        while len(wanted):
            places = begins[:, None] + np.arange(depth, depth + step)
            places = places[places < ends[:, None]]
            depth, step = depth + step, 2 * step
            new = self.docs[places]
            new = np.unique(new[~met[new]])
            met[new] = True
            direct = self.place[new[:, None], wanted]
            there = direct >= 0
            seen[direct[there]] = True
            found.append(new)
            scores.append(np.where(there, self.impacts[direct], 0).sum(1))
            every = np.concatenate(scores)
            if len(every) >= k:
                floor = max(floor, int(np.partition(every, len(every) - k)[len(every) - k]))
            # All places read have been seen, as the documents there have been met; the best positions go on from there.
            best = np.minimum(np.maximum(best, begins + depth), ends)
            for n, (at, end) in enumerate(zip(best.tolist(), ends.tolist(), strict=True)):
                if at < end:
                    unseen = seen[at:end].argmin()
                    best[n] = end if seen[at + unseen] else at + unseen
            going = best < ends
            # The impact at the best position itself, the last one before the first unseen entry.
            threshold = int(self.impacts[best[going] - 1].sum())
            if not going.any() or threshold < floor:
                break
        return np.concatenate(found), np.concatenate(scores), int(seen.sum())


def _best(ids: np.ndarray, known: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Which rows are the ``k`` best: by score, then by id, null ids last."""
    return np.lexsort((ids, ~known, -scores))[:k]


def _searched(postings: DataFrame, questions: Questions, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The best documents of every item among those of each task: ``item``, ``doc_id``, ``score`` and ``task``."""
    width = len(questions.terms)
    per_lists = int(min(DOCS_PER_LISTS, max(64, CELLS // max(1, width))))
    wanted = questions.wanted

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
        best = [empty] * len(wanted)
        for batch in batches:
            for begin in range(0, len(batch), per_lists):
                part = batch.iloc[begin : begin + per_lists]
                missing = part["doc_id"].isna().to_numpy()
                ids = part["doc_id"].fillna(0).to_numpy(np.int64)
                sizes = part["terms"].map(len).to_numpy()
                docs = np.repeat(np.arange(len(part)), sizes)
                terms = np.concatenate(part["terms"].to_numpy()).astype(np.int64)
                times = np.concatenate(part["times"].to_numpy()).astype(np.int64)
                if not len(terms):
                    continue
                length = 50 + 50 * part["n"].to_numpy(np.int64) * n_docs // n_terms
                impacts = weights[terms] * (1_000_000_000 * times // (1000 * times + 20 * length[docs]))
                lists = ImpactLists.build(len(part), width, docs, terms, impacts)
                for item, numbers in enumerate(wanted):
                    old_ids, old_known, old_scores = best[item]
                    floor = int(old_scores[-1]) if len(old_scores) == k else 0
                    found, scores, _ = lists.search(numbers, k, floor)
                    good = (scores > 0) & (scores >= floor)
                    if good.any():
                        found = found[good]
                        joined = np.append(old_ids, ids[found]), np.append(old_known, ~missing[found]), np.append(old_scores, scores[good])
                        order = _best(*joined, k)
                        best[item] = joined[0][order], joined[1][order], joined[2][order]
        sizes = [len(scores) for _, _, scores in best]
        columns = [np.concatenate(column) if best else np.empty(0) for column in zip(*best, strict=True)] if best else [[], [], []]
        made = pd.DataFrame({"item": np.repeat(np.arange(len(best)), sizes), "score": columns[2], "task": TaskContext.get().partitionId()})
        made["doc_id"] = pd.Series(columns[0], dtype="Int64").where(pd.Series(columns[1], dtype=bool))
        yield made[["item", "doc_id", "score", "task"]]

    return postings.mapInPandas(search, "item int, doc_id long, score long, task int")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` best documents for every item: ``item_id``, ``rank`` from 1, ``doc_id``, ``score``; equal scores by rising id.

    A score sums, over an item's different terms, the term's weight times its damped frequency in the document (integers
    throughout). Only documents with a score above 0 are ranked. Every row of ``docs`` is a document: repeated rows are ranked
    each by itself, a null id comes after the others of its score. Rows of ``items`` with one id are one item with the terms of
    all, a null id is an id like others. A null or empty text has no term. An empty table on either side gives no row; other
    columns are not read.

    Every task builds the impact lists of the documents at hand, some thousand at a time, and searches them for all items of
    a block, knowing the kth scores that it has found before. Its best documents, ``k`` for an item, meet in two steps.
    """
    out: DataFrame | None = None
    for questions in _question_blocks(items):
        postings = materialize(_postings(docs, questions.terms), "postings")
        sums = postings.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        n_docs, n_terms = sums["docs"], sums["terms"] or 0
        weights = np.full(len(questions.terms), math.floor(1000 * math.log(2 * n_docs + 2)), np.int64)
        for row in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[row["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["count"] + 1)))
        found = _searched(postings, questions, weights, n_docs, max(1, n_terms), k)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        some = Window.partitionBy("item", "part").orderBy(*order)
        found = found.withColumn("part", F.pmod("task", F.lit(MERGE_PARTS)))
        found = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        name = F.element_at(F.array(*[F.lit(i).cast("long") for i in questions.ids] or [F.lit(None).cast("long")]), F.col("item") + 1)
        named = ranked.select(name.alias("item_id"), "rank", "doc_id", "score")
        out = named if out is None else out.unionByName(named)
    assert out is not None
    return out

"""Line dedup: documents that share rare lines are aligned by patience diff, and aligned blocks leave the later document."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

# Lines of fewer characters neither make documents candidates nor count towards the size of a block.
LEAST_LINE = 12
# A line is rare when at most this many documents have it. The rarest shared line of a document counts as rare in any case.
# Plays no part where every shared line makes a pair.
RARE = 50
# An aligned block is deleted when it has this many lines that count, or this many characters in such lines.
BLOCK_LINES = 2
BLOCK_CHARS = 40
NO_ID = -(2**63)


def described_lines(text: str) -> tuple[list[int], list[int]]:
    """Of every line of a text: a 64-bit hash of it without white space around it (0 if nothing is left), and its length."""
    keys, sizes = [], []
    for line in text.split("\n"):
        bare = line.strip()
        keys.append(xxhash.xxh3_64_intdigest(bare.encode()) - (1 << 63) if bare else 0)
        sizes.append(len(bare))
    return keys, sizes


def patience_matches(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Positions of aligned lines, rising on both sides.

    In a stretch of both sides equal lines at its ends are aligned first; then the longest rising chain of lines that occur
    once on each side cuts what remains into smaller stretches. Blank lines (0) are aligned at the ends of stretches only.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(left), 0, len(right))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and left[a] == right[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once_left, once_right = Counter(left[a:b]), Counter(right[c:d])
        place = {left[i]: i for i in range(a, b) if left[i] and once_left[left[i]] == 1}
        common = [(place[right[j]], j) for j in range(c, d) if once_right[right[j]] == 1 and right[j] in place]
        chain = rising_chain(common)
        if not chain:
            continue
        for (i, j), (k, m) in zip([(a - 1, c - 1), *chain], [*chain, (b, d)], strict=True):
            todo.append((i + 1, k, j + 1, m))
        out += chain
    return sorted(out)


def rising_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs that rises in both members; pairs come with rising second members."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for number, (first, _) in enumerate(pairs):
        pile = bisect_left(tops, first)
        before.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(first)
            piles.append(number)
        else:
            tops[pile] = first
            piles[pile] = number
    chain = []
    number = piles[-1] if piles else -1
    while number >= 0:
        chain.append(pairs[number])
        number = before[number]
    return chain[::-1]


def common_blocks(left: list[int], right: list[int], sizes: list[int]) -> list[int]:
    """Lines of the right document in aligned blocks large enough to be deleted; a block is unbroken on both sides."""
    deleted: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for pair in [*patience_matches(left, right), (-9, -9)]:
        if pair != (last[0] + 1, last[1] + 1):
            counted = [sizes[k] for k in block if sizes[k] >= LEAST_LINE]
            if len(counted) >= BLOCK_LINES or sum(counted) >= BLOCK_CHARS:
                deleted += block
            block = []
        block.append(pair[1])
        last = pair
    return deleted


def line_deletions(docs: DataFrame, every_line: bool = False) -> DataFrame:
    """For every document that loses lines: its internal ``_id``, the sorted line numbers (``deleted``), and ``partners``.

    Every shared line points from the documents that have it to the first of them, so a line of any number of documents makes
    one candidate pair per document. With ``every_line`` all shared lines make pairs; without it only rare lines and a
    document's rarest shared line do, and a common passage stays where something rarer is shared as well.
    """
    id_of = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id")

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [described_lines(text) for text in batch["text"]]
            yield pd.DataFrame({"_id": batch["_id"], "keys": [k for k, _ in made], "sizes": [s for _, s in made]})

    rows = docs.select(id_of, F.coalesce("text", F.lit("")).alias("text"))
    lines = stage(rows.mapInPandas(describe, "_id long, keys array<long>, sizes array<int>"), "lines").dropDuplicates(["_id"])
    # Every line once per document, with its document frequency and first document.
    pairs = lines.select("_id", F.explode(F.arrays_zip("keys", "sizes")).alias("line"))
    held = pairs.where(F.col("line.sizes") >= LEAST_LINE).select("_id", F.col("line.keys").alias("key")).distinct()
    held = stage(held, "line-keys")
    facts = held.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min("_id").alias("first")).where("df > 1")
    shared = stage(held.join(facts, "key").where("first < _id").select("_id", "first", "df"), "shared-lines")
    wanted = shared
    if not every_line:
        rarest = shared.groupBy("_id").agg(F.min("df").alias("rarest"))
        wanted = shared.join(rarest, "_id").where((F.col("df") <= RARE) | (F.col("df") == F.col("rarest")))
    wanted = wanted.select("_id", "first").distinct()
    later = lines.select("_id", F.col("keys").alias("later_keys"), "sizes")
    earlier = lines.select(F.col("_id").alias("first"), F.col("keys").alias("earlier_keys"))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = (batch["earlier_keys"], batch["later_keys"], batch["sizes"])
            gone = [common_blocks(a.tolist(), b.tolist(), s.tolist()) for a, b, s in zip(*columns, strict=True)]
            made = pd.DataFrame({"_id": batch["_id"], "first": batch["first"], "deleted": gone})
            yield made[[len(g) > 0 for g in gone]]

    aligned = wanted.join(later, "_id").join(earlier, "first")
    found = aligned.mapInPandas(align, "_id long, first long, deleted array<int>")
    return found.groupBy("_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("deleted")))).alias("deleted"),
        F.array_sort(F.collect_set("first")).alias("partners"),
    )


def without_lines(text: Column, deleted: Column) -> Column:
    """A text without some of its lines."""

    def kept(lines: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), deleted)
        return F.array_join(F.transform(numbers, lambda k: F.get(lines, k)), "\n")

    # As a variable of the outer function the lines are split once, not for every line.
    found = F.get(F.transform(F.array(F.split(text, "\n", -1)), kept), 0)
    return F.when(deleted.isNull(), text).otherwise(found)


def dedup_lines(docs: DataFrame, every_line: bool = False) -> DataFrame:
    """The documents without the blocks of lines that an earlier document has in the same order.

    Earlier is the smaller id. Keeps every column; ``text`` loses the deleted lines, ``n_lines`` (of the input), ``n_deleted`` and
    ``partners`` (ids of the documents it was aligned with and lost lines to) are added, in place of columns of these names. All
    alignments are judged on the input. Lines are compared without white space around them; a null text stays null and has
    no lines, an empty one has one empty line. Ids are whole numbers and name documents: rows that repeat an id are taken for
    repetitions of one document and get the same result each; a null id counts as an id before all others, and shows as null
    among partners. An empty table gives no row. ``every_line`` is that of ``line_deletions``.
    """
    rows = docs.drop("n_lines", "n_deleted", "partners", "_id", "deleted")
    rows = rows.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    found = stage(line_deletions(docs, every_line), "line-deletions")
    # The texts are shuffled at any size: what is found grows with them, and is not for sending to every task.
    joined = rows.join(found.hint("merge"), "_id", "left")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    partners = F.transform(F.coalesce("partners", F.array().cast("array<long>")), lambda p: F.when(p != NO_ID, p))
    kept = joined.withColumns(
        {
            "n_lines": lines,
            "n_deleted": F.coalesce(F.size("deleted"), F.lit(0)),
            "partners": partners,
            "text": without_lines(F.col("text"), F.col("deleted")),
        }
    )
    # The size of a null array is -1 or null, depending on the session.
    kept = kept.withColumn("n_deleted", F.when(F.col("deleted").isNull(), 0).otherwise(F.col("n_deleted")))
    return kept.drop("_id", "deleted")

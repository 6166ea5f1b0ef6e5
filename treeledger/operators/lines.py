"""Line changes of the files of a diff, from base to target.

A line counts when it is not blank, ASCII white space in it makes no difference, and its characters are those of the line
without any white space at its ends. Each distinct pair of blobs is compared once, however many files and commit pairs share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import ZERO_HASH, has_text, snapshot_text
from ..functions.paths import PY_WHITESPACE
from ..scratch import materialize
from . import skew
from .edits import hunks
from .skew import short_list, spread_join

_PAIR = ["base_file_hash", "target_file_hash"]
_KEYS = ["base_commit_hash", "target_commit_hash", "target_path"]
_WITHOUT_SPACE = dict.fromkeys(b"\t\n\x0b\x0c\r ")
_SIZES = "array<struct<chars: bigint, n: bigint>>"
_COUNTS = ["added_lines", "deleted_lines", "added_chars", "deleted_chars"]
# Pairs of texts that one task compares in order, so that neither its sorted rows nor its batch for Python grows with the table.
PAIRS_PER_TASK = 2_000


def line_changes(diff: DataFrame, blobs: DataFrame, reverse: bool = False) -> DataFrame:
    """Lines compared as a multiset: a moved line is no change.

    Characters are those of the added or deleted lines themselves. Where lines that differ in white space only count as one
    line, the longest of a side are the ones that stay.

    One grouping of line digests does the work, so no file has to fit into a task. ``line_changes_ordered`` compares in
    order. ``reverse`` swaps added and deleted.
    """
    diff, pairs = _stored(diff)
    sides = []
    for name, sign in zip(_PAIR, (-1, 1), strict=True):
        lines = materialize(_digests(_texts(blobs, pairs, name)).withColumnRenamed("hash", name), "lines")
        joined = spread_join(
            pairs,
            lines,
            [name],
            [c for c in _PAIR if c != name],
            spread_right=["key"],
        )
        own = F.col("sizes")
        sizes = [own if sign < 0 else F.lit(None).cast(_SIZES), own if sign > 0 else F.lit(None).cast(_SIZES)]
        named = [column.alias(title) for column, title in zip(sizes, ("base_sizes", "target_sizes"), strict=True)]
        sides.append(joined.select(*_PAIR, "key", (F.col("n") * sign).alias("n"), *named))
    per_line = sides[0].unionByName(sides[1]).groupBy(*_PAIR, "key").agg(
        F.sum("n").alias("n"),
        F.first("base_sizes", ignorenulls=True).alias("base_sizes"),
        F.first("target_sizes", ignorenulls=True).alias("target_sizes"),
    )
    gained, lost = F.greatest(F.col("n"), F.lit(0)), F.greatest(-F.col("n"), F.lit(0))
    counts = per_line.groupBy(*_PAIR).agg(
        F.sum(gained).alias("added_lines"),
        F.sum(lost).alias("deleted_lines"),
        F.sum(_smallest("target_sizes", gained)).alias("added_chars"),
        F.sum(_smallest("base_sizes", lost)).alias("deleted_chars"),
    )
    return _per_file(diff, counts, reverse)


def _smallest(sizes: str, number: Column) -> Column:
    """Characters of the shortest ``number`` lines of a side; ``sizes`` rises and says how many lines have each size."""
    zero = F.lit(0).cast("bigint")

    def take(state: Column, size: Column) -> Column:
        taken = F.least(state["left"], size["n"])
        return F.struct((state["left"] - taken).alias("left"), (state["chars"] + taken * size["chars"]).alias("chars"))

    start = F.struct(number.cast("bigint").alias("left"), zero.alias("chars"))
    return F.coalesce(F.aggregate(sizes, start, take, lambda state: state["chars"]), zero)


def line_changes_ordered(diff: DataFrame, blobs: DataFrame, reverse: bool = False) -> DataFrame:
    """Lines compared in order by a longest common subsequence: a moved line is deleted and added.

    Both texts of one changed file meet in one row; nothing larger does.
    """
    diff, stored = _stored(diff)
    schema = ", ".join([*(f"{c} string" for c in _PAIR), *(f"{c} bigint" for c in _COUNTS)])
    counts = _both_texts(stored, blobs).mapInPandas(_compare, schema)
    return _per_file(diff, counts, reverse)


def _stored(diff: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys and hashes of the diff, written out as they are used several times, and the distinct pairs of blobs."""
    diff = materialize(diff.select(*_KEYS, *_PAIR), "diff")
    return diff, materialize(diff.select(*_PAIR).distinct(), "pairs")


def _texts(blobs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Text of every distinct blob on one side."""
    hashes = short_list(pairs.select(F.col(name).alias("hash")).distinct())
    text = snapshot_text(F.col("hash"), F.col("content"))
    found = blobs.join(hashes, "hash", "left_semi").select("hash", text.alias("text"))
    return found.where(has_text(F.col("text")))


def _digests(texts: DataFrame) -> DataFrame:
    """``hash, key, n, sizes``: distinct lines of each blob by the digest of the line without ASCII white space."""
    lines = texts.select("hash", F.explode(F.split("text", "\n")).alias("line"))
    chars: Column = F.char_length(F.btrim("line", F.lit(PY_WHITESPACE))).cast("bigint")
    bare = F.regexp_replace("line", r"\s+", "")
    keyed = lines.select("hash", F.unhex(F.sha1(F.encode(bare, "UTF-8"))).alias("key"), chars.alias("chars"))
    sized = keyed.where(F.col("chars") > 0).groupBy("hash", "key", "chars").agg(F.count(F.lit(1)).alias("n"))
    sizes = F.array_sort(F.collect_list(F.struct("chars", "n"))).alias("sizes")
    return sized.groupBy("hash", "key").agg(F.sum("n").alias("n"), sizes)


def _per_file(diff: DataFrame, counts: DataFrame, reverse: bool) -> DataFrame:
    joined = spread_join(diff, counts, _PAIR, _KEYS, "left", most=diff.count())
    names = [_COUNTS[1], _COUNTS[0], _COUNTS[3], _COUNTS[2]] if reverse else _COUNTS
    zero = F.lit(0).cast("bigint")
    return joined.select(
        *_KEYS[:2],
        F.col("target_path").alias("file_path"),
        *[F.coalesce(source, zero).alias(name) for source, name in zip(names, _COUNTS, strict=True)],
    )


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for base_hash, target_hash, base_text, target_text in batch.itertuples(index=False):
            base, target = _counted_lines(base_text), _counted_lines(target_text)
            deleted, added = _unmatched([k for k, _ in base], [k for k, _ in target])
            rows.append(
                (
                    base_hash,
                    target_hash,
                    len(added),
                    len(deleted),
                    sum(target[i][1] for i in added),
                    sum(base[i][1] for i in deleted),
                )
            )
        yield pd.DataFrame(rows, columns=[*_PAIR, *_COUNTS])


def _counted_lines(text: str | None) -> list[tuple[str, int]]:
    lines = ((line, line.strip()) for line in (text or "").split("\n"))
    return [(line.translate(_WITHOUT_SPACE), len(trimmed)) for line, trimmed in lines if trimmed]


def _unmatched(base: list[str], target: list[str]) -> tuple[list[int], list[int]]:
    """Positions outside a longest common subsequence."""
    changed = hunks(base, target)
    deleted = [i for begin, size, _, _ in changed for i in range(begin, begin + size)]
    return deleted, [j for _, _, begin, size in changed for j in range(begin, begin + size)]


_HUNK = "base_start: bigint, base_lines: bigint, target_start: bigint, target_lines: bigint, deleted_chars: bigint, added_chars: bigint"
HUNK_KEYS = ["base_commit_hash", "target_commit_hash", "base_path", "target_path"]


def diff_hunks(diff: DataFrame, blobs: DataFrame) -> DataFrame:
    """The hunks of every changed file of a diff: its keys, ``hunk`` from 1, where each side's lines begin and how many there
    are, and the characters of the deleted and the added lines (line breaks not counted).

    Lines are compared in order and exactly, by a shortest edit script. An empty side begins with the line that it stands
    after (0: at the front), as in a diff without context. An absent side, or one without text, has no lines. The two texts of one
    changed file meet in one row, nothing larger does; every pair of blobs is compared once.
    """
    diff = materialize(diff.select(*HUNK_KEYS, *_PAIR), "diff")
    pairs = materialize(diff.select(*_PAIR).distinct(), "pairs")
    schema = ", ".join([*(f"{c} string" for c in _PAIR), f"hunks array<struct<{_HUNK}>>"])
    found = _both_texts(pairs, blobs).mapInPandas(_hunks_of, schema)
    joined = spread_join(diff, materialize(found, "hunks"), _PAIR, HUNK_KEYS, most=diff.count())
    each = joined.select(*HUNK_KEYS, F.posexplode("hunks").alias("at", "found"))
    return each.select(*HUNK_KEYS, (F.col("at") + 1).alias("hunk"), "found.*")


def with_hunk_counts(diff: DataFrame, found: DataFrame) -> DataFrame:
    """The diff with ``hunk_line_count`` and ``hunk_char_count`` of each file: its deleted and added lines, and their characters."""
    counts = found.groupBy(*HUNK_KEYS).agg(
        F.sum(F.col("base_lines") + F.col("target_lines")).cast("int").alias("_lines"),
        F.sum(F.col("deleted_chars") + F.col("added_chars")).cast("int").alias("_chars"),
    )
    joined = diff.join(counts, HUNK_KEYS, "left")
    filled = {"hunk_line_count": F.coalesce("_lines", F.lit(0)), "hunk_char_count": F.coalesce("_chars", F.lit(0))}
    return joined.withColumns(filled).select(*diff.columns)


def _both_texts(pairs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Pairs of blobs with the text of both, null where there is none; pairs without any text are left out.

    Contents meet both sides of the pairs in one join that does not sort them, then the texts of a pair meet in one of many small tasks.
    """
    n_pairs = pairs.count()
    sides = F.explode(F.array(*[F.struct(F.lit(name).alias("side"), F.col(name).alias("hash")) for name in _PAIR]))
    # an absent side has no text, and is absent in very many pairs
    asked = pairs.select(*_PAIR, sides.alias("s")).select(*_PAIR, "s.*").where(F.col("hash") != ZERO_HASH)
    if n_pairs <= skew.BROADCAST_ROWS // 4:
        # contents then stay where they are scanned; a row has four hashes' room
        found = blobs.select("hash", "content").join(F.broadcast(asked), "hash")
    else:
        asked = materialize(asked, "asked")
        found = spread_join(asked, blobs.select("hash", "content"), ["hash"], [*_PAIR, "side"], stream_right=True)
    texts = found.select(*_PAIR, "side", snapshot_text(F.col("hash"), F.col("content")).alias("text"))
    tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-n_pairs // PAIRS_PER_TASK))
    # a pair has one row a side, so nothing is combined before the shuffle
    met = texts.where(has_text(F.col("text"))).repartition(tasks, *_PAIR).groupBy(*_PAIR)
    return met.agg(*[F.max(F.when(F.col("side") == name, F.col("text"))).alias(f"{name}_text") for name in _PAIR])


def _lines_of(text: str | None) -> list[str]:
    """Lines of a text; a line break ends a line and begins none."""
    if not text:
        return []
    return text.removesuffix("\n").split("\n")


def _hunks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for base_text, target_text in zip(batch[f"{_PAIR[0]}_text"], batch[f"{_PAIR[1]}_text"], strict=True):
            base, target = _lines_of(base_text), _lines_of(target_text)
            rows = []
            for at, size, other, other_size in hunks(base, target):
                chars = (sum(map(len, side[k : k + n])) for side, k, n in ((base, at, size), (target, other, other_size)))
                rows.append((at + (size > 0), size, other + (other_size > 0), other_size, *chars))
            found.append([dict(zip(_HUNK_NAMES, row, strict=True)) for row in rows])
        yield batch[_PAIR].assign(hunks=pd.Series(found, index=batch.index, dtype=object))


_HUNK_NAMES = [field.split(":")[0].strip() for field in _HUNK.split(",")]

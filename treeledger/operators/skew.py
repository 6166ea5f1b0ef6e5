"""Equi-joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize

# A key is hot from this many rows on; its rows are spread so that a task gets about ROWS_PER_TASK of them.
HOT_FLOOR = 100_000
ROWS_PER_TASK = 50_000
# Parts that rows with a NULL key, which join nothing, are dealt to.
NULL_PARTS = 64
# Largest table sent to every executor, in rows of a few short columns; such a row takes well under 128 bytes in memory.
BROADCAST_ROWS = 500_000


def hot_keys(df: DataFrame, keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """The hot keys of a table with the number of parts for each (``_parts``), from one aggregation of its key columns.

    ``within`` names some of the keys: only rows of those that are hot by themselves are then grouped by all keys.
    """
    if within:
        large = hot_keys(df, within)
        if large.isEmpty():
            return large.select(*[large[k] if k in within else F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys], "_parts")
        df = df.join(large.select(*within), list(within), "left_semi")
    return hot_counts(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), keys, "_rows")


def hot_counts(counts: DataFrame, keys: Sequence[str], rows: str) -> DataFrame:
    """The same from a table that already holds the number of rows per key.

    A stored table: there is one hot key per ``HOT_FLOOR`` rows at most, but no fixed number of them.
    """
    parts = F.ceil(F.col(rows) / F.lit(ROWS_PER_TASK)).cast("int").alias("_parts")
    return materialize(counts.where(F.col(rows) >= HOT_FLOOR).select(*keys, parts), "hot-keys")


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the most frequent key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return counts.agg(F.max("rows")).first()[0] or 0


def short_list(hashes: DataFrame) -> DataFrame:
    """A list of hashes to join contents with: broadcast while it is counted to be short, so that contents stay where they are
    scanned; beyond that each task keeps its part of the list in a hash table, so that contents are shuffled but not sorted.
    """
    return F.broadcast(hashes) if hashes.count() <= BROADCAST_ROWS else hashes.hint("shuffle_hash")


def _marked(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Table with ``_parts``, NULL but for the hot keys; their list is broadcast while it is known to be short."""
    listed = hot.where(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys]))
    if listed.count() <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    return df.join(listed, list(keys), "left")


def _salted(df: DataFrame, hot: DataFrame, keys: Sequence[str], spread: Sequence[str], salt: str) -> DataFrame:
    """Rows of a hot key numbered from 0 to its parts by their own values, so a retried task numbers them the same way.

    Rows with a NULL key join nothing; they are numbered too, so that an outer join does not gather them in one task.
    """
    lonely = reduce(or_, [F.col(k).isNull() for k in keys])
    parts = F.when(lonely, F.lit(NULL_PARTS)).otherwise(F.coalesce("_parts", F.lit(1)))
    number = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), parts).cast("int")
    return _marked(df, hot, keys).withColumn(salt, number).drop("_parts")


def _copied(df: DataFrame, hot: DataFrame, keys: Sequence[str], salt: str) -> DataFrame:
    """Rows of a hot key once per part."""
    salts: Column = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    return _marked(df, hot, keys).withColumn(salt, F.explode(salts)).drop("_parts")


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    spread_right: Sequence[str] = (),
    hot: DataFrame | None = None,
    most: int | None = None,
    most_right: int | None = None,
    stream_right: bool = False,
) -> DataFrame:
    """Join on ``keys`` with the left rows of hot keys spread over several tasks.

    ``spread`` names left columns whose values differ within a key. The right rows of a hot key are repeated per salt,
    which is cheap while the right side has few rows per key. With ``spread_right`` keys that are hot on the right are
    spread the other way round as well (inner joins only).

    Finding hot keys is a job of its own that reads the key columns; without any hot key this is an ordinary join. A caller
    who knows the hot keys of the left side gives them in ``hot``, and one who knows a bound on the rows of a key gives it
    in ``most`` and ``most_right``; a bound below the floor for hot keys spares the job.

    ``stream_right`` is for short left rows and long right ones, such as contents: the left rows of a task are hashed and the right
    ones pass by, so that contents are not sorted (and spilled) for the join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join type {how!r} cannot be spread")
    if spread_right and how != "inner":
        raise ValueError("both sides can be spread in an inner join only")
    if hot is None and (most is None or most >= HOT_FLOOR):
        hot = hot_keys(left, keys)
    hot_right = None
    if spread_right and (most_right is None or most_right >= HOT_FLOOR):
        hot_right = hot_keys(right, keys)
    on = list(keys)
    if hot is not None and not hot.isEmpty():
        left = _salted(left, hot, keys, spread, "_left_salt")
        right = _copied(right, hot, keys, "_left_salt")
        on.append("_left_salt")
    if hot_right is not None and not hot_right.isEmpty():
        right = _salted(right, hot_right, keys, spread_right, "_right_salt")
        left = _copied(left, hot_right, keys, "_right_salt")
        on.append("_right_salt")
    if stream_right:
        left = left.hint("shuffle_hash")
    return left.join(right, on, how).drop("_left_salt", "_right_salt")

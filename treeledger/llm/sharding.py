"""Sharding: documents in corpus order, cut into shards of which the largest is as small as whole groups of equal texts allow."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeledger.operators.skew import hot_counts, spread_join
from treeledger.scratch import materialize

SHARDS = 8
# A number that Spark gives to a row of a sorted table: the partition above these bits, the place in it below them.
PLACE_BITS = 33
# A block of groups that has to be looked into is split into 2 ** SPLIT_BITS; so many blocks at most are split at once.
SPLIT_BITS = 8
SPLIT_BLOCKS = 64


@dataclass(frozen=True)
class Block:
    """Neighbouring groups: those whose number, shifted right by ``shift``, is ``key``."""

    shift: int
    key: int
    groups: int
    rows: int
    size: int


class Blocks:
    """What is known of the ordered groups: blocks of them. Cuts are possible between blocks; within a block of several groups
    they are possible too, but not known yet where."""

    def __init__(self, blocks: list[Block]):
        self.blocks = sorted(blocks, key=lambda block: block.key << block.shift)
        self.edges = [0, *accumulate(block.size for block in self.blocks)]
        self.total = self.edges[-1]

    def inside(self, at: float) -> int | None:
        """The block of several groups that a position is inside of."""
        k = bisect_right(self.edges, at) - 1
        known = k >= len(self.blocks) or self.edges[k] == at or self.blocks[k].groups == 1
        return None if known else k

    def reach(self, start: int, capacity: int, anywhere: bool) -> int:
        """How far a shard that begins at ``start`` gets; ``anywhere``: blocks of several groups may be cut at any place."""
        end = min(start + capacity, self.total)
        if anywhere and self.inside(end) is not None:
            return end
        return max(start, self.edges[bisect_right(self.edges, end) - 1])

    def greedy(self, capacity: int, shards: int, anywhere: bool) -> list[int]:
        """The ends of the shards when each takes as much as it can."""
        ends = [0]
        for _ in range(shards):
            ends.append(self.reach(ends[-1], capacity, anywhere))
        return ends[1:]

    def capacity(self, shards: int, anywhere: bool) -> int:
        """The smallest capacity of which so many shards hold everything, by binary search with the greedy check."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.greedy(middle, shards, anywhere)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def between(self, low: int, high: int) -> set[int]:
        """The blocks of several groups that reach into an interval of positions."""
        first = max(0, bisect_right(self.edges, low) - 1)
        last = min(len(self.blocks), bisect_left(self.edges, high) + 1)
        return {k for k in range(first, last) if self.blocks[k].groups > 1}

    def even_cuts(self, capacity: int, shards: int) -> tuple[list[int], set[int]]:
        """The ends of all shards but the last, as edges, and the blocks that better cuts may be in.

        No shard exceeds the capacity. Within that, every shard takes its even part of what is left, as near as it gets.
        """
        least = [self.total]
        for _ in range(shards - 1):
            least.append(self.edges[bisect_left(self.edges, least[-1] - capacity)])
        cuts: list[int] = []
        unknown: set[int] = set()
        start = 0
        for k in range(shards - 1):
            # No shard stays empty while there are groups; taking more leaves less for the others.
            after = self.edges[min(bisect_right(self.edges, start), len(self.blocks))]
            low = max(after, least[shards - 1 - k])
            high = start + capacity
            wish = min(max(start + (self.total - start) / (shards - k), low), high)
            if (block := self.inside(wish)) is not None:
                unknown.add(block)
            near = bisect_left(self.edges, wish)
            found = [e for e in self.edges[max(0, near - 1) : near + 1] if low <= e <= high]
            start = min(found or [low], key=lambda edge: (abs(edge - wish), edge))
            cuts.append(start)
        return cuts, unknown


def _block_key(shift: int) -> Column:
    return F.shiftright("number", shift)


def _summed(groups: DataFrame, shift: int) -> list[Block]:
    found = groups.groupBy(_block_key(shift).alias("key")).agg(F.count(F.lit(1)).alias("groups"), F.sum("rows").alias("rows"), F.sum("size").alias("size"))
    return [Block(shift, row["key"], row["groups"], row["rows"], row["size"]) for row in found.collect()]


def _split(groups: DataFrame, known: Blocks, chosen: set[int]) -> Blocks:
    """The same groups with the largest of the chosen blocks split, by one aggregation of these blocks' groups for each size of block."""
    largest = sorted(chosen, key=lambda k: (-known.blocks[k].size, k))[:SPLIT_BLOCKS]
    blocks = [block for k, block in enumerate(known.blocks) if k not in set(largest)]
    for shift in sorted({known.blocks[k].shift for k in largest}):
        keys = sorted(known.blocks[k].key for k in largest if known.blocks[k].shift == shift)
        # The range lets the scan skip row groups: the table is sorted by the number.
        in_range = F.col("number").between(keys[0] << shift, ((keys[-1] + 1) << shift) - 1)
        blocks += _summed(groups.where(in_range & _block_key(shift).isin(keys)), max(0, shift - SPLIT_BITS))
    return Blocks(blocks)


def partition_groups(groups: DataFrame, shards: int) -> tuple[int, list[tuple[int | None, int]]]:
    """The smallest capacity of which ``shards`` shards hold all groups in order, and where each shard but the first begins.

    ``groups`` has ``number`` (increasing along the order), ``rows`` and ``size``. A beginning is the number of its first group
    (null: there is none left) and the number of rows before it. The groups stay in Spark: the driver sees sums of blocks,
    and splits only blocks that a cut may be in, until the capacities with and without cuts inside them agree.
    """
    known = Blocks(_summed(groups, PLACE_BITS))
    # Places in a partition take as many bits as its largest one needs; the bits above them are all zero.
    bits = max((block.groups for block in known.blocks), default=1).bit_length()
    fitted = [Block(bits, block.key << (PLACE_BITS - bits), block.groups, block.rows, block.size) for block in known.blocks]
    known = Blocks(fitted)
    while True:
        least, most = (known.capacity(shards, anywhere) for anywhere in (True, False))
        if least == most:
            break
        lows = known.greedy(least, shards, False)
        highs = known.greedy(most, shards, True)
        chosen = set().union(*(known.between(low, high) for low, high in zip(lows, highs, strict=True)))
        known = _split(groups, known, chosen)
    while True:
        cuts, unknown = known.even_cuts(most, shards)
        if not unknown:
            break
        known = _split(groups, known, unknown)
    rows = [0, *accumulate(block.rows for block in known.blocks)]
    begins: list[tuple[int | None, int]] = []
    for cut in cuts:
        k = bisect_left(known.edges, cut)
        begins.append((known.blocks[k].key << known.blocks[k].shift if k < len(known.blocks) else None, rows[k]))
    return most, begins


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every document's shard and slot: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    ``size`` is the number of UTF-8 bytes of the text and 1 more. Documents of equal text stay together. Groups are ordered by
    their smallest id (then by the text's hash) and cut into ``shards`` runs; the largest run is as small as any such cut can
    make it, and the others are as even as that allows. A group that alone exceeds an even part fills a shard of its own.
    ``slot`` numbers a shard's documents from 0 by group, id and place in the table. ``law`` is ``bytes``: sizes are
    evened out, so ``grown_shard`` is null. A null text is an empty one; null ids come first; repeated rows are documents of their own;
    an empty table gives no row; with fewer groups than shards some shards stay empty; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("mark"),
        F.monotonically_increasing_id().alias("place"),
    )
    sized = materialize(sized, "sized")
    merged = sized.groupBy("mark").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size"))
    ordered = merged.orderBy(F.asc_nulls_first("first"), "mark")
    groups = materialize(ordered.select(F.monotonically_increasing_id().alias("number"), "mark", "rows", "size"), "groups")
    _, begins = partition_groups(groups, shards)

    hot = hot_counts(groups, ["mark"], "rows")
    found = spread_join(sized, groups.select("mark", "number"), ["mark"], ["place"], hot=hot)
    sort = found.select("doc_id", "size", "text_crc32", "number", "place").orderBy("number", F.asc_nulls_first("doc_id"), "place")
    rows = materialize(sort.select("doc_id", "size", "text_crc32", "number", F.monotonically_increasing_id().alias("row")), "ordered")
    # A row's rank among all: its place in its partition after the rows of the partitions before, of which there are few.
    part = F.shiftright("row", PLACE_BITS).alias("part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = rows.withColumn("part", part).join(F.broadcast(sizes), "part")
    rank = F.col("before") + F.col("row").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    number, start = F.lit(0), F.lit(0).cast("long")
    for k, (first, rows_before) in enumerate(begins, 1):
        if first is not None:
            number = F.when(F.col("number") >= first, k).otherwise(number)
            start = F.when(F.col("number") >= first, F.lit(rows_before).cast("long")).otherwise(start)
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        number.cast("int").alias("shard"),
        (rank - start).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

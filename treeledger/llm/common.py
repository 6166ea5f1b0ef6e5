"""Helpers shared by the text operators: tables, chunks of work, word hashes, connected components."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.scratch import materialize

# Characters of text handled at once inside a task; what a task holds in memory is a small multiple of it.
TEXT_SIZE = 2_000_000
# Odd multiplier of the polynomial hashes over words.
BASE = np.uint64(0x9E3779B97F4A7C15)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a step to the shared folder and let go of the shuffle files that made it.

    Spark drops the shuffle files of a finished step once the driver has collected the objects that stand for it: first those
    that Python let go of, then those that they alone referred to.
    """
    table = materialize(df, label)
    for _ in range(2):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.1)
    return table


def row_batches(texts: list[str], limit: int = TEXT_SIZE) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into runs of about ``limit`` characters; a longer text stands alone."""
    begin = size = 0
    for k, text in enumerate(texts):
        if k > begin and size + len(text) > limit:
            yield begin, k
            begin, size = k, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 128-bit hash of every word, as two columns of unsigned 64-bit numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, so that any of them can choose a bucket."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def sliding_hash(values: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of every run of ``width`` neighbours; none where there are fewer."""
    count = len(values) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(width):
        out = out * BASE + values[k : k + count]
    return mix(out)


def components(links: DataFrame, label: str) -> DataFrame:
    """Connected components of links (``a``, ``b``): ``node`` and ``root``, its smallest reachable node.

    Large-star and small-star steps in turn (Kiveris et al., 2014), each written to the shared folder, until the links no
    longer change. Every step groups links by one of their ends and points the group at its smallest member; a node with
    very many links is reduced by partial aggregation and joined as a skewed key, never gathered.
    """
    empty = F.col("a").isNull() | F.col("b").isNull() | (F.col("a") == F.col("b"))
    ordered = links.where(~empty).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(ordered.distinct(), label)
    before = None
    while True:
        # Large star: every neighbour above a node is linked to the smallest of the node and its neighbours.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # Small star: a node's smaller neighbours, and the node, are linked to the smallest of them.
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        edges = materialize(small.union(low.select("a", F.col("low").alias("b"))).distinct(), label)
        seen = edges.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("b").cast("decimal(38,0)")).alias("total"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark"),
        ).first()
        if seen == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = seen


def text_column(name: str = "text") -> Column:
    """A text with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))

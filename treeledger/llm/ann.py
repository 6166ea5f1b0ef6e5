"""Approximate nearest neighbours: an inverted-list index whose lists are scanned by adaptive dimension sampling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

# Vectors on which the index is fitted, those of smallest hashed id; every vector is indexed.
SAMPLE = 10_000
# Sample vectors whose true neighbours within the sample decide how many lists a query probes.
CALIBRATED = 500
# Share of those neighbours that lie in the probed lists.
TARGET_RECALL = 0.97
# Vectors a list holds on average, and the most lists.
LIST_SIZE = 500
MOST_LISTS = 4096
# Vectors of a list that one task scans, and queries it scans them for: larger lists are split.
BLOCK_ROWS = 4096
BLOCK_QUERIES = 2048
# Columns scanned between two tests, and the width of the test: a vector is abandoned when its scaled partial distance is
# beyond the current k-th distance by this many standard errors.
BLOCK_COLUMNS = 8
TEST_WIDTH = 3.0


@dataclass(frozen=True)
class Index:
    """Unit centroids of the lists, a random rotation, and the number of lists a query probes."""

    centroids: np.ndarray
    rotation: np.ndarray
    probes: int


def usable(vector: Column) -> Column:
    """Whether a vector is not null, has only finite components and is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision; scaled first, so that no component is too large or small to square."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(1, keepdims=True))


def fit_index(sample: np.ndarray, rows: int, k: int) -> Index:
    """Lists by spherical k-means on the sample, and as many probes as reach the target recall within the sample."""
    rng = np.random.default_rng(7)
    dims = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    count = max(1, min(MOST_LISTS, rows // LIST_SIZE, len(sample) // 4))
    centroids = sample[rng.choice(len(sample), count, replace=False)].copy()
    for _ in range(8):
        nearest = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centroids = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centroids)
    owner = (sample @ centroids.T).argmax(1)
    tried = sample[:CALIBRATED]
    near = tried @ sample.T
    near[np.arange(len(tried)), np.arange(len(tried))] = -np.inf
    wanted = min(k, len(sample) - 1)
    if wanted < 1:
        return Index(centroids, rotation, count)
    best = np.argpartition(-near, wanted - 1, axis=1)[:, :wanted]
    order = np.argsort(-(tried @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(count)[None, :].repeat(len(tried), 0), 1)
    needed = np.sort(np.take_along_axis(place, owner[best], 1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(TARGET_RECALL * len(needed))))]) + 1
    return Index(centroids, rotation, probes)


def scan(columns: list[np.ndarray], query: list[np.ndarray], dims: int, k: int) -> np.ndarray:
    """Positions of the vectors that may be among the ``k`` nearest of a query in a block.

    ``columns`` and ``query`` are cut into the same column blocks. The first vectors give the distance to beat; of the others the
    squared distance over the columns seen so far, scaled to all columns, is tested after every block.
    """
    rows = len(columns[0])
    lead = min(rows, 4 * k)
    start = np.zeros(lead)
    for block, part in zip(columns, query, strict=True):
        gap = block[:lead] - part
        start += np.einsum("ij,ij->i", gap, gap)
    bound = np.partition(start, k - 1)[k - 1] if lead >= k else np.inf
    alive = np.arange(rows)
    partial = np.zeros(rows)
    seen = 0
    for block, part in zip(columns, query, strict=True):
        gap = (block if len(alive) == rows else block[alive]) - part
        partial = partial + np.einsum("ij,ij->i", gap, gap)
        seen += block.shape[1]
        slack = 1.0 if seen >= dims else (1.0 + TEST_WIDTH / np.sqrt(seen)) ** 2 * seen / dims
        keep = partial <= bound * slack + 1e-9
        alive, partial = alive[keep], partial[keep]
    if len(alive) > k:
        limit = np.partition(partial, k - 1)[k - 1] + 1e-9
        alive = alive[partial <= limit]
    return alive


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 5, identifier: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The ``k`` nearest vectors found for every query, by cosine: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Queries are the rows for which ``is_query`` holds; a query's own row is no candidate. The nearest comes first, ties go to the
    smaller id; with fewer candidates all found are returned. The score is computed from the original vectors in double precision.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id and vectors whose
    dimension is not the most frequent one (the larger of two equally frequent). Rows that repeat an id are one vector, the
    smallest. An empty table gives no row; other columns are not read. The index (centroids, rotation) is fitted on a sample of
    bounded size; every vector is indexed, and large lists are scanned in blocks of bounded size.
    """
    source = vectors.withColumn("_query", F.coalesce(is_query, F.lit(False)))
    source = source.select(F.col(identifier).cast("long").alias("vec_id"), F.col(column).alias("embedding"), "_query")
    source = source.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sizes = source.groupBy(F.size("embedding").alias("dims")).count()
    usual = sizes.agg(F.max(F.struct("count", "dims")).alias("top")).first()["top"]
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return spark.createDataFrame([], result)
    dims, rows = usual["dims"], usual["count"]
    source = source.where(F.size("embedding") == dims)
    source = source.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("_query").alias("_query"))
    source = stage(source, "vectors")
    picked = source.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    index = fit_index(unit(np.array([row[0] for row in picked], np.float64)), rows, k)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch["list"] = (unit(np.stack(batch["embedding"])) @ index.centroids.T).argmax(1).astype(np.int32)
                yield batch

    kind = source.schema["embedding"].dataType.simpleString()
    listed = stage(source.mapInPandas(assign, f"vec_id long, embedding {kind}, _query boolean, list int"), "lists")

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = unit(np.stack(batch["embedding"])) @ index.centroids.T
                lists = np.argsort(-near, axis=1, kind="stable")[:, : index.probes]
                yield pd.DataFrame({"query_id": batch["vec_id"], "asked": batch["embedding"], "lists": list(lists.astype(np.int32))})

    asked = listed.where("_query").select("vec_id", "embedding").mapInPandas(probe, f"query_id long, asked {kind}, lists array<int>")
    asked = stage(asked, "queries").withColumn("list", F.explode("lists")).drop("lists")

    # Lists, and the queries of a list, are split into blocks by counts; there is one count per list.
    def parts(counts: DataFrame, rows_per_block: int) -> DataFrame:
        return counts.select("list", F.ceil(F.col("count") / rows_per_block).cast("int").alias("parts"))

    blocks = parts(listed.groupBy("list").count(), BLOCK_ROWS).withColumnRenamed("parts", "blocks")
    shares = parts(asked.groupBy("list").count(), BLOCK_QUERIES).withColumnRenamed("parts", "shares")
    counts = F.broadcast(stage(blocks.join(shares, "list"), "list-sizes"))  # one row per list, at most MOST_LISTS
    candidates = listed.join(counts, "list").select(
        "list",
        F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
        "vec_id",
        "embedding",
    )
    questions = asked.join(counts, "list").select(
        "list",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("query_id"), F.col("shares")).cast("int").alias("share"),
        "query_id",
        "asked",
    )

    def search(key: tuple, block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if block.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        ids = block["vec_id"].to_numpy()
        original = np.stack(block["embedding"]).astype(np.float64)
        lengths = np.sqrt((original * original).sum(1))
        turned = unit(original) @ index.rotation
        cuts = range(0, dims, BLOCK_COLUMNS)
        columns = [np.ascontiguousarray(turned[:, c : c + BLOCK_COLUMNS]) for c in cuts]
        found = []
        questions = np.stack(queries["asked"]).astype(np.float64)
        rotated = unit(questions) @ index.rotation
        for query_id, vector, point in zip(queries["query_id"], questions, rotated, strict=True):
            near = scan(columns, [point[c : c + BLOCK_COLUMNS] for c in cuts], dims, k + 1)
            near = near[ids[near] != query_id]
            score = (original[near] @ vector) / (lengths[near] * np.sqrt((vector * vector).sum()))
            first = np.lexsort((ids[near], -score))[:k]
            found.append((np.full(len(first), query_id), ids[near][first], score[first]))
        query_id, vec_id, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": score})

    key = ["list", "block", "share"]
    hits = candidates.groupBy(*key).cogroup(questions.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

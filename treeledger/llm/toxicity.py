"""Toxicity: severity grades by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeledger.scratch import materialize

from .common import text_column

# Labelled documents per grade on which the model is fitted, those of smallest hashed id.
TRAINING_DOCS = 6000
# Lengths of the word beginnings that count as features beside whole words.
BEGINNINGS = (3, 4, 5, 6)
# A feature is used when it is this many standard errors more frequent in documents graded above 0, and among the first
# MOST_FEATURES by that measure.
LEAST_SCORE = 7.0
MOST_FEATURES = 4000
RIDGE = 0.0001
ROUNDS = 400
# Probability of a grade above 0 from which a document counts as toxic.
CUT = 0.5
_WORDS = re.compile(r"[^\W\d_]+")


def features_of(text: str) -> set[str]:
    """The distinct words of a text, lower-cased runs of letters, and the beginnings of longer words, marked by a star."""
    words = set(_WORDS.findall(text.lower()))
    found = set(words)
    for size in BEGINNINGS:
        found.update(word[:size] + "*" for word in words if len(word) > size)
    return found


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade > k) = sigmoid(sum of weights - thresholds[k]): one weight per feature, shared by rising thresholds."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def above(self, sums: np.ndarray) -> np.ndarray:
        """Probabilities of a grade above 0, above 1, ... for documents of given weighted sums."""
        return link(sums, self.thresholds)


def link(sums: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(thresholds[None, :] - sums[:, None], -40, 40)))


def fit_ordinal(
    rows: list[list[int]], grades: np.ndarray, importance: np.ndarray, feature_count: int, grade_count: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest likelihood, with a ridge on the weights, by full-batch Adam.

    ``rows`` lists the features that occur in a document. Thresholds are the first one and the logarithms of the gaps that
    follow, so they stay in order; a grade that does not occur only feels the small ridge on them.
    """
    count = len(rows)
    column = np.array([f for row in rows for f in row], np.int64)
    owner = np.repeat(np.arange(count), [len(row) for row in rows])
    importance = importance / importance.mean()
    links = grade_count - 1
    weights, shape = np.zeros(feature_count), np.zeros(links)
    index = np.arange(count)
    moments = [np.zeros(feature_count), np.zeros(feature_count), np.zeros(links), np.zeros(links)]
    for step in range(1, ROUNDS + 1):
        above = link(np.bincount(owner, weights[column], count), _thresholds(shape))
        # P(grade = k) is the difference of neighbouring cumulative probabilities.
        padded = np.concatenate([np.ones((count, 1)), above, np.zeros((count, 1))], 1)
        slope = padded * (1 - padded)
        likelihood = np.maximum(padded[index, grades] - padded[index, grades + 1], 1e-9)
        low, high = (slope[index, grades + k] / likelihood * importance / count for k in (0, 1))
        d_weights = np.bincount(column, (low - high)[owner], feature_count) - RIDGE * weights
        d_threshold = np.bincount(grades + 1, high, links + 2)[1:-1] - np.bincount(grades, low, links + 2)[1:-1]
        tail = np.cumsum(d_threshold[::-1])[::-1]
        d_shape = tail * np.concatenate([[1.0], np.exp(shape[1:])]) - 0.001 * shape
        for k, (gradient, value) in enumerate(((d_weights, weights), (d_shape, shape))):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * gradient
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * gradient**2
            value += 0.05 * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-6)
    return weights, _thresholds(shape)


def _thresholds(shape: np.ndarray) -> np.ndarray:
    return shape[0] + np.concatenate([[0.0], np.cumsum(np.exp(shape[1:]))])


def fit(
    docs: DataFrame, grades: DataFrame, grade_count: int, limit: int = TRAINING_DOCS, split_by_evidence: bool = False
) -> OrdinalModel:
    """Fit on up to ``limit`` documents of every grade. ``grades`` has ``doc_id`` and ``grade`` from 0 to ``grade_count`` - 1.

    With ``split_by_evidence`` labels say only whether a document is toxic (0 or 1), and severity is taken from the evidence:
    documents labelled 1 get the grades 1 to ``grade_count`` - 1, in groups of equal size, by how many of the used features they
    hold.

    Documents of a grade are weighted so that all its labelled documents count. Of several grades of an id the highest counts;
    rows with a null id or grade, and ids without a text, are not used. Where no feature sets the grades apart, or none
    but one grade occurs, every document gets severity 0. Only the used features of the sample come to the driver.
    """
    spark = docs.sparkSession
    known = grades.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, grade_count - 1))
    known = known.groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    order = Window.partitionBy("grade").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= limit).drop("_place")
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    sample = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "grade", "text")

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = batch[["doc_id", "grade"]].copy()
            made["features"] = [sorted(features_of(text)) for text in batch["text"]]
            yield made

    kind = docs.schema["doc_id"].dataType.simpleString()
    described = sample.mapInPandas(describe, f"doc_id {kind}, grade int, features array<string>")
    described = materialize(described.dropDuplicates(["doc_id"]), "features")
    per_grade = {row["grade"]: row["n"] for row in described.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    everywhere = {row["grade"]: row["n"] for row in known.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, graded = per_grade.get(0, 0), sum(n for g, n in per_grade.items() if g)
    nothing = OrdinalModel({}, np.full(grade_count - 1, 40.0))
    if not clean or not graded:
        return nothing
    counts = described.select("grade", F.explode("features").alias("feature")).groupBy("feature")
    counts = counts.agg(F.sum(F.expr("int(grade > 0)")).alias("a"), F.sum(F.expr("int(grade = 0)")).alias("b"))
    share = (F.col("a") + F.col("b")) / (clean + graded)
    error = F.sqrt(share * (1 - share) * (1 / clean + 1 / graded))
    scored = counts.where(share < 1).select("feature", ((F.col("a") / graded - F.col("b") / clean) / error).alias("score"))
    best = scored.where(F.col("score") >= LEAST_SCORE).orderBy(F.col("score").desc(), "feature").limit(MOST_FEATURES)
    names = [row["feature"] for row in best.collect()]
    if not names:
        return nothing
    used = F.broadcast(spark.createDataFrame([(name, k) for k, name in enumerate(names)], "feature string, number int"))
    pairs = described.select("doc_id", F.explode("features").alias("feature")).join(used, "feature")
    rows = described.select("doc_id", "grade").join(pairs.groupBy("doc_id").agg(F.collect_list("number").alias("numbers")), "doc_id", "left")
    found = sorted(rows.collect(), key=lambda row: row["doc_id"])
    labels = np.array([row["grade"] for row in found])
    numbers = [sorted(row["numbers"] or []) for row in found]
    sampled = labels
    if split_by_evidence:
        held = np.array([len(row) for row in numbers])
        cuts = np.quantile(held[labels > 0], np.arange(1, grade_count - 1) / (grade_count - 1))
        sampled = np.where(labels > 0, 1 + np.searchsorted(cuts, held, "left"), 0)
    scale = np.array([everywhere.get(g, 0) / max(1, per_grade.get(g, 0)) for g in range(grade_count)])
    weights, thresholds = fit_ordinal(numbers, sampled, scale[labels], len(names), grade_count)
    return OrdinalModel(dict(zip(names, weights.tolist(), strict=True)), thresholds)


def predict(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``doc_id``, ``severity`` (expected grade), ``p_toxic`` (probability of a grade above 0) and ``toxic`` for every document.

    A null text is an empty one. Rows are independent of each other: repeated rows get equal results, null ids stay null, an
    empty table gives no row; other columns are not read.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = model.weights
        for batch in batches:
            sums = [sum(sorted(weights[f] for f in features_of(text) & weights.keys())) for text in batch["text"]]
            above = model.above(np.array(sums, float))
            made = batch[["doc_id"]].copy()
            made["severity"] = above.sum(1)
            made["p_toxic"] = above[:, 0]
            made["toxic"] = above[:, 0] >= CUT
            yield made

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_column().alias("text"))
    return rows.mapInPandas(score, f"doc_id {kind}, severity double, p_toxic double, toxic boolean")

"""A training corpus from raw documents: language, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, folder of tables) and works on all documents that the stage before it kept. All but the last
return the columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm import decontaminate, language_id, line_dedup, near_dup, packing
from treeledger.llm.common import read_table, stage
from treeledger.llm.queries import vocabulary_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets ``lang`` to the language found. Documents without one (no text, no letters) go; without any labelled document, on
    which the model could be fitted, all stay as they are."""
    model = language_id.fit(language_id.training_rows(docs.where(~language_id.held_out())))
    if not model.languages:
        return docs
    found = language_id.predict(docs, model, keep_text=True)
    return found.where(F.col("lang_pred") != language_id.UNDETERMINED).withColumn("lang", F.col("lang_pred")).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has leave the text; a document of which nothing but white space is left goes."""
    found = line_dedup.dedup_lines(docs, every_line=True)
    left = (F.col("n_deleted") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return found.where(left).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near-duplicates the document of smallest id stays, once; of rows that repeat an id one stays."""
    kept = stage(near_dup.near_duplicates(docs).where("kept").select("doc_id"), "kept-documents")
    unique = kept.distinct().hint("merge")
    found = docs.alias("d").join(unique.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")
    if kept.groupBy("doc_id").count().where("count > 1").isEmpty():
        return found.select(docs.columns)
    return found.dropDuplicates(["doc_id"]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that tile at least half of the words of a benchmark item."""
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.pack(docs, vocabulary_path(), added_tokens=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# The stages have no counterpart in SQL; tests/llm/test_pipeline.py holds them against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written to the shared folder before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

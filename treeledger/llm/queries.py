"""The registered queries of the text operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann,
    decontaminate,
    html_text,
    language_id,
    lexical,
    line_dedup,
    near_dup,
    packing,
    sharding,
    substring_dedup,
    suffix_dedup,
    token_alignment,
    toxicity,
)
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_path() -> str:
    """The public byte-level vocabulary of the packing contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_vocabulary_path() -> str:
    """The public piece vocabulary of the alignment contract."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(language_id.training_rows(docs.where(~language_id.held_out())))
    labelled = language_id.predict(docs.select("doc_id", "text"), model)
    return labelled.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "spans")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary_path(), added_tokens=True)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(read_table(spark, sf_dir, "documents")).drop("spans")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return line_dedup.dedup_lines(docs, every_line=True).select("doc_id", "n_lines", "n_deleted", "partners", kept)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read_table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark")).drop("text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 (not toxic), 1 and 2 (toxic, with less and with more evidence): ``labels`` tells only toxic from clean."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))
    return toxicity.predict(docs, toxicity.fit(docs, labels, grade_count=3, split_by_evidence=True))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(read_table(spark, sf_dir, "documents")).drop("kept_text")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"), shards=8)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=50)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(read_table(spark, sf_dir, "documents"), vocabulary_path(), piece_vocabulary_path())


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_language_id,
        op2_best_fit_packing,
        op3_suffix_dedup,
        op4_line_dedup,
        op5_html_text,
        op6_decontamination,
        op7_toxicity,
        op8_near_dedup,
        op9_nearest_neighbours,
        op10_substring_dedup,
        op11_sharding,
        op12_lexical_search,
        op13_token_alignment,
    )
}

# Ties in score and id are not possible in the driver's tables, whose ids are distinct.
ORACLE_SQL: dict[str, str] = {
    "op12_lexical_search": r"""
WITH terms AS (
 SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
wanted AS (
 SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY ALL),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
weights AS (
 SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term),
scores AS (
 SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // corpus.terms)))) AS BIGINT) AS score
 FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), corpus GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
 SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) r WHERE rank <= 50
""",
}

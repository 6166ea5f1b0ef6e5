"""Repository tables in Parquet or in the catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .. import schemas

_SCHEMAS = {
    "commits": schemas.COMMITS,
    "commit_parents": schemas.COMMIT_PARENTS,
    "refs": schemas.REFS,
    "tree_entries": schemas.TREE_ENTRIES,
    "blobs": schemas.BLOBS,
}


@dataclass(frozen=True)
class RepoTables:
    """Commits, history, branches, trees and contents of any number of repositories."""

    commits: DataFrame
    commit_parents: DataFrame
    refs: DataFrame
    tree_entries: DataFrame
    blobs: DataFrame


def load_repo_tables(spark: SparkSession, folder: str) -> RepoTables:
    """Tables below a folder, one Parquet dataset each, with the schemas this package expects."""
    return RepoTables(**{n: spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in _SCHEMAS.items()})


def load_repo_catalog(spark: SparkSession, database: str) -> RepoTables:
    """The same from catalog tables; there ``blobs`` can be bucketed by hash, which spares shuffling contents."""
    return RepoTables(**{n: spark.table(f"{database}.{n}") for n in _SCHEMAS})


def save_repo_catalog(tables: RepoTables, database: str, buckets: int) -> None:
    """Catalog tables for ``load_repo_catalog``, contents bucketed by hash and trees by commit."""
    keys = {"blobs": "hash", "tree_entries": "commit_hash"}
    for name in _SCHEMAS:
        writer = getattr(tables, name).write.mode("overwrite").format("parquet")
        if name in keys:
            writer = writer.bucketBy(buckets, keys[name])
        writer.saveAsTable(f"{database}.{name}")

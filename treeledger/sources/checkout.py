"""A checkout directory as a table of paths, contents and object ids."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.content import git_blob_hash
from ..scratch import materialize

_ENTRY = "path string, mode string"
# A batch of file contents is handed to Spark when it reaches this size.
_BATCH_BYTES = 32 << 20


def list_checkout(spark: SparkSession, root: str) -> DataFrame:
    """Relative paths and modes of all files below ``root``, the ``.git`` folder left out.

    Folders are listed by the executors, level by level, so ``root`` has to be mounted on all of them. Symbolic links are
    entries of their own and not followed.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for folder in batch["path"]:
                with os.scandir(os.path.join(root, folder)) as entries:
                    rows += [(os.path.join(folder, e.name), _mode(e)) for e in entries if e.name != ".git"]
            yield pd.DataFrame(rows, columns=["path", "mode"])

    files = None
    folders = spark.createDataFrame([("",)], "path string")
    while True:
        level = materialize(folders.mapInPandas(scan, _ENTRY), "checkout")
        found = level.where(F.col("mode") != "040000")
        files = found if files is None else files.unionByName(found)
        folders = level.where(F.col("mode") == "040000").select("path")
        if folders.isEmpty():
            return files
        # folders of one level differ much in size, so they are dealt out evenly
        folders = folders.repartition(spark.sparkContext.defaultParallelism)


def _mode(entry: os.DirEntry) -> str:
    if entry.is_symlink():
        return "120000"
    if entry.is_dir():
        return "040000"
    return "100755" if entry.stat().st_mode & stat.S_IXUSR else "100644"


def read_tree(spark: SparkSession, root: str, commit_hash: str) -> DataFrame:
    """Files of a checkout with content and object id: ``commit_hash, path, mode, hash, content``.

    ``select`` the first four columns for ``tree_entries`` and hash and content for ``blobs``.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for path, mode in batch.itertuples(index=False):
                content = _content(os.path.join(root, path), mode)
                rows.append((path, mode, content))
                size += len(content)
                if size >= _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "mode", "content"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["path", "mode", "content"])

    files = list_checkout(spark, root).repartition(spark.sparkContext.defaultParallelism * 4)
    contents = files.mapInPandas(read, f"{_ENTRY}, content binary")
    return contents.select(
        F.lit(commit_hash).alias("commit_hash"), "path", "mode", git_blob_hash(F.col("content")).alias("hash"), "content"
    )


def _content(path: str, mode: str) -> bytes:
    if mode == "120000":
        return os.fsencode(os.readlink(path))
    with open(path, "rb") as file:
        return file.read()

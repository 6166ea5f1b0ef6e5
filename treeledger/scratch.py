"""Cutting lineage: intermediate tables written to the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary folder."""
    named = spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"{_SETTING} is not set; it must name a folder every executor can reach")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="treeledger-")
    return _local_dirs[context.applicationId]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/treeledger/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a table once and read it back: lineage ends here, lost executors lose nothing, and its size is known."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

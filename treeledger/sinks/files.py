"""Run tables as CSV, Parquet, catalog or JDBC tables, with the checks that guard an append."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..scratch import materialize

# Names of the database tables, children first.
DATABASE_TABLES = {
    "git_file_snapshot": schemas.FILE_SNAPSHOT,
    "git_analysis_result": schemas.ANALYSIS_RESULTS,
    "git_diff_result": schemas.DIFF_RESULTS,
    "git_commit_file": schemas.COMMIT_FILES,
    "git_commit": schemas.COMMITS,
}

RUN = ["repo", "run"]
# Bound on the rows of one output file, so that no reading task gets an unbounded file.
FILE_ROWS = 1_000_000


def text_value(field: T.StructField) -> Column:
    """A column as CSV text: NULL as ``""``, times in ISO-8601."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.TimestampType | T.TimestampNTZType):
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(value, "SSSSSS")
        value = F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    return F.coalesce(value.cast("string"), F.lit("")).alias(field.name)


def stringify(df: DataFrame) -> DataFrame:
    """All columns as CSV text."""
    return df.select(*[text_value(f) for f in df.schema])


def csv_header(spark: SparkSession, path: str) -> list[str] | None:
    """Column names of an existing CSV, or None."""
    try:
        return spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path).columns
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_csv(df: DataFrame, path: str, append: bool = False, rows_from: DataFrame | None = None) -> bool:
    """All fields quoted, with a header; an empty table writes nothing and gives False.

    ``append`` needs the columns of the existing file. ``rows_from`` is a cheaper table that is empty exactly when ``df``
    is; it saves running ``df`` twice.
    """
    if (df if rows_from is None else rows_from).isEmpty():
        return False
    if append:
        header = csv_header(df.sparkSession, path)
        if header and header != df.columns:
            raise ValueError(f"{path} has the columns {header}, not {df.columns}")
    writer = stringify(df).write.mode("append" if append else "overwrite").options(
        header=True,
        quoteAll=True,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        maxRecordsPerFile=FILE_ROWS,
    )
    writer.csv(path)
    return True


def write_run_parquet(df: DataFrame, path: str, mode: str = "append", buckets: int | None = None) -> None:
    """Rows of many runs, partitioned by repo and run.

    The rebalancing groups rows by run and splits a run that is too large for one task. Where there are more runs than a
    folder each is good for, ``buckets`` deals them over so many folders, sorted by repo and run, so that choosing runs skips
    row groups instead.
    """
    if buckets is not None:
        bucket = F.pmod(F.xxhash64("repo", "run"), F.lit(buckets))
        dealt = df.withColumn("bucket", bucket).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", *RUN)
        dealt.write.mode(mode).partitionBy("bucket").option("maxRecordsPerFile", FILE_ROWS).parquet(path)
        return
    balanced = df.hint("rebalance", F.col("repo"), F.col("run"))
    balanced.write.mode(mode).partitionBy("repo", "run").option("maxRecordsPerFile", FILE_ROWS).parquet(path)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def key_clashes(df: DataFrame, keys: Sequence[str], existing: DataFrame | None = None) -> DataFrame:
    """Keys that occur twice in the batch or are already in the target table."""
    clashes = duplicate_keys(df, keys).select(*keys)
    if existing is not None:
        clashes = clashes.unionByName(df.select(*keys).join(existing.select(*keys), list(keys), "left_semi"))
    return clashes.distinct()


def check_unique(df: DataFrame, keys: Sequence[str], existing: DataFrame | None = None) -> None:
    """Raise when a key occurs twice in the batch or is already in the target table."""
    sample = key_clashes(df, keys, existing).limit(5).collect()
    if sample:
        raise ValueError(f"rows exist already for {', '.join(map(str, (tuple(r) for r in sample)))}")


def new_commits(commits: DataFrame, existing: DataFrame) -> DataFrame:
    """Commits whose hash is not stored yet, one row per hash."""
    others = [c for c in commits.columns if c != "hash"]
    first = commits.groupBy("hash").agg(F.min(F.struct(*others)).alias("c")).select("hash", "c.*")
    return first.join(existing.select("hash"), "hash", "left_anti").select(*commits.columns)


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Create the result tables that are missing; names of those created."""
    missing = [n for n in reversed(DATABASE_TABLES) if not spark.catalog.tableExists(f"{database}.{n}")]
    for name in missing:
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DATABASE_TABLES[name])
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    return missing


def reset_tables(spark: SparkSession, database: str = "default") -> None:
    """Drop the result tables and create them again."""
    for name in DATABASE_TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
    create_tables(spark, database)


def append_table(df: DataFrame, name: str, database: str = "default") -> None:
    """Append to a result table; its key must not repeat. Commits already stored are passed over instead.

    The rows are stored first, so that what is checked is what is appended, and is worked out once.
    """
    spark = df.sparkSession
    existing = spark.table(f"{database}.{name}")
    rows = materialize(df.select(*existing.columns), "append")
    keys = {
        "git_commit_file": schemas.KEYS["commit_files"],
        "git_diff_result": schemas.KEYS["diff_results"],
        "git_analysis_result": schemas.KEYS["analysis_results"],
    }
    if name == "git_commit":
        rows = new_commits(rows, existing)
    elif name in keys:
        check_unique(rows, keys[name], existing)
    rows.write.insertInto(f"{database}.{name}")


def write_jdbc(df: DataFrame, url: str, table: str, properties: Mapping[str, str], mode: str = "append") -> None:
    """Write to a database table; the driver of the database has to be on the class path."""
    df.write.jdbc(url, table, mode=mode, properties=dict(properties))


def write_manifest(row: DataFrame, path: str) -> None:
    """One manifest row as a JSON document; its ``extra`` map, if any, becomes fields of its own."""
    fields = [c for c in row.columns if c != "extra"]
    document = F.to_json(F.struct(*fields))
    if "extra" in row.columns:
        extra = F.to_json(F.coalesce("extra", F.create_map().cast("map<string,string>")))
        joined = F.concat(F.expr("left(doc, char_length(doc) - 1)"), F.lit(","), F.expr("substring(ext, 2)"))
        row = row.select(document.alias("doc"), extra.alias("ext"))
        row = row.select(F.when(F.col("ext") == "{}", F.col("doc")).otherwise(joined).alias("value"))
    else:
        row = row.select(document.alias("value"))
    row.coalesce(1).write.mode("overwrite").text(path)

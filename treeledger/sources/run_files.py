"""Tables and manifests of earlier runs, laid out as ``<base>/<repo>/runs/<run>/…``, all runs at once."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.skew import BROADCAST_ROWS, spread_join
from ..scratch import materialize

RUN = ["repo", "run"]


def _files(base: str, below: str, runs: Iterable[tuple[str, str]] | None) -> str | list[str]:
    """A file of every run as one pattern, or of the runs named as their paths."""
    if runs is None:
        return f"{base}/*/runs/*/{below}"
    names = [[re.sub(r"([\\*?\[\]{}])", r"\\\1", name) for name in pair] for pair in runs]
    return [f"{base}/{repo}/runs/{run}/{below}" for repo, run in names]


def _path_part(pattern: str, group: int, path: str = "_metadata.file_path") -> Column:
    # file paths are URL-encoded except for the plus sign
    path = F.replace(F.col(path), F.lit("+"), F.lit("%2B"))
    return F.url_decode(F.regexp_extract(path, pattern, group))


def read_run_csv(
    spark: SparkSession,
    base: str,
    table: str,
    multi_line: bool = True,
    skip_unreadable: bool = False,
    runs: Iterable[tuple[str, str]] | None = None,
) -> DataFrame | None:
    """One standard table of all runs with ``repo`` and ``run`` in front; None when no run has it.

    Quoted line breaks are read as data, which makes each file one task's work; files of ``write_csv`` are bounded. For
    tables known to hold no line breaks ``multi_line=False`` splits large files. ``skip_unreadable`` passes over corrupt
    files. ``runs`` opens the files of these repos and runs only, each of which must have the table.

    Columns are found by the names in each file's own header, whatever their order. Absent ones are NULL, as are values that
    are not of a column's type; others than the standard ones follow as text. The files are read once for their first lines
    and once for their rows, however many different headers there are.
    """
    pattern = _files(base, f"data/{table}.csv", runs)
    try:
        lines = spark.read.options(ignoreCorruptFiles=skip_unreadable).text(pattern)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    headers = materialize(_headers(lines), "headers")
    standard = schemas.RUN_TABLES[table]
    texts = [row[0] for row in headers.select("header").distinct().collect()]
    layouts = {text: _layout(text, standard) for text in texts}
    reader = spark.read.options(
        header=True,
        multiLine=multi_line,
        quote='"',
        escape='"',
        mode="PERMISSIVE",
        ignoreCorruptFiles=skip_unreadable,
    )
    path = F.col("_metadata.file_path").alias("_path")
    if len(layouts) > 1:
        width = max(len(layout) for layout in layouts.values())
        places = T.StructType([T.StructField(f"_{k}", T.StringType()) for k in range(width)])
        rows = _by_header(reader.schema(places).csv(pattern).select("*", path), headers, layouts, standard)
    else:
        schema = next(iter(layouts.values()), standard)
        rows = reader.schema(schema).csv(pattern).select("*", path)
    absent = [f for f in standard if f.name not in rows.columns]
    rows = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent}) if absent else rows
    named = rf"/([^/]+)/runs/([^/]+)/data/{table}\.csv"
    repo, run = (_path_part(named, k, "_path") for k in (1, 2))
    further = sorted(set(rows.columns) - {*standard.names, *RUN, "_path"})
    return rows.select(repo.alias("repo"), run.alias("run"), *standard.names, *[F.col(f"`{c}`") for c in further])


def _by_header(
    rows: DataFrame, headers: DataFrame, layouts: Mapping[str, T.StructType], standard: T.StructType
) -> DataFrame:
    """Rows of numbered text columns by the names of their file's header; a name's place is looked up per file."""
    kinds = {f.name: f.dataType for layout in layouts.values() for f in layout}
    found = [
        (k, text, [layout.names.index(n) if n in layout.names else None for n in kinds])
        for k, (text, layout) in enumerate(layouts.items())
    ]
    numbered = rows.sparkSession.createDataFrame(found, "layout int, header string, places array<int>")
    # one short row per file; the commonest order of columns needs none
    usual = headers.groupBy("header").count().orderBy(F.desc("count"), "header").first()["header"]
    unusual = headers.where(F.col("header") != usual).join(numbered, "header").select("_path", "layout")
    if unusual.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(unusual), "_path", "left")
    else:
        joined = spread_join(rows, unusual, ["_path"], [c for c in rows.columns if c != "_path"], "left")
    places = numbered.select("layout", "places")
    joined = joined.join(F.broadcast(places) if len(found) <= BROADCAST_ROWS else places, "layout", "left")
    usually = F.lit(next(places for _, text, places in found if text == usual)).cast("array<int>")
    values = F.array(*[c for c in rows.columns if c != "_path"])
    spread = joined.select("_path", values.alias("_values"), F.coalesce("places", usually).alias("_places"))
    columns = [
        F.get("_values", F.get("_places", F.lit(k))).try_cast(kind).alias(name) for k, (name, kind) in enumerate(kinds.items())
    ]
    return spread.select("_path", *columns)


def _headers(lines: DataFrame) -> DataFrame:
    """``_path, header``: the first line of every file."""
    placed = lines.select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )
    first = placed.where("block = 0").groupBy("_path").agg(F.min_by("value", "place").alias("header"))
    return first.select("_path", F.regexp_replace("header", "^\ufeff", "").alias("header"))


def _layout(header: str, standard: T.StructType) -> T.StructType:
    """The columns that a header names, in its order: standard ones with their types, any others as text."""
    kinds = {f.name: f.dataType for f in standard}
    names: list[str] = []
    for place, name in enumerate(next(csv.reader([header]), [])):
        names.append(name if name and name not in names else f"_column{place}")
    return T.StructType([T.StructField(name, kinds.get(name, T.StringType())) for name in names])


def read_run_parquet(spark: SparkSession, base: str, table: str) -> DataFrame | None:
    """The same from Parquet partitioned by repo and run, where choosing runs prunes files."""
    schema = T.StructType([*schemas.RUN_TABLES[table], *(T.StructField(c, T.StringType()) for c in RUN)])
    try:
        rows = spark.read.schema(schema).parquet(f"{base}/{table}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return rows.select(*RUN, *schemas.RUN_TABLES[table].names)


def _documents(spark: SparkSession, pattern: str | list[str]) -> DataFrame | None:
    try:
        return spark.read.text(pattern, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def parse_run_manifest(text: Column) -> tuple[Column, Column]:
    """Manifest struct and map of the extra fields; a blank or malformed text gives NULL fields and no extras."""
    fields = F.from_json(text, schemas.RUN_MANIFEST)
    everything = F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))
    extra = F.map_filter(everything, lambda key, _: ~key.isin(*schemas.RUN_MANIFEST.names))
    return fields, extra


def read_run_manifest(
    spark: SparkSession, base: str, runs: Iterable[tuple[str, str]] | None = None
) -> DataFrame | None:
    """``repo, run``, the manifest fields and a map of extra fields, one row per ``run.json``, of all runs or those named.

    A file without any byte gives no row, like a missing one; ``known_runs`` still lists such a run by its tables.
    """
    texts = _documents(spark, _files(base, "run.json", runs))
    if texts is None:
        return None
    pattern = r"/([^/]+)/runs/([^/]+)/run\.json"
    fields, extra = parse_run_manifest(F.col("value"))
    named = texts.select(
        _path_part(pattern, 1).alias("repo"), _path_part(pattern, 2).alias("run"), fields.alias("m"), extra.alias("extra")
    )
    return named.select(*RUN, "m.*", "extra")


def read_projects(spark: SparkSession, base: str) -> DataFrame | None:
    """``repo`` and the project fields, one row per ``project.json``."""
    texts = _documents(spark, f"{base}/*/project.json")
    if texts is None:
        return None
    repo = _path_part(r"/([^/]+)/project\.json", 1)
    return texts.select(repo.alias("repo"), F.from_json("value", schemas.PROJECT_MANIFEST).alias("p")).select(
        "repo", "p.*"
    )


def project_run_rows(projects: DataFrame) -> DataFrame:
    """Runs listed in the project files, one row each."""
    return projects.select("repo", F.explode("runs").alias("r")).select("repo", "r.*")


def known_runs(manifest: DataFrame | None, tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """All runs that have a manifest or a table, with the manifest fields where there are any."""
    parts = [t.select(*RUN).distinct() for t in [manifest, *tables.values()] if t is not None]
    if not parts:
        raise ValueError("there is neither a manifest nor a table of any run")
    runs = parts[0]
    for part in parts[1:]:
        runs = runs.unionByName(part)
    runs = runs.distinct()
    return runs if manifest is None else runs.join(manifest, RUN, "left")


def load_report(tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """Which standard tables each run has: ``repo, run, table_name, row_count, status`` (``loaded`` or ``missing``)."""
    counted = None
    for name in schemas.RUN_TABLES:
        table = tables.get(name)
        if table is None:
            continue
        rows = table.groupBy(*RUN).agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(name))
        counted = rows if counted is None else counted.unionByName(rows)
    if counted is None:
        raise ValueError("no run has any table")
    per_run = counted.groupBy(*RUN).pivot("table_name", list(schemas.RUN_TABLES)).agg(F.first("rows"))
    listed = F.array(*[F.struct(F.lit(n).alias("table_name"), F.col(n).alias("row_count")) for n in schemas.RUN_TABLES])
    status = F.when(F.col("row_count").isNull(), "missing").otherwise("loaded")
    return per_run.select(*RUN, F.inline(listed)).withColumn("status", status)


def run_parts(spark: SparkSession, base: str) -> DataFrame:
    """Files of all runs as they are listed, unread: ``repo, run, part, file, size, modified``.

    ``part`` is the name of the table, or ``run.json``.
    """
    found = None
    for below, part in ((r"data/[^/]+\.csv", r"data/([^/]+)\.csv"), (r"run\.json", r"(run\.json)")):
        pattern = f"{base}/*/runs/*/{'run.json' if part.startswith('(') else 'data/*.csv'}"
        try:
            files = spark.read.format("binaryFile").load(pattern)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        repo, run = (_path_part(rf"/([^/]+)/runs/([^/]+)/{below}", k) for k in (1, 2))
        listed = files.select(
            repo.alias("repo"),
            run.alias("run"),
            _path_part(rf"/runs/[^/]+/{part}", 1).alias("part"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
        found = listed if found is None else found.unionByName(listed)
    if found is None:
        schema = "repo string, run string, part string, file string, size bigint, modified timestamp"
        return spark.createDataFrame([], schema)
    return found

"""Statistics of runs as they arrive: what a run contributes is worked out once, stored, and read from there.

A store is a folder with, for each statistic, its rows by batch and a ledger that says which batch speaks for a run::

    <store>/<statistic>/rows/batch=<n>      repo, run and the columns of the statistic
    <store>/<statistic>/ledger/batch=<n>    repo, run, state, size

``state`` tells the files of a run by name, size and time (NULL: the run is gone), so a run that was added to is worked out anew
from its own files and its newer rows stand in for the older ones. A batch counts once all rows of its ledger are there, which is
the last thing written: what a job leaves that ended earlier is not read, and its number is written over by the next. So no retry
counts a run twice. One job at a time may write to a store; any number may read.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.paths import ALL_LABEL
from ..operators import history
from ..operators.stats import RUN, RunTables, Statistic, registered_statistics
from ..scratch import materialize
from ..sources import run_files

# From this many changed runs on, all files are listed and read and the rows of other runs passed over, as the driver would have
# to name each file.
NAMED_RUNS = 20_000
# Name under which the labelled runs themselves are stored.
RUN_LABELS = "runs"
_LEDGER = "repo string, run string, state string, size bigint, batch bigint"


class _Labels(Statistic):
    """The manifest fields and labels of every run, stored like a statistic."""

    name = RUN_LABELS

    def single(self, tables: RunTables) -> DataFrame:
        return tables.runs


def run_states(parts: DataFrame, setting: str = ALL_LABEL) -> DataFrame:
    """``repo, run, state`` from the listed files: equal as long as no file of the run comes, goes or changes, nor the setting."""
    of_file = F.xxhash64("part", "file", "size", "modified")
    summed = parts.groupBy(*RUN).agg(F.count(F.lit(1)).alias("files"), F.bit_xor(of_file).alias("xor"), F.sum("size").alias("bytes"))
    return summed.select(*RUN, F.concat_ws(":", F.lit(setting), "files", "bytes", F.hex("xor")).alias("state"))


def _read(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame | None:
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def ledger(spark: SparkSession, store: str, name: str) -> DataFrame:
    """``repo, run, state, batch``: the last complete batch of every run, runs that are gone with a NULL state."""
    rows = _read(spark, f"{store}/{name}/ledger", _LEDGER)
    if rows is None:
        rows = spark.createDataFrame([], _LEDGER)
    complete = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("written"), F.max("size").alias("size"))
    complete = complete.where("written = size").select("batch")
    last = F.max(F.struct("batch", "state")).alias("last")
    return rows.join(complete, "batch", "left_semi").groupBy(*RUN).agg(last).select(*RUN, "last.state", "last.batch")


def _changed(spark: SparkSession, states: DataFrame, store: str, names: Sequence[str]) -> DataFrame:
    """``statistic, repo, run, state``: runs whose stored rows are not those of their present files; a NULL state says gone."""
    found = None
    for name in names:
        known = ledger(spark, store, name).select(*RUN, F.col("state").alias("known"), "batch")
        both = states.join(known, RUN, "full")
        differs = ~F.col("state").eqNullSafe(F.col("known")) | F.col("batch").isNull()
        one = both.where(differs).select(F.lit(name).alias("statistic"), *RUN, "state")
        found = one if found is None else found.unionByName(one)
    return materialize(found, "changed")


def _last_batch(spark: SparkSession, store: str, name: str) -> int:
    return ledger(spark, store, name).agg(F.max("batch")).first()[0] or 0


def tables_of(
    spark: SparkSession, base: str, parts: DataFrame, changed: DataFrame, kinds: Sequence[str], kept: Sequence[str] = ()
) -> RunTables:
    """The tables of the changed runs; no file of another run is opened while there are at most ``NAMED_RUNS`` of them.

    ``kinds`` are the tables that any run has: one that no changed run has is empty, as over all runs it would not be None.
    Those of ``kept`` are stored, so that their files are read once however often they are used.
    """
    wanted = materialize(parts.join(changed.where(F.col("state").isNotNull()), RUN, "left_semi").select(*RUN, "part").distinct(), "parts")
    few = changed.limit(NAMED_RUNS + 1).count() <= NAMED_RUNS
    names: dict[str, list[tuple[str, str]]] = {}
    if few:
        for row in wanted.where(F.col("part").isin("run.json", *schemas.RUN_TABLES)).collect():
            names.setdefault(row.part, []).append((row.repo, row.run))
    else:
        names = {row.part: [] for row in wanted.select("part").distinct().collect()}

    def of(part: str) -> DataFrame | None:
        if part not in names:
            return None
        runs = names[part] if few else None
        if part == "run.json":
            rows = run_files.read_run_manifest(spark, base, runs)
        else:
            rows = run_files.read_run_csv(spark, base, part, runs=runs)
        rows = rows if few or rows is None else rows.join(changed, RUN, "left_semi")
        return rows if rows is None or part not in kept else materialize(rows, part)

    keys = [T.StructField(c, T.StringType()) for c in RUN]
    tables = {name: of(name) for name in kinds}
    for name in kinds:
        if tables[name] is None:
            tables[name] = spark.createDataFrame([], T.StructType([*keys, *schemas.RUN_TABLES[name]]))
    manifest = of("run.json")
    runs = wanted.select(*RUN).distinct()
    if manifest is None:
        fields = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.RUN_MANIFEST]
        runs = runs.select("*", *fields, F.lit(None).cast("map<string,string>").alias("extra"))
    else:
        runs = runs.join(manifest, RUN, "left")
    return RunTables(history.with_labels(runs), **tables)


def update_statistics(
    spark: SparkSession,
    base: str,
    store: str,
    stack: str = ALL_LABEL,
    statistics: Mapping[str, Statistic] | None = None,
) -> dict[str, int]:
    """Bring the store up to the runs below ``base``; the number of runs worked out anew (or found gone), by statistic.

    Files of runs that have not changed are listed, not read. Statistics must tell of a run from that run's rows alone, as all
    that come with the library do; further columns, such as ``author``, are those of the runs worked out together. One registered
    later catches up with all runs, and all are worked out anew for another ``stack`` (so stores are best kept by stack) or when
    the first run with a kind of table comes. A statistic that lacks a column is passed over with a warning and tried again by the
    next update. With nothing new, nothing is written.
    """
    parts = materialize(run_files.run_parts(spark, base), "listing")
    kinds = [r.part for r in parts.where(F.col("part").isin(*schemas.RUN_TABLES)).select("part").distinct().orderBy("part").collect()]
    states = materialize(run_states(parts, ":".join([stack, *kinds])), "states")
    chosen = {RUN_LABELS: _Labels(), **(registered_statistics() if statistics is None else statistics)}
    changed = _changed(spark, states, store, list(chosen))
    # statistics that lack the same runs read them together, and a table that several of them need once
    of_run = F.xxhash64(*RUN, "state")
    lacking = changed.groupBy("statistic").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count("state").alias("present"),
        F.bit_xor(of_run).alias("xor"),
        F.sum(F.hash(*RUN, "state")).alias("sum"),
    )
    sets = {row.statistic: tuple(row)[1:] for row in lacking.collect()}
    read: dict[tuple, RunTables] = {}
    counts = {name: sets[name][0] if name in sets else 0 for name in chosen}
    for name, statistic in chosen.items():
        if not counts[name]:
            continue
        own = changed.where(F.col("statistic") == name).drop("statistic")
        batch = _last_batch(spark, store, name) + 1
        place = f"{store}/{name}"
        _, present, *_ = sets[name]
        if present and sets[name] not in read:
            needs = [n for other, s in chosen.items() if counts[other] and sets[other] == sets[name] for n in s.needs]
            kept = [kind for kind in kinds if needs.count(kind) > 1]
            read[sets[name]] = tables_of(spark, base, parts, own, kinds, kept).of_stack(stack)
        tables = read.get(sets[name])
        if tables is not None and all(getattr(tables, need) is not None for need in statistic.needs):
            try:
                rows = statistic.single(tables)
            except AnalysisException as error:
                warnings.warn(f"statistic {name!r} passed over: {error.getMessage() or error}", stacklevel=2)
                counts[name] = 0
                continue
            rows.write.mode("overwrite").parquet(f"{place}/rows/batch={batch}")
        size = F.lit(counts[name]).cast("bigint").alias("size")
        own.select(*RUN, "state", size).write.mode("overwrite").parquet(f"{place}/ledger/batch={batch}")
    return counts


def stored_statistic(spark: SparkSession, store: str, name: str, runs: Sequence[str] | None = None) -> DataFrame | None:
    """Rows of a statistic for all runs in the store or those named, as ``single`` gives them; None before any run had rows."""
    rows = _read(spark, f"{store}/{name}/rows")
    if rows is None:
        return None
    current = ledger(spark, store, name).where(F.col("state").isNotNull())
    if runs is not None:
        rows, current = rows.where(F.col("run").isin(*runs)), current.where(F.col("run").isin(*runs))
    columns = [c for c in rows.columns if c != "batch"]
    return rows.join(current.select(*RUN, "batch"), [*RUN, "batch"], "left_semi").select(*columns)


def stored_trend(spark: SparkSession, store: str, statistic: Statistic, run_type: str | None = None) -> DataFrame | None:
    """The trend of a statistic from stored rows, over runs of one type or all; None for a statistic without a trend."""
    values, runs = stored_statistic(spark, store, statistic.name), stored_statistic(spark, store, RUN_LABELS)
    if values is None or runs is None:
        return None
    return statistic.trend_of(values, runs if run_type is None else history.select_runs(runs, run_type))

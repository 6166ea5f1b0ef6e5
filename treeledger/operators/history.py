"""Runs: the manifest of every analysis run, its order in time, and choosing runs for a report."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions import times

# Parts of a repository's runs that are ranked on their own first.
RANKED_PARTS = 64


def with_labels(runs: DataFrame) -> DataFrame:
    """Runs with the naive UTC time stamps and labels a report uses.

    ``ended_at`` is parsed from the manifest text; the run name is the fallback. Adds ``timestamp``, ``trend_ts``,
    ``display_label`` and ``trend_label`` and turns ``ended_at`` into a time stamp.
    """
    named = runs.withColumns(
        {
            "timestamp": times.parse_run_timestamp(F.col("run")),
            "ended_at": times.parse_metadata_timestamp(F.col("ended_at")),
        }
    )
    named = named.withColumn("trend_ts", times.trend_timestamp(F.col("ended_at"), F.col("timestamp")))
    return named.withColumns(
        {
            "display_label": times.display_label(F.col("trend_ts"), F.col("run")),
            "trend_label": times.trend_label(F.col("trend_ts"), F.col("run")),
        }
    )


def chronological(runs: DataFrame) -> DataFrame:
    """Oldest first; runs without a time stamp before all others, then by name."""
    return runs.orderBy("repo", F.col("trend_ts").asc_nulls_first(), "run")


def list_repos(runs: DataFrame) -> DataFrame:
    """Repository names in order."""
    return runs.select("repo").distinct().orderBy("repo")


def list_runs(runs: DataFrame, repo: str | None = None) -> DataFrame:
    """Run names, newest name first."""
    chosen = runs if repo is None else runs.where(F.col("repo") == repo)
    return chosen.select("repo", "run").distinct().orderBy("repo", F.col("run").desc())


def newest_runs(runs: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` newest run names of every repository.

    A repository may hold most of the runs, so its runs are ranked within salted parts first; only the best of each part
    are ranked together.
    """
    part = F.pmod(F.xxhash64("run"), F.lit(RANKED_PARTS))
    newest = F.col("run").desc()
    within = Window.partitionBy("repo", "_part").orderBy(newest)
    overall = Window.partitionBy("repo").orderBy(newest)
    best = runs.withColumn("_part", part).withColumn("_rank", F.row_number().over(within)).where(F.col("_rank") <= limit)
    ranked = best.withColumn("_rank", F.row_number().over(overall)).where(F.col("_rank") <= limit)
    return ranked.drop("_part", "_rank")


def load_history(runs: DataFrame, limit: int | None = None, with_data: DataFrame | None = None) -> DataFrame:
    """Labelled runs of every repository, oldest first, at most ``limit`` newest names each.

    ``with_data(repo, run)`` keeps only runs that have data (after the limit); leave it out for metadata alone.
    """
    chosen = runs if limit is None else newest_runs(runs, limit)
    if with_data is not None:
        chosen = chosen.join(with_data.select("repo", "run").distinct(), ["repo", "run"], "left_semi")
    return chronological(with_labels(chosen))


def select_runs(runs: DataFrame, run_type: str, names: Sequence[str] | None = None) -> DataFrame:
    """Runs of one type, optionally only the named ones."""
    chosen = runs.where(F.col("run_type") == run_type)
    return chosen if names is None else chosen.where(F.col("run").isin(*names))


def run_types(runs: DataFrame) -> DataFrame:
    """Run types each repository has; a run without a type counts as type NULL."""
    return runs.select("repo", "run_type").distinct()


def new_runs(requests: DataFrame) -> DataFrame:
    """Manifest rows of runs about to start: ``requests(project_id, mode, base, target, started)``.

    ``started`` is a naive UTC time stamp. Columns follow the manifest schema; status and end are NULL until finished.
    """
    mode, base, target, started = F.col("mode"), F.col("base"), F.col("target"), F.col("started")
    kind = times.run_type(mode)
    return requests.select(
        F.lit(schemas.SCHEMA_VERSION).alias("schema_version"),
        "project_id",
        times.run_id(mode, started, base, target).alias("run_id"),
        kind.alias("run_type"),
        kind.alias("scope_type"),
        times.scope_key(mode, base, target).alias("scope_key"),
        iso_utc(started).alias("started_at"),
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("ended_at"),
        F.lit(None).cast("array<string>").alias("data_files"),
    )


def iso_utc(ts: Column) -> Column:
    """The time format of the manifests: ISO-8601 with offset and a closing ``Z``."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00Z"))


def finish_runs(runs: DataFrame, ended: Column, data_files: Column) -> DataFrame:
    """Manifest rows of runs that succeeded. Failed runs simply keep their first row."""
    return runs.withColumns({"status": F.lit("success"), "ended_at": iso_utc(ended), "data_files": data_files})


def merge_extra(extra: Column, reserved: Sequence[str]) -> Column:
    """Extra fields (a string map) without the reserved names."""
    return F.map_filter(extra, lambda key, _: ~key.isin(*reserved))


def extra_fields(
    producer: Callable[..., Mapping[str, object]] | None, reserved: Sequence[str], **context: object
) -> tuple[dict[str, str], list[str]]:
    """Extra manifest fields from a caller's function, reserved names dropped; an error there only gives a warning."""
    if producer is None:
        return {}, []
    try:
        fields = producer(**context) or {}
    except Exception as error:  # a faulty producer must not stop the run
        return {}, [f"metadata producer failed: {error}"]
    return {str(k): "" if v is None else str(v) for k, v in fields.items() if k not in reserved}, []


def project_runs(runs: DataFrame) -> DataFrame:
    """One row per run, in the fields a project lists them by."""
    return runs.select(
        F.col("project_id").alias("id"),
        "run_id",
        "run_type",
        "scope_key",
        F.col("started_at").alias("created_at"),
        "status",
        F.when(F.col("status") == "success", F.col("ended_at")).alias("completed_at"),
    )


def project_view(runs: DataFrame) -> DataFrame:
    """One row per project: latest run and time of the last change.

    A project's runs stay rows (``project_runs``); one project may hold too many of them for a single value.
    """
    order = F.struct("started_at", "run_id")
    return runs.groupBy(F.col("project_id").alias("id")).agg(
        F.lit(schemas.SCHEMA_VERSION).alias("schema_version"),
        F.first("project_id").alias("title"),
        F.max_by("run_id", order).alias("latest_run"),
        F.max(F.greatest("started_at", "ended_at")).alias("updated_at"),
        F.count(F.lit(1)).alias("run_count"),
    )

"""The analysis jobs: a snapshot of commits, a diff of commit pairs or branches, and the statistics over runs."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.content import ZERO_HASH
from ..functions.paths import ALL_LABEL, DEFAULT_EXCLUDE, DEFAULT_INCLUDE, DEFAULT_STACKS, StackRule
from ..operators import history
from ..operators.analysis import analyze, file_snapshots
from ..operators.analyzers import DEFAULT_ANALYZERS, AnalyzerRule, BoundAnalyzer, bind_analyzers
from ..operators.lineage import branch_tip, commit_in_branch, of_repository, resolve_ref
from ..operators.lines import diff_hunks, with_hunk_counts
from ..operators.skew import spread_join
from ..operators.stats import RunTables, Statistic, registered_statistics
from ..operators.trees import diff_commits, diff_sides, snapshot_files, tree_diff
from ..scratch import materialize
from ..sinks.files import write_csv, write_manifest
from ..sources.tables import RepoTables


@dataclass(frozen=True)
class Settings:
    """Path filter, stacks and analyzers of a job."""

    include: Sequence[str] = DEFAULT_INCLUDE
    exclude: Sequence[str] = DEFAULT_EXCLUDE
    stacks: Sequence[StackRule] = DEFAULT_STACKS
    analyzers: Sequence[AnalyzerRule] = DEFAULT_ANALYZERS
    user_module: str | None = None

    def bound(self) -> list[BoundAnalyzer]:
        return bind_analyzers(self.analyzers, self.user_module)[0]

    def skipped_analyzers(self) -> list[str]:
        """Names of rules whose analyzer is unknown."""
        return bind_analyzers(self.analyzers, self.user_module)[1]


@dataclass(frozen=True)
class Results:
    """Tables a job produced. ``sources`` names, for tables that are costly, a cheap one empty at the same time."""

    mode: str
    branch: str
    base: str
    target: str
    commits: DataFrame
    analysis_results: DataFrame
    commit_files: DataFrame | None = None
    diff_results: DataFrame | None = None
    file_snapshots: DataFrame | None = None
    sources: Mapping[str, DataFrame] = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        named = {name: getattr(self, name) for name in schemas.RUN_TABLES}
        return {name: table for name, table in named.items() if table is not None}


def snapshot_tables(
    lake: RepoTables, commits: DataFrame | Sequence[str], settings: Settings
) -> tuple[DataFrame, DataFrame]:
    """Files and analysis rows of any number of commits. The files are stored, as several steps read them."""
    found = snapshot_files(lake.tree_entries, commits, settings.include, settings.exclude, settings.stacks)
    files = materialize(found, "files")
    return files, analyze(files, lake.blobs, settings.bound()).select(*schemas.ANALYSIS_RESULTS.names)


def diff_tables(
    lake: RepoTables, pairs: DataFrame | tuple[str, str], settings: Settings
) -> tuple[DataFrame, DataFrame]:
    """Diff rows and the analysis rows of both their sides, for any number of commit pairs.

    Columns of ``pairs`` beyond the two hashes are kept in both tables. The diff is stored, so that the tree entries are read
    once for all that is made of it.
    """
    found = tree_diff(lake.tree_entries, pairs, settings.include, settings.exclude, settings.stacks)
    diff = materialize(found, "diff")
    sides = diff_sides(diff)
    return diff, analyze(sides, lake.blobs, settings.bound()).drop("side")


@dataclass(frozen=True)
class HistoryTables:
    """What every commit changed: ``diff_results`` with hunk counts, and the hunks."""

    diff_results: DataFrame
    hunks: DataFrame


def history_tables(lake: RepoTables, settings: Settings = Settings()) -> HistoryTables:
    """Every commit of the lake against its first parent, a commit without parents against the empty tree (the zero hash).

    All commits are one diff: the tree entries are scanned and shuffled once, and each pair of blobs is compared once,
    however often history repeats it.
    """
    first = lake.commit_parents
    if "ordinal" in first.columns:
        first = first.groupBy("child").agg(F.min_by("parent", "ordinal").alias("parent"))
    commits = lake.commits.select("hash").distinct()
    parents = spread_join(commits, first.select(F.col("child").alias("hash"), "parent"), ["hash"], ["hash"], "left", most=1)
    base = F.coalesce("parent", F.lit(ZERO_HASH)).alias("base_commit_hash")
    pairs = materialize(parents.select(base, F.col("hash").alias("target_commit_hash")), "commit-pairs")
    found = tree_diff(lake.tree_entries, pairs, settings.include, settings.exclude, settings.stacks)
    diff = materialize(found, "diff")
    hunks = materialize(diff_hunks(diff, lake.blobs), "hunks")
    return HistoryTables(with_hunk_counts(diff, hunks), hunks)


def in_repository(lake: RepoTables, repository: str | None) -> RepoTables:
    """The lake with the commits and branches of one repository; trees, parents and contents are found by hash."""
    if repository is None:
        return lake
    return replace(lake, commits=of_repository(lake.commits, repository), refs=of_repository(lake.refs, repository))


def snapshot_job(
    lake: RepoTables,
    commit: str | None = None,
    branch: str | None = None,
    settings: Settings = Settings(),
    mode: str = "snap",
    keep_texts: bool = False,
    repository: str | None = None,
) -> Results:
    """Snapshot of one commit, by default the latest of the branch, by default the current branch.

    ``repository`` names the one that is meant where the lake holds several.
    """
    lake = in_repository(lake, repository)
    if branch is None:
        heads = lake.refs.where("is_head").select("repository", "name").distinct().limit(2).collect()
        if not heads:
            raise ValueError("there is no current branch")
        if len(heads) > 1:
            raise ValueError("there are several current branches; name a branch or a repository")
        branch = heads[0].name
    tip = branch_tip(lake.refs, branch)
    commit_hash = tip if commit is None else resolve_ref(lake.refs, lake.commits, commit)
    row = lake.commits.where(F.col("hash") == commit_hash)
    if row.isEmpty():
        raise ValueError(f"commit {commit_hash} not found")
    if commit_hash != tip and not commit_in_branch(lake.commit_parents, tip, commit_hash):
        raise ValueError(f"commit {commit_hash} does not belong to branch {branch!r}")
    files, analysis = snapshot_tables(lake, [commit_hash], settings)
    return Results(
        mode,
        branch,
        commit_hash,
        "",
        row.withColumn("branch", F.lit(branch)),
        analysis,
        commit_files=files,
        file_snapshots=file_snapshots(files, lake.blobs) if keep_texts else None,
        sources={"analysis_results": files.where(F.col("tech_stack").isNotNull())},
    )


def history_job(
    lake: RepoTables,
    commit: str | None = None,
    branch: str | None = None,
    settings: Settings = Settings(),
    repository: str | None = None,
) -> Results:
    """A snapshot under the history mode."""
    return snapshot_job(lake, commit, branch, settings, mode="hist", repository=repository)


def diff_job(
    lake: RepoTables,
    base: str,
    target: str,
    branch: str = "",
    settings: Settings = Settings(),
    mode: str = "diff",
    branches: tuple[str, str] | None = None,
    repository: str | None = None,
) -> Results:
    """Diff of two commits given by branch name, hash or short hash; both sides are analyzed."""
    lake = in_repository(lake, repository)
    base_hash = resolve_ref(lake.refs, lake.commits, base)
    target_hash = resolve_ref(lake.refs, lake.commits, target)
    base_branch, target_branch = branches or (branch, branch)
    diff, analysis = diff_tables(lake, (base_hash, target_hash), settings)
    classified = F.col("base_tech_stack").isNotNull() | F.col("target_tech_stack").isNotNull()
    return Results(
        mode,
        branch,
        base if branches else base_hash,
        target if branches else target_hash,
        diff_commits(lake.commits, base_hash, target_hash, base_branch, target_branch),
        analysis.select(*schemas.ANALYSIS_RESULTS.names),
        diff_results=diff,
        sources={"analysis_results": diff.where(classified)},
    )


def diff_branch_job(
    lake: RepoTables, base: str, target: str, settings: Settings = Settings(), repository: str | None = None
) -> Results:
    """Diff of the tips of two branches."""
    for branch in (base, target):
        branch_tip(lake.refs, branch, repository)
    branches = (base, target)
    return diff_job(lake, base, target, settings=settings, mode="diffb", branches=branches, repository=repository)


Producer = Callable[..., Mapping[str, object]]


def write_run(
    spark: SparkSession,
    results: Results,
    base_dir: str,
    project: str,
    project_metadata: Producer | None = None,
    run_metadata: Producer | None = None,
    started: datetime | None = None,
) -> tuple[str, list[str]]:
    """Write the tables and manifests of one run; its run id and the warnings.

    The run manifest is written before the tables and completed after them, so a failed run stays without a status.
    """
    begun = (started or datetime.now(UTC)).replace(tzinfo=None, microsecond=0)
    request = spark.createDataFrame(
        [(project, results.mode, results.base, results.target, begun)],
        "project_id string, mode string, base string, target string, started timestamp_ntz",
    )
    manifest = history.new_runs(request)
    run = manifest.select("run_id").collect()[0].run_id
    context = dict(
        artifacts_root=base_dir,
        project=project,
        mode=results.mode,
        branch=results.branch,
        base=results.base,
        target=results.target,
    )
    run_fields, run_warnings = history.extra_fields(
        run_metadata, schemas.RESERVED_RUN_FIELDS, **context, run_id=run
    )
    project_fields, project_warnings = history.extra_fields(
        project_metadata, schemas.RESERVED_PROJECT_FIELDS, **context
    )
    run_dir = f"{base_dir}/{project}/runs/{run}"

    def with_extra(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
        pairs = [F.lit(x) for item in fields.items() for x in item]
        return df.withColumn("extra", F.create_map(*pairs).cast("map<string,string>"))

    core = [n for n in schemas.RUN_MANIFEST.names if n not in run_fields]
    write_manifest(with_extra(manifest.select(*core), run_fields), f"{run_dir}/run.json")
    written = []
    for name, table in results.tables().items():
        if write_csv(table, f"{run_dir}/data/{name}.csv", rows_from=results.sources.get(name)):
            written.append(f"data/{name}.csv")
    if results.file_snapshots is not None:
        write_csv(results.file_snapshots, f"{run_dir}/data/file_snapshots.csv", rows_from=results.commit_files)

    ended = F.lit(datetime.now(UTC).replace(tzinfo=None, microsecond=0))
    files = F.array(*[F.lit(w) for w in sorted(written)]).cast("array<string>")
    finished = history.finish_runs(manifest, ended, files)
    run_fields = {k: v for k, v in run_fields.items() if k not in ("status", "ended_at", "data_files")}
    write_manifest(with_extra(finished, run_fields), f"{run_dir}/run.json")
    title = project_fields.pop("title", project)
    project_row = finished.select(
        "schema_version",
        F.col("project_id").alias("id"),
        F.lit(title).alias("title"),
        F.col("run_id").alias("latest_run"),
        F.col("ended_at").alias("updated_at"),
    )
    write_manifest(with_extra(project_row, project_fields), f"{base_dir}/{project}/project.json")
    return run, run_warnings + project_warnings


def statistics_job(
    tables: RunTables,
    stack: str = ALL_LABEL,
    trend: bool = False,
    run_type: str | None = None,
    runs: Sequence[str] | None = None,
    statistics: Mapping[str, Statistic] | None = None,
) -> dict[str, DataFrame]:
    """Registered statistics over all chosen runs in one go, one table per statistic.

    Trends are taken over runs of one type. A statistic without a trend, or without its input table, is left out, and so is, with
    a warning, one that asks for a column that the tables lack: the report does not end with it.
    """
    chosen = tables.runs if run_type is None else history.select_runs(tables.runs, run_type)
    selected = replace(tables.of_stack(stack), runs=chosen)
    if runs is not None:
        # a plain condition on the run name, so that partitioned tables read only those runs
        named = {n: getattr(selected, n) for n in ("runs", *schemas.RUN_TABLES) if getattr(selected, n) is not None}
        selected = replace(selected, **{n: t.where(F.col("run").isin(*runs)) for n, t in named.items()})
    found = {}
    for name, statistic in (registered_statistics() if statistics is None else statistics).items():
        if any(getattr(selected, table) is None for table in statistic.needs):
            continue
        try:
            table = statistic.trend(selected) if trend else statistic.single(selected)
        except AnalysisException as error:
            warnings.warn(f"statistic {name!r} left out: {error.getMessage() or error}", stacklevel=2)
            continue
        if table is not None:
            found[name] = table
    return found

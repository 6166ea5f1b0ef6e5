"""Schemas of the repository tables and of the run tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "strings": T.ArrayType(T.StringType()),
}


def _schema(columns: str, *more: T.StructField) -> T.StructType:
    """Schema of ``name type, name type, …`` (no session is needed, unlike with DDL parsing)."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([*(T.StructField(name, _TYPES[kind]) for name, kind in pairs), *more])


# -- repository tables ---------------------------------------------------------------------------------------------

COMMITS = _schema(
    "repository string, branch string, hash string, message string, author_name string, author_email string, "
    "author_date timestamp_ntz, committer_name string, committer_email string, commit_date timestamp_ntz"
)
COMMIT_PARENTS = _schema("child string, parent string, ordinal int")
REFS = _schema("repository string, name string, hash string, is_head boolean")
TREE_ENTRIES = _schema("commit_hash string, path string, mode string, hash string")
TREE_OBJECTS = _schema("tree_hash string, name string, type string, child_hash string")
BLOBS = _schema("hash string, content binary")

# -- run tables ----------------------------------------------------------------------------------------------------

COMMIT_FILES = _schema("commit_hash string, path string, tech_stack string, hash string")
DIFF_RESULTS = _schema(
    "base_commit_hash string, target_commit_hash string, base_path string, target_path string, "
    "diff_change_type string, base_tech_stack string, target_tech_stack string, base_file_hash string, "
    "target_file_hash string, hunk_char_count int, hunk_line_count int"
)
ANALYSIS_RESULTS = _schema("commit_hash string, path string, analyzer_type string, count bigint, content string")
FILE_SNAPSHOT = _schema("commit_file_hash string, content_snapshot string")

RUN_TABLES = {
    "commits": COMMITS,
    "commit_files": COMMIT_FILES,
    "diff_results": DIFF_RESULTS,
    "analysis_results": ANALYSIS_RESULTS,
}

# Columns that identify a row of each table.
KEYS = {
    "commits": ("hash",),
    "commit_files": ("commit_hash", "path"),
    "diff_results": ("base_commit_hash", "target_commit_hash", "target_path"),
    "analysis_results": ("commit_hash", "path", "analyzer_type"),
}

# -- manifests -----------------------------------------------------------------------------------------------------

RUN_MANIFEST = _schema(
    "schema_version string, project_id string, run_id string, run_type string, scope_type string, scope_key string, "
    "started_at string, status string, ended_at string, data_files strings"
)
PROJECT_RUN = _schema(
    "run_id string, run_type string, scope_key string, created_at string, status string, completed_at string"
)
PROJECT_MANIFEST = _schema(
    "schema_version string, id string, title string, latest_run string, updated_at string",
    T.StructField("runs", T.ArrayType(PROJECT_RUN)),
)

# Manifest fields that callers cannot set.
RESERVED_PROJECT_FIELDS = ("schema_version", "id", "latest_run", "updated_at", "runs")
RESERVED_RUN_FIELDS = (
    "schema_version",
    "project_id",
    "run_id",
    "run_type",
    "scope_type",
    "scope_key",
    "started_at",
)
SCHEMA_VERSION = "1.0"

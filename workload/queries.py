"""One query per operator over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger import schemas
from treeledger.functions import content as content_functions
from treeledger.functions import paths
from treeledger.operators import analysis, history, lineage, lines, renames, stats, trees
from treeledger.operators.analyzers import (
    JAVA_CLASS_PATTERN,
    Analyzer,
    AnalyzerRule,
    RegexMatchCountAnalyzer,
    bind_analyzers,
    register_analyzer,
    unregister_analyzer,
)
from treeledger.plans import increments, jobs
from treeledger.scratch import fresh_dir, materialize
from treeledger.sinks import files as sinks
from treeledger.sources import checkout, run_files
from treeledger.sources.tables import RepoTables, load_repo_tables

from .inputs import COMMITS, EDITED, EDITS_SQL, FILES, LAKE, MOVED, NESTED, NESTS, ORDER_TREES, RUN_LINES, RUN_TABLES, RUNS, derive, derive_contents, nested_objects, once_per_hash, oracle, pick, read_table, source_bytes

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Case:
    run: Query
    sql: str | None


CASES: dict[str, Case] = {}

F_PARTS = (FILES,)
RUN_PARTS = (RUNS, RUN_LINES)


def case(sql: str | None = None, parts: tuple[str, ...] = (), recursive: bool = False):
    """Register a query under the name of its function."""

    def keep(run: Query) -> Query:
        text = None if sql is None else oracle(parts, sql, recursive)
        CASES[run.__name__] = Case(run, text)
        return run

    return keep


# -- SQL spellings used by several counterparts --------------------------------------------------------------------


def sql_file_type(path: str) -> str:
    tail = f"split_part({path}, '.', -1)"
    return (
        f"CASE WHEN {path} LIKE '.%' THEN '<dev-config>' "
        f"WHEN contains({path}, '.') AND {tail} <> '' THEN {tail} ELSE '<no-extension>' END"
    )


def sql_extract_stack(path: str) -> str:
    ext = sql_file_type(path)
    python = " OR ".join(
        f"starts_with({path}, '{p}')" for p in ("config", "database", "git", "notebooks", "analyzers")
    )
    return (
        f"CASE WHEN {ext} = 'java' THEN 'Java' WHEN {ext} = 'xml' THEN 'XML' WHEN {ext} IN ('sh', 'bat') THEN 'Script' "
        f"WHEN ({python}) AND {ext} = 'py' THEN 'Python' WHEN starts_with({path}, 'tests') AND {ext} = 'py' THEN 'PyTest' "
        f"WHEN {ext} = 'yaml' THEN 'Yaml' WHEN starts_with({path}, 'notebooks') AND {ext} = 'ipynb' THEN 'Jupyter' END"
    )


def sql_report_stack(path: str) -> str:
    p = f"lower(trim(replace(trim({path}), chr(92), '/'), '/'))"
    ext = f"regexp_extract({p}, '(?:^|/)[^/]+\\.([^./]+)$', 1)"

    def below(*names: str) -> str:
        return "(" + " OR ".join(f"{p} = '{n}' OR starts_with({p}, '{n}/')" for n in names) + ")"

    return (
        f"CASE WHEN {p} = '' THEN NULL WHEN {ext} = 'java' THEN 'Java' WHEN {ext} = 'xml' THEN 'XML' "
        f"WHEN {ext} IN ('sh', 'bat') THEN 'Script' "
        f"WHEN {ext} = 'py' OR {below('config', 'database', 'git', 'notebooks', 'analyzers')} THEN 'Python' "
        f"WHEN {below('tests')} THEN 'PyTest' WHEN {ext} = 'yaml' THEN 'Yaml' WHEN {ext} = 'ipynb' THEN 'Jupyter' END"
    )


def sql_bin(value: str) -> str:
    return (
        f"CASE WHEN {value} >= 0 AND {value} < 1000 THEN '<1k' WHEN {value} >= 1000 AND {value} < 2000 THEN '1k-2k' "
        f"WHEN {value} >= 2000 AND {value} < 3000 THEN '2k-3k' WHEN {value} >= 3000 AND {value} < 10000 THEN '3k-10k' "
        f"WHEN {value} >= 10000 AND {value} < 50000 THEN '10k-50k' ELSE '>=50k' END"
    )


KEPT = "NOT (starts_with(path, '.vscode') OR starts_with(path, 'data') OR starts_with(path, 'doc'))"
XML_COUNT = (
    # well-formed exactly when the closing tag is there and nothing follows it; pages are HTML and never are
    "CASE WHEN starts_with(content, '<doc>') AND ends_with(content, '</doc>') "
    "THEN 1 + len(string_split(content, '<p>')) - 1 ELSE 0 END"
)
JAVA_SQL = JAVA_CLASS_PATTERN.replace(r"(?<!\w)", "")
ANALYSIS = f"""
 SELECT commit_hash, path, analyzer_type, CAST(count AS BIGINT) AS count FROM (
  SELECT commit_hash, path, 'FileCharCount' AS analyzer_type, length(content) AS count, stack FROM s
  UNION ALL
  SELECT commit_hash, path, 'FileLineCount',
   CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + 1 END, stack FROM s
  UNION ALL
  SELECT commit_hash, path, 'XMLElementCount', {XML_COUNT}, stack FROM s WHERE stack = 'XML'
  UNION ALL
  SELECT commit_hash, path, 'JavaClassCount', len(regexp_extract_all(content, '{JAVA_SQL}')), stack FROM s
  WHERE stack = 'Java') a
 WHERE stack IS NOT NULL"""
SNAPSHOT = f"s AS (SELECT *, {sql_extract_stack('path')} AS stack FROM f WHERE {KEPT})"
ZERO = "repeat('0', 40)"
DIFF = f"""
d AS (
 SELECT 'c0' AS base_commit_hash, 'c1' AS target_commit_hash, coalesce(b.path, t.path) AS path,
  CASE WHEN b.path IS NULL THEN 'A' WHEN t.path IS NULL THEN 'D' ELSE 'M' END AS diff_change_type,
  coalesce(b.hash, {ZERO}) AS base_file_hash, coalesce(t.hash, {ZERO}) AS target_file_hash,
  b.content AS base_content, t.content AS target_content
 FROM (SELECT * FROM f WHERE commit_hash = 'c0' AND {KEPT}) b
 FULL OUTER JOIN (SELECT * FROM f WHERE commit_hash = 'c1' AND {KEPT}) t ON b.path = t.path
 WHERE b.hash IS NULL OR t.hash IS NULL OR b.hash <> t.hash)"""
SIDES = f"""
s AS (
 SELECT *, {sql_extract_stack('path')} AS stack FROM (
  SELECT base_commit_hash AS commit_hash, path, coalesce(base_content, '') AS content FROM d
  UNION ALL
  SELECT target_commit_hash, path, coalesce(target_content, '') FROM d) both_sides)"""


# -- derived tables on the Spark side ------------------------------------------------------------------------------


def files_at(spark: SparkSession, sf: str) -> DataFrame:
    return derive(spark, sf, F_PARTS, "f")


def tree_entries(spark: SparkSession, sf: str) -> DataFrame:
    return derive(spark, sf, (FILES, LAKE), "tree_entries")


def blobs(spark: SparkSession, sf: str) -> DataFrame:
    rows = derive_contents(spark, sf, F_PARTS, "f", tree_entries(spark, sf))
    return rows.select("hash", F.encode("content", "UTF-8").alias("content"))


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return trees.snapshot_files(tree_entries(spark, sf), ["c0", "c1"], exclude=paths.DEFAULT_EXCLUDE)


def diff(spark: SparkSession, sf: str) -> DataFrame:
    return trees.tree_diff(tree_entries(spark, sf), ("c0", "c1"), exclude=paths.DEFAULT_EXCLUDE)


def snapshot_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.analyze(snapshot(spark, sf), blobs(spark, sf), bind_analyzers()[0])


def run_rows(spark: SparkSession, sf: str) -> DataFrame:
    return derive(spark, sf, (RUNS,), "runs")


def run_lines(spark: SparkSession, sf: str) -> DataFrame:
    return derive(spark, sf, RUN_PARTS, "run_lines")


def run_tables(spark: SparkSession, sf: str) -> stats.RunTables:
    """The tables of all runs: the manifest and the lines are stored, the rest is picked from the lines as it is read."""
    rows = run_lines(spark, sf)

    def table(name: str) -> DataFrame:
        return pick(spark, (RUN_TABLES,), name, run_lines=rows)

    return stats.RunTables(
        history.with_labels(run_rows(spark, sf)),
        commit_files=table("commit_files"),
        diff_results=table("diff_results"),
        analysis_results=table("analysis_results"),
        commits=table("run_commits"),
    )


def commit_graph(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return derive(spark, sf, (COMMITS,), name)


def two_commit_lake(spark: SparkSession, sf: str) -> RepoTables:
    """The repository of f: branch main at c1, branch old at c0, c1 a child of c0."""
    commits = derive(
        spark,
        sf,
        (FILES,),
        "(SELECT DISTINCT 'lake' AS repository, CASE commit_hash WHEN 'c0' THEN 'old' ELSE 'main' END AS branch, "
        "commit_hash AS hash, concat('commit ', commit_hash) AS message, 'ann' AS author_name, 'ann@x' AS author_email, "
        "TIMESTAMP_NTZ '2024-01-01 10:00:00' AS author_date, 'ann' AS committer_name, 'ann@x' AS committer_email, "
        "TIMESTAMP_NTZ '2024-01-01 10:00:00' AS commit_date FROM f) c",
    )
    parents = spark.createDataFrame([("c1", "c0", 0)], schemas.COMMIT_PARENTS)
    refs = spark.createDataFrame([("lake", "main", "c1", True), ("lake", "old", "c0", False)], schemas.REFS)
    return RepoTables(commits, parents, refs, tree_entries(spark, sf), blobs(spark, sf))


def second(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def edited_lake(spark: SparkSession, sf: str) -> RepoTables:
    """One repository of two commits: v0 has all documents, v1, its child, the same with edits in mid-file."""
    files = derive(spark, sf, (EDITED,), "edited")
    commits = files.select(F.lit("lake").alias("repository"), F.lit("main").alias("branch"), F.col("commit_hash").alias("hash")).distinct()
    parents = spark.createDataFrame([("v1", "v0", 0)], schemas.COMMIT_PARENTS)
    refs = spark.createDataFrame([("lake", "main", "v1", True)], schemas.REFS)
    entries = files.select("commit_hash", "path", F.lit("100644").alias("mode"), "hash")
    return RepoTables(commits, parents, refs, entries, edited_blobs(spark, sf))


def edited_blobs(spark: SparkSession, sf: str) -> DataFrame:
    files = derive(spark, sf, (EDITED,), "edited")
    # both commits hold every document
    rows = once_per_hash(files, files, 2 * source_bytes(spark, sf, "documents"))
    return rows.select("hash", F.encode("content", "UTF-8").alias("content"))


# -- paths and stacks ----------------------------------------------------------------------------------------------


@case(f"SELECT commit_hash, path, {sql_extract_stack('path')} AS tech_stack, hash FROM f WHERE {KEPT}", F_PARTS)
def snapshot_files(spark, sf):
    commits = files_at(spark, sf).select("commit_hash").distinct()
    return trees.snapshot_files(tree_entries(spark, sf), commits, exclude=paths.DEFAULT_EXCLUDE)


@case(
    f"SELECT commit_hash, path, {sql_file_type('path')} AS file_type FROM f "
    "WHERE (starts_with(path, 'src1') OR starts_with(path, '.') OR starts_with(path, 'config') OR "
    "starts_with(path, 'data')) AND NOT (starts_with(path, 'src11') OR starts_with(path, 'database'))",
    F_PARTS,
)
def path_filter(spark, sf):
    path = F.col("path")
    kept = paths.path_kept(path, ["src1", ".", "config", "data"], ["src11", "database"])
    rows = tree_entries(spark, sf).where(kept)
    return rows.select("commit_hash", "path", paths.file_extension(path).alias("file_type"))


@case(f"SELECT repo, run, path, {sql_extract_stack('path')} AS tech_stack FROM run_lines", RUN_PARTS)
def stack_extract(spark, sf):
    rows = run_lines(spark, sf)
    return rows.select("repo", "run", "path", paths.extract_stack(F.col("path")).alias("tech_stack"))


@case(f"SELECT repo, run, path, {sql_report_stack('path')} AS tech_stack FROM run_lines", RUN_PARTS)
def stack_dashboard(spark, sf):
    rows = run_lines(spark, sf)
    return rows.select("repo", "run", "path", paths.report_stack(F.col("path")).alias("tech_stack"))


@case(
    f"SELECT 'Python' AS label, repo, run, path FROM commit_files WHERE {sql_report_stack('path')} = 'Python' UNION ALL "
    f"SELECT '未分类', repo, run, path FROM commit_files WHERE {sql_report_stack('path')} IS NULL UNION ALL "
    f"SELECT 'diff PyTest', repo, run, target_path FROM diff_results WHERE {sql_report_stack('target_path')} = 'PyTest'",
    RUN_PARTS,
)
def filter_by_stack(spark, sf):
    tables = run_tables(spark, sf)

    def rows(table: DataFrame, label: str, name: str, path: str) -> DataFrame:
        chosen = paths.filter_by_stack(table, label)
        return chosen.select(F.lit(name).alias("label"), "repo", "run", F.col(path).alias("path"))

    rest = paths.UNCATEGORIZED_LABEL
    return (
        rows(tables.commit_files, "Python", "Python", "path")
        .unionByName(rows(tables.commit_files, rest, rest, "path"))
        .unionByName(rows(tables.diff_results, "PyTest", "diff PyTest", "target_path"))
    )


@case(
    "SELECT repo, run, trim(replace(raw, chr(92), '/'), '/') AS path FROM ("
    " SELECT repo, run, CASE line WHEN 1 THEN concat('/', path, '/') WHEN 2 THEN concat(chr(92), replace(path, '/', chr(92)))"
    "  WHEN 3 THEN concat('fallback/', path) ELSE path END AS raw FROM run_lines) x",
    RUN_PARTS,
)
def normalize_paths(spark, sf):
    line = F.col("line")
    rows = run_lines(spark, sf).select(
        "repo",
        "run",
        F.when(line == 1, F.concat(F.lit("/"), "path", F.lit("/")))
        .when(line == 2, F.concat(F.lit("\\"), F.translate("path", "/", "\\")))
        .when(line == 3, F.lit("//"))
        .otherwise(F.col("path"))
        .alias("path"),
        F.when(line == 3, F.concat(F.lit("fallback\\"), "path")).alias("file_path"),
    )
    return paths.normalize_paths(rows).select("repo", "run", "path")


@case(
    "SELECT o_orderkey, CASE o_orderkey % 13 WHEN 0 THEN '=' WHEN 1 THEN 'A' WHEN 2 THEN 'D' WHEN 3 THEN 'M' WHEN 4 THEN 'R' "
    "WHEN 5 THEN 'C' WHEN 6 THEN 'I' WHEN 7 THEN '?' WHEN 8 THEN 'T' WHEN 9 THEN '!' WHEN 10 THEN 'U' ELSE 'X' END AS letter "
    "FROM orders"
)
def delta_status(spark, sf):
    orders = read_table(spark, sf, "orders")
    return orders.select("o_orderkey", paths.delta_status(F.col("o_orderkey") % 13).alias("letter"))


@case(f"SELECT doc_id, {sql_bin('n_chars')} AS size_range, {sql_bin('-n_chars')} AS negative_range FROM documents")
def size_bins(spark, sf):
    docs = read_table(spark, sf, "documents")
    value = F.col("n_chars")
    return docs.select(
        "doc_id", paths.size_bin(value).alias("size_range"), paths.size_bin(-value).alias("negative_range")
    )


@case("SELECT commit_hash, path FROM s WHERE stack IS NULL", (FILES, SNAPSHOT))
def unclassified_files(spark, sf):
    return analysis.unclassified_files(snapshot(spark, sf))


@case(
    f"SELECT commit_hash, {sql_file_type('path')} AS file_type, count(*) AS file_count FROM f GROUP BY ALL", F_PARTS
)
def file_count_by_type(spark, sf):
    return stats.file_count_by_type(tree_entries(spark, sf), ["commit_hash"])


@case("SELECT commit_hash, stack AS tech_stack, count(*) AS file_count FROM s GROUP BY ALL", (FILES, SNAPSHOT))
def stack_files_count(spark, sf):
    return stats.stack_files_count(snapshot(spark, sf), ["commit_hash"])


# -- content -------------------------------------------------------------------------------------------------------


@case(
    "SELECT doc_id, doc_id % 4 = 1 OR (doc_id % 4 = 3 AND octet_length(encode(text)) < 1024) AS is_binary, "
    "md5(CASE WHEN doc_id % 4 = 1 OR (doc_id % 4 = 3 AND octet_length(encode(text)) < 1024) THEN '<binary>' "
    "WHEN doc_id % 4 = 2 THEN concat('(', text, chr(65533)) ELSE text END) AS text_md5 FROM documents"
)
def binary_and_decode(spark, sf):
    text = F.encode("text", "UTF-8")
    kind = F.col("doc_id") % 4
    content = (
        F.when(kind == 0, text)
        .when(kind == 1, F.concat(F.lit(b"a\x00"), text))
        .when(kind == 2, F.concat(F.lit(b"\xc3(\x80"), text, F.lit(b"\xff\xef\xbf\xbd\xe2\x82")))
        .otherwise(F.concat(text, F.lit(b"\x00")))
    )
    rows = read_table(spark, sf, "documents").select("doc_id", content.alias("content"))
    decoded = content_functions.snapshot_text(F.lit("a"), F.col("content"))
    return rows.select(
        "doc_id", content_functions.is_binary(F.col("content")).alias("is_binary"), F.md5(decoded).alias("text_md5")
    )


@case(
    "SELECT doc_id, sha1(concat('blob ', octet_length(encode(text)), chr(0), text)) AS blob_hash FROM documents"
)
def blob_hashes(spark, sf):
    docs = read_table(spark, sf, "documents")
    return docs.select("doc_id", content_functions.git_blob_hash(F.encode("text", "UTF-8")).alias("blob_hash"))


@case(
    "SELECT commit_hash, path, md5(text) AS text_md5 FROM ("
    " SELECT base_commit_hash AS commit_hash, path, coalesce(base_content, '<invalid>') AS text FROM d UNION ALL"
    " SELECT target_commit_hash, path, coalesce(target_content, '<invalid>') FROM d) x",
    (FILES, DIFF),
)
def file_texts(spark, sf):
    rows = analysis.file_texts(trees.diff_sides(diff(spark, sf)), blobs(spark, sf))
    return rows.select("commit_hash", "path", F.md5("text").alias("text_md5"))


@case(
    f"SELECT DISTINCT hash AS commit_file_hash, md5(content) AS content_md5 FROM f WHERE {KEPT}", F_PARTS
)
def file_snapshots(spark, sf):
    rows = analysis.file_snapshots(snapshot(spark, sf), blobs(spark, sf))
    return rows.select("commit_file_hash", F.md5("content_snapshot").alias("content_md5"))


@case(ANALYSIS, (FILES, SNAPSHOT))
def analyze_snapshot(spark, sf):
    return snapshot_analysis(spark, sf).drop("content")


@case(ANALYSIS, (FILES, DIFF, SIDES))
def analyze_diff(spark, sf):
    rows = analysis.analyze(trees.diff_sides(diff(spark, sf)), blobs(spark, sf), bind_analyzers()[0])
    return rows.drop("content", "side")


@case(
    "SELECT commit_hash, path, unnest(CASE WHEN stack = 'XML' THEN ['FileLineCount', 'FileCharCount', 'XMLElementCount'] "
    "WHEN stack = 'Java' THEN ['FileLineCount', 'FileCharCount', 'JavaClassCount'] "
    "ELSE ['FileLineCount', 'FileCharCount'] END) AS analyzer_type FROM s WHERE stack IS NOT NULL",
    (FILES, SNAPSHOT),
)
def expand_analyzers(spark, sf):
    rows = analysis.expand_analyzers(snapshot(spark, sf), bind_analyzers()[0])
    return rows.select("commit_hash", "path", "analyzer_type")


VOLUME = (
    "sized AS (SELECT commit_hash, stack AS tech_stack, length(content) AS chars FROM s WHERE stack IS NOT NULL)"
)

# More rules than a machine word has bits: every third one on all stacks, on XML, on Java.
MANY_RULES = [AnalyzerRule(f"Chars{i}", "FileCharCountAnalyzer", (("All", "XML", "Java")[i % 3],)) for i in range(70)]


@case(
    "SELECT commit_hash, concat('Chars', i) AS analyzer_type, count(*) AS files, CAST(sum(chars) AS BIGINT) AS total "
    "FROM sized, range(70) r(i) WHERE i % 3 = 0 OR (i % 3 = 1 AND tech_stack = 'XML') OR (i % 3 = 2 AND tech_stack = 'Java') "
    "GROUP BY ALL",
    (FILES, SNAPSHOT, VOLUME),
)
def many_analyzers(spark, sf):
    rows = analysis.analyze(snapshot(spark, sf), blobs(spark, sf), bind_analyzers(MANY_RULES)[0])
    sums = F.count(F.lit(1)).alias("files"), F.sum("count").alias("total")
    return rows.groupBy("commit_hash", "analyzer_type").agg(*sums)


class CapitalCountAnalyzer(Analyzer):
    """Number of capital letters A to Z, as a user's own analyzer in plain Python."""

    def analyze(self, text):
        return sum("A" <= c <= "Z" for c in text), None


@case(
    "SELECT commit_hash, stack AS tech_stack, count(*) AS files, "
    "CAST(sum(length(regexp_replace(content, '[^A-Z]', '', 'g'))) AS BIGINT) AS capitals FROM s WHERE stack IS NOT NULL GROUP BY ALL",
    (FILES, SNAPSHOT),
)
def registered_analyzer(spark, sf):
    register_analyzer("CapitalCountAnalyzer", CapitalCountAnalyzer)
    try:
        bound = bind_analyzers([AnalyzerRule("Capitals", "CapitalCountAnalyzer", ("All",))])[0]
    finally:
        unregister_analyzer("CapitalCountAnalyzer")
    files = snapshot(spark, sf)
    rows = analysis.analyze(files, blobs(spark, sf), bound).join(files, ["commit_hash", "path"])
    return rows.groupBy("commit_hash", "tech_stack").agg(F.count(F.lit(1)).alias("files"), F.sum("count").alias("capitals"))


PATTERNS = [r"\bclass\s+(\w+)", r"[a-z]{12,}", r"([0-9]+)[.:]([0-9]+)"]


def _regex_sql() -> str:
    found = [f"len(regexp_extract_all(content, '{p}'))" for p in PATTERNS]
    words = f"array_to_string(regexp_extract_all(content, '{PATTERNS[1]}'), '|')"
    pairs = " || '|' || ".join(
        f"array_to_string(regexp_extract_all(content, '{PATTERNS[2]}', {g}), '|')" for g in (1, 2)
    )
    return (
        f"SELECT commit_hash, path, CAST({' + '.join(found)} AS BIGINT) AS match_count, md5({words}) AS words_md5, "
        f"md5({pairs}) AS pairs_md5 FROM f WHERE content <> ''"
    )


def _regex_rows(spark: SparkSession, sf: str, engine: str) -> DataFrame:
    analyzer = RegexMatchCountAnalyzer({"patterns": PATTERNS, "engine": engine})
    rows = files_at(spark, sf).where(content_functions.has_text(F.col("content")))
    count, detail = analyzer.columns(F.col("content"))
    counted = rows.select("commit_hash", "path", count.alias("match_count"), detail.alias("detail"))
    third = F.from_json(_entry(PATTERNS[2]), "struct<matches:array<array<string>>>")
    firsts = F.concat_ws("|", F.transform(third["matches"], lambda m: m[0]))
    seconds = F.concat_ws("|", F.transform(third["matches"], lambda m: m[1]))
    second_pattern = F.from_json(_entry(PATTERNS[1]), "struct<matches:array<string>>")
    return counted.select(
        "commit_hash",
        "path",
        "match_count",
        F.md5(F.concat_ws("|", second_pattern["matches"])).alias("words_md5"),
        F.md5(F.concat(firsts, F.lit("|"), seconds)).alias("pairs_md5"),
    )


def _entry(pattern: str) -> Column:
    """The JSON of one pattern's entry in the analyzer detail."""
    return F.element_at(F.from_json("detail", "map<string,string>"), F.lit(pattern))


@case(_regex_sql(), F_PARTS)
def regex_count(spark, sf):
    return _regex_rows(spark, sf, "auto")


@case(_regex_sql(), F_PARTS)
def regex_count_python(spark, sf):
    return _regex_rows(spark, sf, "python")


@case(
    f"SELECT commit_hash, count(*) AS file_count, CAST(sum({XML_COUNT}) AS BIGINT) AS element_count FROM s "
    "WHERE stack = 'XML' GROUP BY commit_hash",
    (FILES, SNAPSHOT),
)
def xml_elements(spark, sf):
    return stats.xml_elements(snapshot_analysis(spark, sf))


# -- trees ---------------------------------------------------------------------------------------------------------


@case("SELECT commit_hash, path, hash FROM f", F_PARTS)
def flatten_tree(spark, sf):
    objects = derive(spark, sf, (FILES, NESTED), "tree_objects")
    commits = files_at(spark, sf).select("commit_hash").distinct()
    roots = commits.select("commit_hash", F.concat("commit_hash", F.lit(":")).alias("tree_hash"))
    return trees.flatten_tree(objects, roots)


@case(
    "SELECT base_commit_hash, target_commit_hash, path AS base_path, path AS target_path, diff_change_type, "
    f"{sql_extract_stack('path')} AS target_tech_stack, base_file_hash, target_file_hash FROM d",
    (FILES, DIFF),
)
def tree_diff(spark, sf):
    return diff(spark, sf).drop("base_tech_stack", "hunk_char_count", "hunk_line_count")


@case(
    f"SELECT base_commit_hash, target_commit_hash, path AS target_path, CASE WHEN b IS NULL THEN 'A' WHEN t IS NULL THEN 'D' "
    f"ELSE 'M' END AS diff_change_type, coalesce(b, {ZERO}) AS base_file_hash, coalesce(t, {ZERO}) AS target_file_hash FROM ("
    " SELECT base_commit_hash, target_commit_hash, path, max(CASE WHEN e.commit_hash = base_commit_hash THEN hash END) AS b,"
    "  max(CASE WHEN e.commit_hash = target_commit_hash THEN hash END) AS t"
    " FROM order_pairs p JOIN order_entries e ON e.commit_hash = p.base_commit_hash OR e.commit_hash = p.target_commit_hash"
    " GROUP BY ALL) x WHERE b IS NULL OR t IS NULL OR b <> t",
    (ORDER_TREES,),
)
def tree_diff_pairs(spark, sf):
    entries = derive(spark, sf, (ORDER_TREES,), "order_entries")
    pairs = derive(spark, sf, (ORDER_TREES,), "order_pairs")
    rows = trees.tree_diff(entries, pairs)
    return rows.select(
        "base_commit_hash", "target_commit_hash", "target_path", "diff_change_type", "base_file_hash", "target_file_hash"
    )


@case(
    "SELECT r.name AS branch, c.hash, c.author_name, strftime(c.commit_date, '%Y-%m-%d %H:%M:%S') AS committed "
    "FROM commits c JOIN refs r ON r.hash = c.hash WHERE r.name IN ('click', 'view')",
    (COMMITS,),
)
def diff_commits(spark, sf):
    refs = commit_graph(spark, sf, "refs")
    commits = commit_graph(spark, sf, "commits")
    base, target = lineage.branch_tip(refs, "click"), lineage.branch_tip(refs, "view")
    rows = trees.diff_commits(commits, base, target, "click", "view")
    return rows.select("branch", "hash", "author_name", second("commit_date").alias("committed"))


@case(
    ", walk AS (SELECT hash AS tip, hash FROM refs UNION SELECT w.tip, p.parent FROM walk w "
    "JOIN commit_parents p ON p.child = w.hash) SELECT tip, hash FROM walk",
    (COMMITS,),
    recursive=True,
)
def reachable_commits(spark, sf):
    return lineage.reachable(commit_graph(spark, sf, "commit_parents"), commit_graph(spark, sf, "refs"))


@case(
    "SELECT spec, CASE WHEN n = 1 THEN h END AS hash, CASE n WHEN 0 THEN 'unknown' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status "
    "FROM (SELECT spec, count(hash) AS n, min(hash) AS h FROM ("
    " SELECT left(hash, 12) AS spec, hash FROM commits UNION ALL SELECT name, hash FROM refs UNION ALL"
    " SELECT concat('x', left(hash, 9)), NULL FROM commits UNION ALL"
    " SELECT DISTINCT left(a.hash, 4), b.hash FROM commits a JOIN commits b ON left(a.hash, 4) = left(b.hash, 4)) x"
    " GROUP BY spec) y",
    (COMMITS,),
)
def resolve_ref(spark, sf):
    refs = commit_graph(spark, sf, "refs")
    commits = commit_graph(spark, sf, "commits")
    specs = (
        commits.select(F.left("hash", F.lit(12)).alias("spec"))
        .unionByName(refs.select(F.col("name").alias("spec")))
        .unionByName(commits.select(F.concat(F.lit("x"), F.left("hash", F.lit(9))).alias("spec")))
        .unionByName(commits.select(F.left("hash", F.lit(4)).alias("spec")))
    )
    return lineage.resolve_refs(refs, commits, specs)


@case(
    "SELECT branch, arg_max(hash, (commit_date, hash)) AS hash, strftime(max(commit_date), '%Y-%m-%d %H:%M:%S') AS committed "
    "FROM commits GROUP BY branch",
    (COMMITS,),
)
def latest_commits(spark, sf):
    rows = lineage.latest_commits(commit_graph(spark, sf, "commits"))
    return rows.select("branch", "hash", second("commit_date").alias("committed"))


# -- runs ----------------------------------------------------------------------------------------------------------

NAME_TIME = (
    "CASE WHEN regexp_full_match(run, '[0-9]{8}[-_][0-9]{6}|[0-9]{14}|[0-9]{4}-[0-9]{2}-[0-9]{2}[-_][0-9]{2}-[0-9]{2}-[0-9]{2}') "
    "THEN strptime(regexp_replace(run, '[^0-9]', '', 'g'), '%Y%m%d%H%M%S') END"
)
END_TIME = (
    "CASE WHEN ended_at LIKE '%+09:00' THEN strptime(left(ended_at, 19), '%Y-%m-%dT%H:%M:%S') - INTERVAL 9 HOUR "
    "WHEN ended_at LIKE '____-__-__T%' THEN strptime(left(ended_at, 19), '%Y-%m-%dT%H:%M:%S') "
    "WHEN ended_at LIKE ' ____-__-__T%' THEN strptime(trim(ended_at), '%Y-%m-%dT%H:%M:%S') "
    "WHEN ended_at LIKE '____-__-__ %' THEN strptime(ended_at, '%Y-%m-%d %H:%M:%S') END"
)
LABELLED = f"""
labelled AS (
 SELECT *, coalesce(ended, named) AS trend_ts,
  coalesce(strftime(coalesce(ended, named), '%Y-%m-%d %H:%M:%S'), run) AS display_label,
  coalesce(strftime(coalesce(ended, named), '%Y-%m-%d'), run) AS trend_label
 FROM (SELECT repo, run, run_type, order_key, {NAME_TIME} AS named, {END_TIME} AS ended FROM runs) x)"""
LABEL_PARTS = (RUNS, LABELLED)
STAT_PARTS = (RUNS, RUN_LINES, LABELLED)


@case(
    "SELECT repo, run, strftime(named, '%Y-%m-%d %H:%M:%S') AS name_ts, strftime(ended, '%Y-%m-%d %H:%M:%S') AS end_ts, "
    "display_label, trend_label FROM labelled",
    LABEL_PARTS,
)
def run_labels(spark, sf):
    rows = history.with_labels(run_rows(spark, sf))
    return rows.select(
        "repo",
        "run",
        second("timestamp").alias("name_ts"),
        second("ended_at").alias("end_ts"),
        "display_label",
        "trend_label",
    )


REQUESTS = """
requests AS (
 SELECT concat('project', o_custkey) AS project_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'snap' WHEN 1 THEN 'hist' WHEN 2 THEN 'diff' ELSE 'diffb' END AS mode,
  CASE WHEN o_orderkey % 12 = 0 THEN '' ELSE sha1(CAST(o_orderkey AS STRING)) END AS base,
  CASE WHEN o_orderkey % 4 >= 2 THEN sha1(concat('t', o_orderkey)) ELSE '' END AS target, o_orderdate AS started
 FROM orders)"""
NEW_RUNS = (
    "SELECT project_id, concat(mode, '_', strftime(started, '%Y%m%d-%H%M%S'), '-', "
    "left(CASE WHEN target <> '' THEN target WHEN base <> '' THEN base ELSE 'run' END, 7)) AS run_id, "
    "CASE WHEN mode IN ('snap', 'hist') THEN 'snapshot' ELSE 'diff' END AS run_type, "
    "CASE WHEN mode IN ('snap', 'hist') THEN base ELSE concat(base, '..', target) END AS scope_key, "
    "strftime(started, '%Y-%m-%dT%H:%M:%S+00:00Z') AS started_at FROM requests"
)


@case(NEW_RUNS, (REQUESTS,))
def new_runs(spark, sf):
    rows = history.new_runs(derive(spark, sf, (REQUESTS,), "requests"))
    return rows.select("project_id", "run_id", "run_type", "scope_key", "started_at")


def _finished_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every run that has a target finished an hour after its start."""
    requests = derive(spark, sf, (REQUESTS,), "requests")
    manifest = history.new_runs(requests).withColumn("begun", F.try_to_timestamp(F.left("started_at", F.lit(19)), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    done = F.col("scope_key").contains("..")
    ended = F.col("begun") + F.expr("INTERVAL 1 HOUR")
    finished = history.finish_runs(manifest.where(done), ended, F.array(F.lit("data/commits.csv")))
    return finished.unionByName(manifest.where(~done)).drop("begun")


FINISHED = (
    f"finished AS (SELECT *, CASE WHEN contains(scope_key, '..') THEN strftime(strptime(left(started_at, 19), '%Y-%m-%dT%H:%M:%S') "
    f"+ INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S+00:00Z') END AS ended_at FROM ({NEW_RUNS}) n)"
)


@case(
    "SELECT project_id AS id, arg_max(run_id, (started_at, run_id)) AS latest_run, "
    "max(greatest(started_at, ended_at)) AS updated_at, count(*) AS run_count FROM finished GROUP BY project_id",
    (REQUESTS, FINISHED),
)
def project_view(spark, sf):
    return history.project_view(_finished_runs(spark, sf)).select("id", "latest_run", "updated_at", "run_count")


@case(
    "SELECT project_id AS id, run_id, run_type, scope_key, started_at AS created_at, "
    "CASE WHEN ended_at IS NOT NULL THEN 'success' END AS status, ended_at AS completed_at FROM finished",
    (REQUESTS, FINISHED),
)
def project_runs(spark, sf):
    return history.project_runs(_finished_runs(spark, sf))


@case(
    "SELECT repo, run, row_number() OVER (PARTITION BY repo ORDER BY trend_ts ASC NULLS FIRST, run) AS position FROM ("
    " SELECT *, row_number() OVER (PARTITION BY repo ORDER BY run DESC) AS newest FROM labelled) x WHERE newest <= 3",
    LABEL_PARTS,
)
def run_history(spark, sf):
    rows = history.load_history(run_rows(spark, sf), limit=3)
    # the order as a column, so that the check sees it: at most three runs per repository are left here
    spot = F.expr("row_number() OVER (PARTITION BY repo ORDER BY trend_ts ASC NULLS FIRST, run)")
    return rows.select("repo", "run", spot.cast("bigint").alias("position"))


@case(
    "SELECT x.repo, x.run FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY run DESC) AS newest FROM labelled) x "
    "SEMI JOIN run_lines l ON l.repo = x.repo AND l.run = x.run WHERE newest <= 5",
    STAT_PARTS,
)
def run_history_with_data(spark, sf):
    data = run_lines(spark, sf)
    return history.load_history(run_rows(spark, sf), limit=5, with_data=data).select("repo", "run")


@case("SELECT DISTINCT repo, run FROM runs", (RUNS,))
def list_runs(spark, sf):
    return history.list_runs(run_rows(spark, sf))


@case("SELECT DISTINCT repo FROM runs", (RUNS,))
def list_repos(spark, sf):
    return history.list_repos(run_rows(spark, sf))


@case("SELECT DISTINCT repo, run_type FROM runs", (RUNS,))
def run_types(spark, sf):
    return history.run_types(run_rows(spark, sf))


@case("SELECT repo, run FROM runs WHERE run_type = 'diff'", (RUNS,))
def select_runs(spark, sf):
    return history.select_runs(run_rows(spark, sf), "diff").select("repo", "run")


MANIFESTS = """
manifests AS (
 SELECT order_key, CASE order_key % 5 WHEN 0 THEN '' WHEN 1 THEN concat(chr(123), '"run_type":"snap')
  ELSE concat(chr(123), '"run_type":"', coalesce(run_type, 'none'), '","run_id":"', run, '","owner":"', repo,
              '","data_files":["data/commits.csv","data/', order_key, '.csv"]', chr(125)) END AS document
 FROM runs)"""


@case(
    "SELECT m.order_key, CASE WHEN order_key % 5 >= 2 THEN coalesce(run_type, 'none') END AS run_type, "
    "CASE WHEN order_key % 5 >= 2 THEN run END AS run_id, CASE WHEN order_key % 5 >= 2 THEN repo END AS owner, "
    "CASE WHEN order_key % 5 >= 2 THEN concat('data/', order_key, '.csv') END AS last_file "
    "FROM manifests m JOIN runs USING (order_key)",
    (RUNS, MANIFESTS),
)
def run_manifest(spark, sf):
    rows = derive(spark, sf, (RUNS, MANIFESTS), "manifests")
    fields, extra = run_files.parse_run_manifest(F.col("document"))
    return rows.select("order_key", fields.alias("m"), extra.alias("x")).select(
        "order_key",
        "m.run_type",
        "m.run_id",
        F.try_element_at("x", F.lit("owner")).alias("owner"),
        F.try_element_at("m.data_files", F.lit(-1)).alias("last_file"),
    )


@case(
    "SELECT o_orderkey, 'sprint,team' AS names, concat('s', o_orderkey) AS sprint FROM orders"
)
def metadata_merge(spark, sf):
    orders = read_table(spark, sf, "orders")
    extra = F.create_map(
        F.lit("run_id"),
        F.lit("mine"),
        F.lit("sprint"),
        F.concat(F.lit("s"), F.col("o_orderkey").cast("string")),
        F.lit("started_at"),
        F.lit("never"),
        F.lit("team"),
        F.col("o_orderpriority"),
    )
    merged = history.merge_extra(extra, schemas.RESERVED_RUN_FIELDS)
    names = F.concat_ws(",", F.array_sort(F.map_keys(merged)))
    return orders.select("o_orderkey", names.alias("names"), merged["sprint"].alias("sprint"))


# -- statistics ----------------------------------------------------------------------------------------------------

RECORDS = """
records AS (
 SELECT r.repo, r.run, r.trend_ts, r.display_label, CASE r.run_type WHEN 'snapshot' THEN files WHEN 'diff' THEN diffs
  ELSE coalesce(files, diffs) END AS value
 FROM labelled r LEFT JOIN (SELECT repo, run, count(*) AS files FROM commit_files GROUP BY ALL) c USING (repo, run)
 LEFT JOIN (SELECT repo, run, count(*) AS diffs FROM diff_results GROUP BY ALL) d USING (repo, run))"""
CHANGES = """
changes AS (
 SELECT repo, run, trend_ts, count(*) FILTER (diff_change_type = 'A') AS added,
  count(*) FILTER (diff_change_type IN ('M', 'R')) AS changed, count(*) FILTER (diff_change_type = 'D') AS deleted
 FROM diff_results JOIN labelled USING (repo, run) WHERE run_type = 'diff' GROUP BY ALL)"""
AUTHORS = """
authors AS (
 SELECT r.repo, r.run, r.trend_ts, r.display_label, count(DISTINCT c.author_name) AS value
 FROM labelled r JOIN diff_results d USING (repo, run)
 LEFT JOIN run_commits c ON c.repo = d.repo AND c.run = d.run AND c.hash = d.target_commit_hash GROUP BY ALL)"""
CHARS = """
chars AS (
 SELECT repo, run, path, commit_hash, CAST(max(count) AS DOUBLE) AS count FROM analysis_results
 WHERE analyzer_type = 'FileCharCount' GROUP BY ALL),
attached AS (
 SELECT c.repo, c.run, c.path, c.commit_hash, c.count, coalesce(d.diff_change_type, '') AS diff_change_type
 FROM chars c LEFT JOIN diff_results d ON d.repo = c.repo AND d.run = c.run AND d.target_path = c.path
 WHERE d.target_commit_hash IS NULL OR d.target_commit_hash = c.commit_hash),
largest AS (
 SELECT * FROM attached QUALIFY row_number() OVER (
  PARTITION BY repo, run, path ORDER BY count DESC, diff_change_type DESC, commit_hash DESC) = 1)"""


@case("SELECT repo, run, value FROM records", (*STAT_PARTS, RECORDS))
def record_count(spark, sf):
    return stats.record_count(run_tables(spark, sf))


@case(
    "SELECT repo, run, strftime(trend_ts, '%Y-%m-%d %H:%M:%S') AS moment, value FROM records "
    "WHERE trend_ts IS NOT NULL AND value IS NOT NULL",
    (*STAT_PARTS, RECORDS),
)
def record_count_trend(spark, sf):
    rows = stats.record_count_trend(run_tables(spark, sf))
    return rows.select("repo", "run", second("timestamp").alias("moment"), "value")


@case("SELECT repo, run, added, changed, deleted FROM changes", (*STAT_PARTS, CHANGES))
def diff_change_counts(spark, sf):
    return stats.diff_change_counts(run_tables(spark, sf))


@case(
    "SELECT repo, run, strftime(trend_ts, '%Y-%m-%d %H:%M:%S') AS moment, added, changed, deleted FROM changes "
    "WHERE trend_ts IS NOT NULL",
    (*STAT_PARTS, CHANGES),
)
def diff_change_trend(spark, sf):
    rows = stats.diff_change_trend(run_tables(spark, sf))
    return rows.select("repo", "run", second("timestamp").alias("moment"), "added", "changed", "deleted")


@case("SELECT repo, run, value FROM authors", (*STAT_PARTS, AUTHORS))
def unique_authors(spark, sf):
    return stats.unique_authors(run_tables(spark, sf))


@case("SELECT repo, run, display_label AS label, value FROM authors", (*STAT_PARTS, AUTHORS))
def unique_authors_trend(spark, sf):
    return stats.unique_authors_trend(run_tables(spark, sf))


AUTHORS_OVER = """
SELECT run_group, count(DISTINCT c.author_name) AS value FROM (
 SELECT repo, run, unnest([concat('repo ', repo), 'month ' || strftime(trend_ts, '%Y-%m'), 'all']) AS run_group FROM labelled) g
LEFT JOIN diff_results d ON d.repo = g.repo AND d.run = g.run
LEFT JOIN run_commits c ON c.repo = d.repo AND c.run = d.run AND c.hash = d.target_commit_hash
WHERE run_group IS NOT NULL GROUP BY run_group"""


def _run_groups(tables):
    """Every run in the groups of its repository, its month and all runs."""
    month = F.concat(F.lit("month "), F.date_format("trend_ts", "yyyy-MM"))
    group = F.explode(F.array(F.concat(F.lit("repo "), "repo"), month, F.lit("all"))).alias("group")
    return tables.runs.select("repo", "run", group).where(F.col("group").isNotNull())


@case(AUTHORS_OVER, STAT_PARTS)
def unique_authors_over_runs(spark, sf):
    tables = run_tables(spark, sf)
    return stats.unique_authors_over(tables, _run_groups(tables)).withColumnRenamed("group", "run_group")


@case(AUTHORS_OVER.replace("SELECT run_group, count(DISTINCT c.author_name) AS value", "SELECT run_group, true AS close", 1), STAT_PARTS)
def unique_authors_by_sketches(spark, sf):
    """Whether the estimate of each group is within 5 % of the count, three times the standard error, or one author."""
    tables = run_tables(spark, sf)
    groups = _run_groups(tables)
    sketches = materialize(stats.author_sketches(tables), "author-sketches")
    estimated = stats.unique_authors_estimate(sketches, groups).withColumnRenamed("value", "estimate")
    both = estimated.join(stats.unique_authors_over(tables, groups), "group")
    close = F.abs(F.col("estimate") - F.col("value")) <= F.greatest(F.lit(1.0), F.col("value") * 0.05)
    return both.select(F.col("group").alias("run_group"), close.alias("close"))


@case("SELECT repo, run, path, commit_hash, count AS char_count FROM chars", (*STAT_PARTS, CHARS))
def load_char_counts(spark, sf):
    return stats.load_char_counts(run_tables(spark, sf)).withColumnRenamed("count", "char_count")


@case(
    "SELECT repo, run, path, commit_hash, count AS char_count, diff_change_type FROM largest", (*STAT_PARTS, CHARS)
)
def diff_metadata(spark, sf):
    tables = run_tables(spark, sf)
    rows = stats.attach_diff_metadata(stats.load_char_counts(tables), tables.diff_results, stats.hot_paths(tables))
    return stats.largest_per_path(rows).withColumnRenamed("count", "char_count")


@case(
    "SELECT repo, run, bool_or(diff_change_type <> '') AS diff_info FROM attached JOIN runs USING (repo, run) "
    "WHERE run_type = 'diff' GROUP BY ALL",
    (*STAT_PARTS, CHARS),
)
def has_diff_info(spark, sf):
    return stats.has_diff_info(run_tables(spark, sf))


def _distribution_sql() -> str:
    """Bins of every run, from the largest row per path: after the diff for diff runs, of all rows for the others."""
    return f"""
     SELECT b.repo, b.run, b.size_range, count(v.size_range) AS total,
      CASE WHEN b.split THEN count(*) FILTER (v.diff_change_type = 'A') END AS added,
      CASE WHEN b.split THEN count(*) FILTER (v.diff_change_type IN ('M', 'R')) END AS changed
     FROM (SELECT DISTINCT repo, run, split, unnest(['<1k', '1k-2k', '2k-3k', '3k-10k', '10k-50k', '>=50k']) AS size_range
           FROM (SELECT repo, run, run_type = 'diff' AND bool_or(diff_change_type <> '') AS split FROM chosen
                 GROUP BY repo, run, run_type) s) b
     LEFT JOIN (SELECT repo, run, diff_change_type, {sql_bin('count')} AS size_range FROM chosen) v
      ON v.repo = b.repo AND v.run = b.run AND v.size_range = b.size_range
     GROUP BY b.repo, b.run, b.size_range, b.split"""


CHOSEN = """
chosen AS (
 SELECT l.repo, l.run, r.run_type, l.path, l.count, l.diff_change_type FROM largest l JOIN runs r USING (repo, run)
 WHERE r.run_type = 'diff'
 UNION ALL
 SELECT c.repo, c.run, r.run_type, c.path, max(c.count), '' FROM chars c JOIN runs r USING (repo, run)
 WHERE r.run_type IS DISTINCT FROM 'diff' GROUP BY ALL)"""


@case(_distribution_sql(), (*STAT_PARTS, CHARS, CHOSEN))
def char_count_distribution(spark, sf):
    return stats.char_count_distribution(run_tables(spark, sf)).withColumnRenamed("range", "size_range")


@case(
    "SELECT commit_hash, tech_stack, CAST(sum(chars) AS DOUBLE) AS total_char_count, count(*) AS file_count FROM sized "
    "GROUP BY ALL",
    (FILES, SNAPSHOT, VOLUME),
)
def code_volume_share(spark, sf):
    files = snapshot(spark, sf)
    return stats.code_volume_share(snapshot_analysis(spark, sf), files, ["commit_hash"])


@case(
    "SELECT commit_hash, tech_stack, "
    + ", ".join(
        f"count(*) FILTER ({sql_bin('chars')} = '{b.label}') AS \"{b.label}\"" for b in paths.SIZE_BINS
    )
    + " FROM sized GROUP BY ALL",
    (FILES, SNAPSHOT, VOLUME),
)
def code_volume_levels(spark, sf):
    files = snapshot(spark, sf)
    return stats.code_volume_levels(snapshot_analysis(spark, sf), files, ["commit_hash"])


# -- line changes --------------------------------------------------------------------------------------------------


# Lines of both sides by their characters without ASCII white space; of those with equal characters the longest of a side stay.
SQL_LINE_CHANGES = (
    "SELECT 'c0' AS base_commit_hash, 'c1' AS target_commit_hash, d.path AS file_path, "
    + ", ".join(
        f"CAST(coalesce({what} FILTER (side = {side} AND place <= own - other), 0) AS BIGINT) AS {name}"
        for what, side, name in (
            ("count(*)", 1, "added_lines"),
            ("count(*)", 0, "deleted_lines"),
            ("sum(n)", 1, "added_chars"),
            ("sum(n)", 0, "deleted_chars"),
        )
    )
    + " FROM d LEFT JOIN (SELECT path, side, n, row_number() OVER (PARTITION BY path, key, side ORDER BY n) AS place,"
    " count(*) OVER (PARTITION BY path, key, side) AS own,"
    " count(*) OVER (PARTITION BY path, key) - count(*) OVER (PARTITION BY path, key, side) AS other FROM ("
    "  SELECT path, side, regexp_replace(line, '\\s', '', 'g') AS key, length(trim(line, ' ' || chr(9) || chr(13))) AS n"
    "  FROM (SELECT path, unnest(string_split(coalesce(base_content, ''), chr(10))) AS line, 0 AS side FROM d UNION ALL"
    "   SELECT path, unnest(string_split(coalesce(target_content, ''), chr(10))), 1 FROM d) l) m"
    "  WHERE key <> '') k ON k.path = d.path GROUP BY d.path"
)


@case(SQL_LINE_CHANGES, (FILES, DIFF))
def line_changes(spark, sf):
    return lines.line_changes(diff(spark, sf), blobs(spark, sf))


# Every changed file of these commits has lines added at its end, or is whole on one side, so order makes no difference.
@case(SQL_LINE_CHANGES, (FILES, DIFF))
def line_changes_ordered(spark, sf):
    return lines.line_changes_ordered(diff(spark, sf), blobs(spark, sf))


# -- sinks and sources ---------------------------------------------------------------------------------------------


@case(
    "SELECT 'lake' AS repo, branch AS run, hash, message, author_name, strftime(commit_date, '%Y-%m-%d %H:%M:%S.%f') AS committed "
    "FROM commits",
    (COMMITS,),
)
def csv_round_trip(spark, sf):
    base = fresh_dir(spark, "csv")
    commits = commit_graph(spark, sf, "commits")
    for row in commit_graph(spark, sf, "refs").select("name").collect():
        one = commits.where(F.col("branch") == row.name).withColumn("author_email", F.lit(None).cast("string"))
        sinks.write_csv(one, f"{base}/lake/runs/{row.name}/data/commits.csv")
    back = run_files.read_run_csv(spark, base, "commits").where(F.col("author_email").isNull())
    committed = F.date_format("commit_date", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return back.select("repo", "run", "hash", "message", "author_name", committed.alias("committed"))


@case(
    "SELECT 'lake' AS repo, CASE WHEN branch = 'click' THEN 'plain' ELSE 'permuted' END AS run, "
    "CASE WHEN length(author_name) % 2 = 0 THEN 'A' ELSE 'M' END AS diff_change_type, count(*) AS files, "
    "count(DISTINCT CASE WHEN branch <> 'click' THEN author_name END) AS authors FROM commits GROUP BY ALL",
    (COMMITS,),
)
def read_reordered_csv(spark, sf):
    """Two runs whose tables name their columns in different orders; one of them has an author column."""
    base = fresh_dir(spark, "reordered")
    commits = commit_graph(spark, sf, "commits")
    kind = F.when(F.length("author_name") % 2 == 0, "A").otherwise("M").alias("diff_change_type")
    target, path = F.col("hash").alias("target_commit_hash"), F.concat_ws("/", "branch", "hash").alias("target_path")
    plain, click = [kind, target, path], F.col("branch") == "click"
    permuted = [F.col("author_name").alias("author"), path, kind, target]
    sinks.write_csv(commits.where(click).select(*plain), f"{base}/lake/runs/plain/data/diff_results.csv")
    sinks.write_csv(commits.where(~click).select(*permuted), f"{base}/lake/runs/permuted/data/diff_results.csv")
    back = run_files.read_run_csv(spark, base, "diff_results").where("target_path LIKE concat('%/', target_commit_hash)")
    sums = F.count(F.lit(1)).alias("files"), F.countDistinct("author").alias("authors")
    return back.groupBy("repo", "run", "diff_change_type").agg(*sums)


@case("SELECT repo, run, path, commit_hash, analyzer_type, count AS value FROM analysis_results", RUN_PARTS)
def parquet_round_trip(spark, sf):
    base = fresh_dir(spark, "parquet")
    rows = pick(spark, (RUN_TABLES,), "analysis_results", run_lines=run_lines(spark, sf))
    sinks.write_run_parquet(
        rows.select("repo", "run", *[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.ANALYSIS_RESULTS]),
        f"{base}/analysis_results",
        buckets=16,
    )
    back = run_files.read_run_parquet(spark, base, "analysis_results")
    return back.select("repo", "run", "path", "commit_hash", "analyzer_type", F.col("count").alias("value"))


@case("SELECT hash, author_name FROM commits WHERE branch NOT IN ('view', 'click')", (COMMITS,))
def insert_if_absent(spark, sf):
    commits = commit_graph(spark, sf, "commits")
    stored = commits.where(F.col("branch").isin("view", "click"))
    batch = commits.unionByName(commits.withColumn("branch", F.lit("zzz")))
    return sinks.new_commits(batch, stored).select("hash", "author_name")


@case("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_check(spark, sf):
    lineitem = read_table(spark, sf, "lineitem")
    return sinks.duplicate_keys(lineitem, ["l_orderkey", "l_linenumber"])


@case(
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 3 AND l_quantity > 25 "
    "UNION SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL "
    "HAVING count(*) > 1 OR l_linenumber = 1"
)
def clashes_with_stored(spark, sf):
    """A batch whose first lines occur twice, against a table that holds the lines of large quantity."""
    lineitem = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    batch = lineitem.where("l_linenumber <= 3").unionAll(lineitem.where("l_linenumber = 1"))
    stored = lineitem.where("l_quantity > 25")
    return sinks.key_clashes(batch, ["l_orderkey", "l_linenumber"], stored)


@case("SELECT hash, branch, author_name FROM commits", (COMMITS,))
def csv_append(spark, sf):
    """One CSV in two appends; one with other columns is refused."""
    path = f"{fresh_dir(spark, 'append')}/lake/runs/all/data/commits.csv"
    commits = commit_graph(spark, sf, "commits")
    first = F.col("branch").isin("view", "click")
    sinks.write_csv(commits.where(first), path, append=True)
    sinks.write_csv(commits.where(~first), path, append=True)
    try:
        sinks.write_csv(commits.select("hash", "branch"), path, append=True)
    except ValueError:
        base = path.removesuffix("/lake/runs/all/data/commits.csv")
        return run_files.read_run_csv(spark, base, "commits").select("hash", "branch", "author_name")
    raise AssertionError("an append with other columns went through")


@case(
    "SELECT path AS target_path, 'M' AS diff_change_type, b.hash AS base_file_hash, t.hash AS target_file_hash "
    "FROM (SELECT * FROM f WHERE commit_hash = 'c0') b JOIN (SELECT * FROM f WHERE commit_hash = 'c1') t USING (path) "
    "WHERE b.hash <> t.hash OR path LIKE '%.sh'",
    F_PARTS,
)
def tree_diff_modes(spark, sf):
    """Scripts become executable between the commits: a change of mode alone is a modification."""
    executable = (F.col("commit_hash") == "c1") & F.col("path").endswith(".sh")
    mode = F.when(executable, "100755").otherwise(F.col("mode"))
    rows = trees.tree_diff(tree_entries(spark, sf).withColumn("mode", mode), ("c0", "c1"))
    kept = rows.where("diff_change_type NOT IN ('A', 'D')")
    return kept.select("target_path", "diff_change_type", "base_file_hash", "target_file_hash")


class MessageLengthStatistic(stats.Statistic):
    """A user's own statistic: characters of the commit messages of every run."""

    name = "message_length"
    needs = ("commits",)

    def single(self, tables):
        return tables.commits.groupBy("repo", "run").agg(F.sum(F.char_length("message")).alias("value"))


@case("SELECT 'lake' AS repo, branch AS run, CAST(sum(length(message)) AS BIGINT) AS value FROM commits GROUP BY ALL", (COMMITS,))
def registered_statistic(spark, sf):
    commits = commit_graph(spark, sf, "commits").withColumns({"repo": F.lit("lake"), "run": F.col("branch")})
    runs = history.with_labels(commits.select("repo", "run", F.lit("snapshot").alias("run_type"), F.lit("").alias("ended_at")).distinct())
    tables = stats.RunTables(runs=runs, commits=commits, commit_files=None, diff_results=None, analysis_results=None)
    stats.register_statistic(MessageLengthStatistic())
    try:
        return jobs.statistics_job(tables)["message_length"]
    finally:
        stats.unregister_statistic("message_length")


@case(
    "SELECT repo, run, table_name, any_value(n) AS row_count, CASE WHEN any_value(n) IS NULL THEN 'missing' ELSE 'loaded' END AS status "
    "FROM (SELECT repo, run, unnest(['commits', 'commit_files', 'diff_results', 'analysis_results']) AS table_name "
    " FROM (SELECT DISTINCT repo, run FROM run_lines) r) k LEFT JOIN ("
    " SELECT repo, run, 'commits' AS table_name, count(*) AS n FROM run_commits GROUP BY ALL UNION ALL"
    " SELECT repo, run, 'commit_files', count(*) FROM commit_files GROUP BY ALL UNION ALL"
    " SELECT repo, run, 'diff_results', count(*) FROM diff_results GROUP BY ALL UNION ALL"
    " SELECT repo, run, 'analysis_results', count(*) FROM analysis_results GROUP BY ALL) t USING (repo, run, table_name) "
    "GROUP BY ALL",
    RUN_PARTS,
)
def load_report(spark, sf):
    tables = run_tables(spark, sf)
    return run_files.load_report(
        {
            "commits": tables.commits,
            "commit_files": tables.commit_files,
            "diff_results": tables.diff_results,
            "analysis_results": tables.analysis_results,
        }
    )


@case(
    "SELECT path, sha1(concat('blob ', octet_length(encode(content)), chr(0), content)) AS hash, "
    "CAST(octet_length(encode(content)) AS BIGINT) AS bytes FROM f WHERE commit_hash = 'c1'",
    F_PARTS,
)
def checkout_files(spark, sf):
    root = re.sub("^file:/*", "/", fresh_dir(spark, "checkout"))
    if "://" in root:
        raise RuntimeError(f"a checkout needs a shared folder mounted on all executors, not {root}")
    files = files_at(spark, sf).where(F.col("commit_hash") == "c1").select("path", "content")

    def save(batches):
        import os

        import pandas as pd

        for batch in batches:
            for path, content in batch.itertuples(index=False):
                os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
                with open(os.path.join(root, path), "wb") as file:
                    file.write(content.encode())
            yield pd.DataFrame({"files": [len(batch)]})

    files.mapInPandas(save, "files bigint").write.format("noop").mode("overwrite").save()
    rows = checkout.read_tree(spark, root, "c1")
    return rows.select("path", "hash", F.octet_length("content").cast("bigint").alias("bytes"))


@case(
    "SELECT commit_hash, path, hash, length(content) AS chars FROM f",
    F_PARTS,
)
def repo_tables(spark, sf):
    folder = fresh_dir(spark, "lake")
    lake = two_commit_lake(spark, sf)
    for name in ("commits", "commit_parents", "refs", "tree_entries", "blobs"):
        getattr(lake, name).write.parquet(f"{folder}/{name}")
    back = load_repo_tables(spark, folder)
    rows = analysis.file_texts(back.tree_entries, back.blobs)
    return rows.select("commit_hash", "path", "hash", content_functions.char_count(F.col("text")).alias("chars"))


# -- jobs ----------------------------------------------------------------------------------------------------------


def _written(spark: SparkSession, results: jobs.Results) -> DataFrame:
    """Write a run as CSV, read it back and count its tables."""
    base = fresh_dir(spark, "artifacts")
    jobs.write_run(spark, results, base, "lake")
    parts = []
    measures = {
        "commits": F.lit(0),
        "commit_files": F.lit(0),
        "diff_results": F.lit(0),
        "analysis_results": F.col("count"),
    }
    for table, measure in measures.items():
        rows = run_files.read_run_csv(spark, base, table)
        if rows is not None:
            label = F.col("analyzer_type") if table == "analysis_results" else F.lit("")
            grouped = rows.groupBy(F.lit(table).alias("table_name"), label.alias("detail"))
            parts.append(
                grouped.agg(F.count(F.lit(1)).alias("row_count"), F.sum(measure).cast("bigint").alias("total"))
            )
    manifest = run_files.read_run_manifest(spark, base)
    parts.append(
        manifest.groupBy(F.lit("run").alias("table_name"), F.concat_ws(" ", "run_type", "scope_key", "status").alias("detail")).agg(
            F.count(F.lit(1)).alias("row_count"), F.sum(F.size("data_files")).cast("bigint").alias("total")
        )
    )
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def _job_sql(commits: int, tables: str, run: str, files: int) -> str:
    return (
        f"SELECT 'commits' AS table_name, '' AS detail, CAST({commits} AS BIGINT) AS row_count, CAST(0 AS BIGINT) AS total "
        f"UNION ALL {tables} UNION ALL "
        f"SELECT 'analysis_results', analyzer_type, count(*), CAST(sum(count) AS BIGINT) FROM ({ANALYSIS}) a GROUP BY analyzer_type "
        f"UNION ALL SELECT 'run', '{run}', 1, {files}"
    )


SNAPSHOT_C0 = SNAPSHOT.replace("FROM f WHERE", "FROM f WHERE commit_hash = 'c0' AND")
FILE_COUNT = "SELECT 'commit_files', '', count(*), 0 FROM s"
DIFF_COUNT = "SELECT 'diff_results', '', count(*), 0 FROM d"


@case(_job_sql(1, FILE_COUNT, "snapshot c0 success", 3), (FILES, SNAPSHOT_C0))
def job_snapshot(spark, sf):
    return _written(spark, jobs.snapshot_job(two_commit_lake(spark, sf), "c0", "main"))


@case(_job_sql(1, FILE_COUNT, "snapshot c0 success", 3), (FILES, SNAPSHOT_C0))
def job_history(spark, sf):
    return _written(spark, jobs.history_job(two_commit_lake(spark, sf), branch="old"))


@case(_job_sql(2, DIFF_COUNT, "diff c0..c1 success", 3), (FILES, DIFF, SIDES))
def job_diff(spark, sf):
    return _written(spark, jobs.diff_job(two_commit_lake(spark, sf), "old", "main"))


@case(_job_sql(2, DIFF_COUNT, "diff old..main success", 3), (FILES, DIFF, SIDES))
def job_diff_branch(spark, sf):
    return _written(spark, jobs.diff_branch_job(two_commit_lake(spark, sf), "old", "main"))


@case(
    f"""SELECT 'record_count' AS statistic, repo, run, CAST(value AS BIGINT) AS value FROM (
      SELECT r.repo, r.run, CASE r.run_type WHEN 'snapshot' THEN files WHEN 'diff' THEN diffs ELSE coalesce(files, diffs) END AS value
      FROM runs r
      LEFT JOIN (SELECT repo, run, count(*) FILTER ({sql_report_stack('path')} = 'Python') AS files FROM commit_files GROUP BY ALL) c
       USING (repo, run)
      LEFT JOIN (SELECT repo, run, count(*) FILTER ({sql_report_stack('target_path')} = 'Python') AS diffs FROM diff_results
       GROUP BY ALL) d USING (repo, run)) x
    UNION ALL
    SELECT 'diff_change_counts', repo, run, count(*) FILTER ({sql_report_stack('target_path')} = 'Python' AND
      diff_change_type IN ('A', 'M', 'R', 'D')) FROM diff_results JOIN runs USING (repo, run) WHERE run_type = 'diff' GROUP BY ALL
    UNION ALL
    SELECT 'unique_authors', d.repo, d.run, count(DISTINCT c.author_name) FROM diff_results d
     LEFT JOIN run_commits c ON c.repo = d.repo AND c.run = d.run AND c.hash = d.target_commit_hash
      AND {sql_report_stack('d.target_path')} = 'Python' GROUP BY ALL
    UNION ALL
    SELECT 'char_count_distribution', repo, run, CAST(sum(total) AS BIGINT) FROM (
     SELECT repo, run, count(DISTINCT path) AS total FROM chars WHERE {sql_report_stack('path')} = 'Python' GROUP BY ALL) y
     GROUP BY ALL""",
    (*STAT_PARTS, CHARS),
)
def job_statistics(spark, sf):
    found = jobs.statistics_job(run_tables(spark, sf), stack="Python")
    values = {
        "record_count": F.max("value"),
        "diff_change_counts": F.sum(F.col("added") + F.col("changed") + F.col("deleted")),
        "unique_authors": F.max("value"),
        "char_count_distribution": F.sum("total"),
    }
    table = None
    for name, value in values.items():
        rows = found[name].groupBy(F.lit(name).alias("statistic"), "repo", "run").agg(value.cast("bigint").alias("value"))
        table = rows if table is None else table.unionByName(rows)
    return table


@case(
    "SELECT 'record_count' AS statistic, branch AS run, count(*) AS value FROM commits GROUP BY ALL UNION ALL "
    "SELECT 'unique_authors', branch, count(DISTINCT author_name) FROM commits GROUP BY ALL UNION ALL "
    "SELECT 'diff_change_counts', branch, count(*) FROM commits GROUP BY ALL",
    (COMMITS,),
)
def statistics_of_new_runs(spark, sf):
    """Runs come in three steps, each followed by an update of the store: one is added to, one comes last, one step brings nothing."""
    base, store = fresh_dir(spark, "arriving"), fresh_dir(spark, "statistics")
    commits = commit_graph(spark, sf, "commits")
    kind = F.when(F.length("author_name") % 2 == 0, "A").otherwise("M").alias("diff_change_type")
    rows = commits.select("branch", "hash", kind, F.col("hash").alias("target_commit_hash"), F.col("hash").alias("target_path"), F.col("author_name").alias("author"))
    early = F.pmod(F.xxhash64("hash"), F.lit(2)) == 0
    branches = [r.name for r in commit_graph(spark, sf, "refs").select("name").orderBy("name").collect()]
    last = branches[-1]

    def write(name: str, chosen: Column) -> None:
        run = f"{base}/lake/runs/{name}"
        sinks.write_csv(rows.where((F.col("branch") == name) & chosen).drop("branch", "hash"), f"{run}/data/diff_results.csv", append=True)
        sinks.write_csv(commits.where((F.col("branch") == name) & chosen), f"{run}/data/commits.csv", append=True)
        sinks.write_manifest(spark.range(1).select(F.lit("diff").alias("run_type")), f"{run}/run.json")

    statistics = {n: s for n, s in stats.registered_statistics().items() if n in ("record_count", "diff_change_counts", "unique_authors")}
    for name in branches[:-1]:
        write(name, early if name == branches[0] else F.lit(True))
    increments.update_statistics(spark, base, store, statistics=statistics)
    write(branches[0], ~early)
    write(last, F.lit(True))
    increments.update_statistics(spark, base, store, statistics=statistics)
    increments.update_statistics(spark, base, store, statistics=statistics)
    found = {name: increments.stored_statistic(spark, store, name) for name in statistics}
    values = {"record_count": F.col("value"), "unique_authors": F.col("value"), "diff_change_counts": F.col("added") + F.col("changed") + F.col("deleted")}
    parts = [found[n].select(F.lit(n).alias("statistic"), "run", v.cast("bigint").alias("value")) for n, v in values.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# -- ancestors and merge bases -------------------------------------------------------------------------------------


@case(
    "SELECT DISTINCT hash, CAST(steps AS BIGINT) AS steps, CASE WHEN found >= 0 THEN sha1(concat('commit ', found)) END AS ancestor FROM ("
    " SELECT sha1(concat('commit ', event_id)) AS hash, steps, CASE WHEN steps <= event_id % 10 THEN event_id - steps "
    "  ELSE event_id - event_id % 10 - 10 * (steps - event_id % 10) END AS found FROM ("
    "  SELECT event_id, unnest([0, event_id % 13, event_id // 7]) AS steps FROM events) s) t",
)
def ancestors(spark, sf):
    number = F.regexp_extract("message", "^change ([0-9]+)", 1).cast("bigint")
    steps = F.explode(F.array(F.lit(0).cast("bigint"), number % 13, F.floor(number / 7))).alias("steps")
    specs = commit_graph(spark, sf, "commits").select("hash", steps)
    return lineage.ancestors(commit_graph(spark, sf, "commit_parents"), specs)


ANCESTRY = """
anc AS (
 SELECT DISTINCT hash AS tip, hash FROM refs
 UNION
 SELECT a.tip, p.parent FROM anc a JOIN commit_parents p ON p.child = a.hash),
common AS (SELECT x.tip AS a, y.tip AS b, x.hash FROM anc x JOIN anc y ON x.hash = y.hash)
"""


@case(
    "SELECT a, b, hash AS base FROM common c WHERE NOT EXISTS ("
    " SELECT 1 FROM commit_parents p JOIN common d ON d.hash = p.child WHERE p.parent = c.hash AND d.a = c.a AND d.b = c.b)",
    (COMMITS, ANCESTRY),
    recursive=True,
)
def merge_bases(spark, sf):
    tips = commit_graph(spark, sf, "refs").select("hash").distinct()
    pairs = tips.withColumnRenamed("hash", "a").join(tips.withColumnRenamed("hash", "b"), F.lit(True))
    return lineage.merge_bases(commit_graph(spark, sf, "commit_parents"), pairs)


# -- renames -------------------------------------------------------------------------------------------------------


@case(
    f"""SELECT base_path, target_path, diff_change_type, base_file_hash, target_file_hash FROM (
     SELECT b.path AS base_path, t.path AS target_path, 'M' AS diff_change_type, b.hash AS base_file_hash, t.hash AS target_file_hash
     FROM moved b JOIN moved t ON b.path = t.path WHERE b.commit_hash = 'm0' AND t.commit_hash = 'm1' AND b.hash <> t.hash
     UNION ALL
     SELECT coalesce(d.path, a.path), coalesce(a.path, d.path),
      CASE WHEN d.path IS NULL THEN 'A' WHEN a.path IS NULL THEN 'D' ELSE 'R' END, coalesce(d.hash, {ZERO}), coalesce(a.hash, {ZERO})
     FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY left(sha1(path), 2), path) AS k FROM moved m
           WHERE commit_hash = 'm0' AND path NOT IN (SELECT path FROM moved WHERE commit_hash = 'm1')) d
     FULL JOIN (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY left(sha1(path), 2), path) AS k FROM moved m
           WHERE commit_hash = 'm1' AND path NOT IN (SELECT path FROM moved WHERE commit_hash = 'm0')) a
     ON a.hash = d.hash AND a.k = d.k) x""",
    (MOVED,),
)
def diff_renames(spark, sf):
    entries = derive(spark, sf, (MOVED,), "moved")
    found = trees.with_renames(trees.tree_diff(entries, ("m0", "m1")))
    return found.select("base_path", "target_path", "diff_change_type", "base_file_hash", "target_file_hash")


def _edited_and_moved(spark, sf):
    """The edited texts, of which every third file moves as well, and two commits of their trees."""
    edited = derive(spark, sf, (EDITED,), "edited")
    moves = (F.col("commit_hash") == "v1") & (F.pmod(F.xxhash64("path"), F.lit(3)) == 0)
    path = F.when(moves, F.regexp_replace("path", "^src/", "lib/")).otherwise(F.col("path"))
    entries = edited.select("commit_hash", path.alias("path"), F.lit("100644").alias("mode"), "hash")
    return entries, edited_blobs(spark, sf)


@case()
def diff_similar_renames(spark, sf):
    entries, blobs = _edited_and_moved(spark, sf)
    found = renames.with_similar_renames(trees.tree_diff(entries, ("v0", "v1")), blobs)
    return found.select("base_path", "target_path", "diff_change_type", "base_file_hash", "target_file_hash")


@case(
    f"""SELECT coalesce(s.path, a.path) AS base_path, a.path AS target_path, CASE WHEN s.path IS NULL THEN 'A' ELSE 'C' END AS
     diff_change_type, CASE WHEN s.path IS NULL THEN {ZERO} ELSE a.hash END AS base_file_hash, a.hash AS target_file_hash,
     {sql_extract_stack('coalesce(s.path, a.path)')} AS base_tech_stack
    FROM (SELECT * FROM moved m WHERE commit_hash = 'm1' AND path NOT IN (SELECT path FROM moved WHERE commit_hash = 'm0')) a
    LEFT JOIN (SELECT hash, min(path) AS path FROM moved WHERE commit_hash = 'm0' GROUP BY hash) s ON s.hash = a.hash""",
    (MOVED,),
)
def diff_copies(spark, sf):
    entries = derive(spark, sf, (MOVED,), "moved")
    found = renames.with_copies(trees.tree_diff(entries, ("m0", "m1")), entries).where(F.col("diff_change_type").isin("A", "C"))
    return found.select("base_path", "target_path", "diff_change_type", "base_file_hash", "target_file_hash", "base_tech_stack")


# -- nested trees --------------------------------------------------------------------------------------------------


@case(
    "SELECT 'n0' AS base_commit_hash, 'n1' AS target_commit_hash, coalesce(b.path, t.path) AS path, CASE WHEN b.path IS NULL THEN 'A' "
    f"WHEN t.path IS NULL THEN 'D' ELSE 'M' END AS diff_change_type, {sql_extract_stack('coalesce(b.path, t.path)')} AS tech_stack, "
    f"coalesce(b.hash, {ZERO}) AS base_file_hash, coalesce(t.hash, {ZERO}) AS target_file_hash "
    "FROM (SELECT * FROM nests WHERE commit_hash = 'n0') b FULL JOIN (SELECT * FROM nests WHERE commit_hash = 'n1') t ON b.path = t.path "
    "WHERE b.hash IS DISTINCT FROM t.hash",
    (NESTS,),
)
def nested_tree_diff(spark, sf):
    objects, roots = nested_objects(derive(spark, sf, (NESTS,), "nests"))
    ends = {
        name: roots.where(F.col("commit_hash") == commit).selectExpr(f"commit_hash AS {name}_commit_hash", f"tree_hash AS {name}_tree_hash")
        for name, commit in (("base", "n0"), ("target", "n1"))
    }
    pairs = ends["base"].join(ends["target"], F.lit(True))
    found = trees.nested_tree_diff(objects, pairs)
    names = ("base_commit_hash", "target_commit_hash", "base_path", "diff_change_type", "base_tech_stack", "base_file_hash", "target_file_hash")
    return found.select(*names).withColumnsRenamed({"base_path": "path", "base_tech_stack": "tech_stack"})


# -- history with hunks --------------------------------------------------------------------------------------------


@case(
    "SELECT base_commit_hash, target_commit_hash, path, CAST(hunk AS INT) AS hunk, base_start, base_lines, target_start, target_lines, "
    "CAST(deleted_chars AS BIGINT) AS deleted_chars, CAST(added_chars AS BIGINT) AS added_chars FROM hunks",
    (EDITS_SQL,),
)
def history_hunks(spark, sf):
    found = jobs.history_tables(edited_lake(spark, sf)).hunks
    return found.drop("base_path").withColumnRenamed("target_path", "path")


@case(
    "SELECT base_commit_hash, target_commit_hash, path, CASE WHEN target_commit_hash = 'v0' THEN 'A' ELSE 'M' END AS "
    "diff_change_type, CAST(sum(base_lines + target_lines) AS INT) AS hunk_line_count, CAST(sum(deleted_chars + added_chars) AS INT) AS "
    "hunk_char_count FROM hunks GROUP BY ALL",
    (EDITS_SQL,),
)
def history_diff(spark, sf):
    found = jobs.history_tables(edited_lake(spark, sf)).diff_results
    path = F.col("target_path").alias("path")
    return found.select("base_commit_hash", "target_commit_hash", path, "diff_change_type", "hunk_line_count", "hunk_char_count")


@case(
    "SELECT path AS file_path, CAST(sum(target_lines) AS BIGINT) AS added_lines, CAST(sum(base_lines) AS BIGINT) AS deleted_lines, "
    "CAST(sum(added_chars) AS BIGINT) AS added_chars, CAST(sum(deleted_chars) AS BIGINT) AS deleted_chars FROM hunks "
    "WHERE target_commit_hash = 'v1' GROUP BY path",
    (EDITS_SQL,),
)
def line_changes_in_order(spark, sf):
    lake = edited_lake(spark, sf)
    found = trees.tree_diff(lake.tree_entries, ("v0", "v1"))
    return lines.line_changes_ordered(found, lake.blobs).drop("base_commit_hash", "target_commit_hash")

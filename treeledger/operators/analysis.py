"""Running analyzers over files: one row per file and applicable analyzer.

Content is looked at once per distinct blob, however many files, commits and repositories share it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import has_text, snapshot_text
from ..scratch import materialize
from .analyzers import ALL_STACKS, BoundAnalyzer
from .skew import hot_counts, short_list, spread_join


def analyzer_rules(stack: Column, analyzers: Sequence[BoundAnalyzer]) -> Column:
    """Positions of the analyzers that apply to the stack; none for an unclassified file, even of ``All`` analyzers."""

    def listed(positions: list[int]) -> Column:
        return F.array(*[F.lit(i) for i in positions]).cast("array<int>")

    named = sorted({name for b in analyzers for name in b.rule.stacks} - {ALL_STACKS})
    found = listed([i for i, b in enumerate(analyzers) if ALL_STACKS in b.rule.stacks])
    if named:
        rules = {name: listed([i for i, b in enumerate(analyzers) if b.applies_to(name)]) for name in named}
        table = F.create_map(*[x for name, positions in rules.items() for x in (F.lit(name), positions)])
        found = F.coalesce(F.try_element_at(table, stack), found)
    return F.when(stack.isNull(), listed([])).otherwise(found)


def analyzer_applies(stack: Column, bound: BoundAnalyzer) -> Column:
    """Whether one analyzer runs on files of a stack."""
    return F.size(analyzer_rules(stack, [bound])) > 0


def expand_analyzers(files: DataFrame, analyzers: Sequence[BoundAnalyzer]) -> DataFrame:
    """Files repeated once per applicable analyzer, with ``analyzer_type``; no join is needed for a handful of rules."""
    named = [F.when(analyzer_applies(F.col("tech_stack"), b), F.lit(b.rule.name)) for b in analyzers]
    names = F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")
    return files.withColumn("analyzer_type", F.explode(names))


def file_texts(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Files with the text of their blob; a missing blob gives the stand-in text."""
    others = [c for c in files.columns if c != "hash"]
    joined = spread_join(files, _wanted_texts(files, blobs), ["hash"], others, "left", stream_right=True)
    text = F.coalesce("text", snapshot_text(F.col("hash"), F.lit(None).cast("binary")))
    return joined.select(*files.columns, text.alias("text"))


def _wanted_texts(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """``hash, text`` of the blobs that the files name; their contents stay where they are scanned while the list is short."""
    hashes = materialize(files.select("hash").where(F.col("hash").isNotNull()).distinct(), "hashes")
    found = blobs.select("hash", "content").join(short_list(hashes), "hash")
    return found.select("hash", snapshot_text(F.col("hash"), F.col("content")).alias("text"))


def file_snapshots(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Text of every distinct blob of the files: ``commit_file_hash, content_snapshot``."""
    hashes = files.select("hash").where(F.col("hash").isNotNull()).distinct()
    joined = hashes.hint("shuffle_hash").join(_wanted_texts(files, blobs), "hash", "left")
    text = F.coalesce("text", snapshot_text(F.col("hash"), F.lit(None).cast("binary")))
    return joined.select(F.col("hash").alias("commit_file_hash"), text.alias("content_snapshot"))


def unclassified_files(files: DataFrame) -> DataFrame:
    """Files no stack rule matched."""
    return files.where(F.col("tech_stack").isNull()).select("commit_hash", "path")


def blob_results(found: DataFrame, analyzers: Sequence[BoundAnalyzer]) -> DataFrame:
    """``hash`` and one ``(count, content)`` column per analyzer, from ``hash, rules, content``.

    A column is NULL where the rules do not ask for that analyzer or the content is no text, and no work is done there.
    """
    text = snapshot_text(F.col("hash"), F.col("content"))
    texts = found.select("hash", "rules", text.alias("text"))
    texts = texts.select("hash", "rules", F.when(has_text(F.col("text")), F.col("text")).alias("text"))
    results = []
    for i, bound in enumerate(analyzers):
        asked = F.array_contains("rules", i)
        count, content = bound.analyzer.columns(F.when(asked, F.col("text")))
        results.append(F.struct(count.cast("bigint").alias("count"), content.alias("content")).alias(f"_result{i}"))
    return texts.select("hash", *results)


def analyze(files: DataFrame, blobs: DataFrame, analyzers: Sequence[BoundAnalyzer]) -> DataFrame:
    """Analysis rows of classified files: ``commit_hash, path, analyzer_type, count, content``.

    Empty, binary and missing content counts 0. Further columns of ``files`` (repo, run, side) are kept in front.
    ``blobs`` holds one row per hash.

    The list of wanted blobs is small next to the blobs themselves. When it is small enough to be broadcast it is
    sent to the executors and content is analyzed where it is scanned. Beyond that both sides are shuffled by hash, but contents
    are not sorted; a blob table bucketed by hash then still keeps its content in place.
    """
    extra = [c for c in files.columns if c not in ("commit_hash", "path", "hash", "tech_stack")]
    classified = files.withColumn("rules", analyzer_rules(F.col("tech_stack"), analyzers)).where(F.size("rules") > 0)
    classified = classified.select(*extra, "commit_hash", "path", "hash", "rules")

    per_hash = classified.groupBy("hash")
    every = F.array_distinct(F.flatten(F.collect_set("rules"))).alias("rules")
    wanted = materialize(per_hash.agg(every, F.count(F.lit(1)).alias("files")), "wanted")
    asked = short_list(wanted.select("hash", "rules"))
    results = blob_results(blobs.join(asked, "hash").select("hash", "rules", "content"), analyzers)

    joined = spread_join(
        classified,
        results,
        ["hash"],
        [*extra, "commit_hash", "path"],
        "left",
        hot=hot_counts(wanted, ["hash"], "files"),
    )
    rows = [
        F.when(
            F.array_contains("rules", i),
            F.struct(
                F.lit(bound.rule.name).alias("analyzer_type"),
                F.coalesce(F.col(f"_result{i}.count"), F.lit(0).cast("bigint")).alias("count"),
                F.col(f"_result{i}.content").alias("content"),
            ),
        )
        for i, bound in enumerate(analyzers)
    ]
    empty = F.array().cast("array<struct<analyzer_type:string,count:bigint,content:string>>")
    # no row has an empty array here; the outer form spares a filter that would build every array twice
    found = F.explode_outer(F.array_compact(F.array(*rows)) if rows else empty)
    exploded = joined.select(*extra, "commit_hash", "path", found.alias("r"))
    return exploded.select(*extra, "commit_hash", "path", "r.analyzer_type", "r.count", "r.content")

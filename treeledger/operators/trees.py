"""Trees of commits: flattening nested trees, snapshots, and diffs of any number of commit pairs in one job."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.content import ZERO_HASH
from ..functions.paths import DEFAULT_STACKS, StackRule, extract_stack, path_kept
from ..scratch import materialize
from .skew import BROADCAST_ROWS, largest_group, spread_join


def flatten_tree(tree_objects: DataFrame, roots: DataFrame) -> DataFrame:
    """Full blob paths of ``roots(commit_hash, tree_hash)``: ``commit_hash, path, hash``.

    One join per directory level. Entries that are neither tree nor blob (submodules) are left out.
    """
    children = tree_objects.where(F.col("type").isin("tree", "blob"))
    widest = largest_group(children, ["tree_hash"])
    level = roots.select("commit_hash", F.lit("").alias("prefix"), "tree_hash")
    levels = []
    while True:
        step = spread_join(
            level,
            children,
            ["tree_hash"],
            ["commit_hash", "prefix"],
            spread_right=["name"],
            most=level.count(),
            most_right=widest,
        )
        path = F.concat("prefix", "name").alias("path")
        step = materialize(step.select("commit_hash", path, "type", "child_hash"), "tree-level")
        levels.append(step.where(F.col("type") == "blob").select("commit_hash", "path", F.col("child_hash").alias("hash")))
        level = step.where(F.col("type") == "tree").select(
            "commit_hash", F.concat("path", F.lit("/")).alias("prefix"), F.col("child_hash").alias("tree_hash")
        )
        if level.isEmpty():
            # the deepest level holds blobs only
            return reduce(DataFrame.unionByName, levels)


def snapshot_files(
    tree_entries: DataFrame,
    commits: DataFrame | Sequence[str],
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    stacks: Sequence[StackRule] = DEFAULT_STACKS,
) -> DataFrame:
    """Files of the chosen commits with their stack: ``commit_hash, path, tech_stack, hash``.

    ``commits`` is a short list of hashes, which becomes a scan filter, or a table with ``commit_hash`` of any size.
    """
    kept = tree_entries.where(path_kept(F.col("path"), include, exclude))
    if isinstance(commits, DataFrame):
        kept = spread_join(kept, commits.select("commit_hash").distinct(), ["commit_hash"], ["path"], "left_semi")
    else:
        kept = kept.where(F.col("commit_hash").isin(*commits))
    return kept.select("commit_hash", "path", extract_stack(F.col("path"), stacks).alias("tech_stack"), "hash")


def tree_diff(
    tree_entries: DataFrame,
    pairs: DataFrame | tuple[str, str],
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    stacks: Sequence[StackRule] = DEFAULT_STACKS,
) -> DataFrame:
    """Added, deleted and modified files of commit pairs, one row per pair and path, unchanged files left out.

    ``pairs`` is one (base, target) or a table of ``base_commit_hash, target_commit_hash`` (further columns are kept in
    front). Both sides of a path meet in one grouping, so the entries are scanned and shuffled once. Both path columns
    hold the same path and an absent side has the zero hash, as in a diff without rename detection.
    """
    entries = tree_entries.where(path_kept(F.col("path"), include, exclude))
    mode = F.col("mode") if "mode" in entries.columns else F.lit(None).cast("string")
    entries = entries.select("commit_hash", "path", F.struct("hash", mode.alias("mode")).alias("entry"))
    if isinstance(pairs, DataFrame):
        pair = pairs.columns
        side = F.explode(
            F.array(
                F.struct(F.col("base_commit_hash").alias("commit_hash"), F.lit(False).alias("target_side")),
                F.struct(F.col("target_commit_hash").alias("commit_hash"), F.lit(True).alias("target_side")),
            )
        )
        sides = pairs.select(*pair, side.alias("s")).select(*pair, "s.commit_hash", "s.target_side")
        joined = spread_join(entries, sides, ["commit_hash"], ["path"], spread_right=[*pair, "target_side"])
        on_base, on_target = ~F.col("target_side"), F.col("target_side")
    else:
        base, target = pairs
        pair = ["base_commit_hash", "target_commit_hash"]
        joined = entries.where(F.col("commit_hash").isin(base, target)).withColumns(
            {"base_commit_hash": F.lit(base), "target_commit_hash": F.lit(target)}
        )
        on_base, on_target = F.col("commit_hash") == base, F.col("commit_hash") == target
    # A path has one row a side, so nothing is combined before the shuffle: aggregates of structs would sort all rows there.
    sides_of_path = joined.repartition(*pair, "path").groupBy(*pair, "path").agg(
        F.max(F.when(on_base, F.col("entry"))).alias("b"), F.max(F.when(on_target, F.col("entry"))).alias("t")
    )
    return _changed_files(sides_of_path, pair, stacks)


def _changed_files(sides_of_path: DataFrame, pair: Sequence[str], stacks: Sequence[StackRule]) -> DataFrame:
    """Diff rows of the paths whose entries ``b`` and ``t`` (hash and mode, NULL on an absent side) differ."""
    changed = sides_of_path.where(~F.col("b").eqNullSafe(F.col("t")))
    letter = F.when(F.col("b").isNull(), "A").when(F.col("t").isNull(), "D").otherwise("M")
    stack = extract_stack(F.col("path"), stacks)
    return changed.select(
        *pair,
        F.col("path").alias("base_path"),
        F.col("path").alias("target_path"),
        letter.alias("diff_change_type"),
        stack.alias("base_tech_stack"),
        stack.alias("target_tech_stack"),
        F.coalesce("b.hash", F.lit(ZERO_HASH)).alias("base_file_hash"),
        F.coalesce("t.hash", F.lit(ZERO_HASH)).alias("target_file_hash"),
        F.lit(None).cast("int").alias("hunk_char_count"),
        F.lit(None).cast("int").alias("hunk_line_count"),
    )


def nested_tree_diff(
    tree_objects: DataFrame,
    pairs: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    stacks: Sequence[StackRule] = DEFAULT_STACKS,
) -> DataFrame:
    """The rows of ``tree_diff`` from nested trees, descending only where two subtrees have different hashes.

    ``pairs`` has ``base_commit_hash, target_commit_hash, base_tree_hash, target_tree_hash`` (the roots; further columns are kept
    in front, a NULL root has no files). Each level is one join of the trees that differ with their entries and one grouping by
    name, so the rows touched grow with the change and the entries next to it, and equal subtrees need not even be stored. A name
    that is a file on one side and a folder on the other is a deleted file and added ones, or the other way round. Submodules are
    left out. A column ``mode`` of ``tree_objects`` is compared for files.
    """
    children = tree_objects.where(F.col("type").isin("tree", "blob"))
    mode = F.col("mode") if "mode" in children.columns else F.lit(None).cast("string")
    children = children.select("tree_hash", "name", "type", F.struct(F.col("child_hash").alias("hash"), mode.alias("mode")).alias("entry"))
    pair = [c for c in pairs.columns if c not in ("base_tree_hash", "target_tree_hash")]
    place = [*pair, "prefix"]
    level = pairs.withColumn("prefix", F.lit("")).where(~F.col("base_tree_hash").eqNullSafe(F.col("target_tree_hash")))
    files = []
    while True:
        side = F.explode(
            F.array(
                F.struct(F.col("base_tree_hash").alias("tree_hash"), F.lit(False).alias("target_side")),
                F.struct(F.col("target_tree_hash").alias("tree_hash"), F.lit(True).alias("target_side")),
            )
        )
        sides = level.select(*place, side.alias("s")).select(*place, "s.tree_hash", "s.target_side").where("tree_hash IS NOT NULL")
        sides = materialize(sides, "tree-sides")
        if sides.isEmpty() and files:
            return _changed_files(reduce(DataFrame.unionByName, files), pair, stacks)
        entries = _entries_of(children, sides)
        joined = spread_join(sides, entries, ["tree_hash"], [*place, "target_side"], spread_right=["name"], most=sides.count())
        both = joined.groupBy(*place, "name", "type").agg(
            F.max(F.when(~F.col("target_side"), F.col("entry"))).alias("b"), F.max(F.when(F.col("target_side"), F.col("entry"))).alias("t")
        )
        # a folder's own mode says nothing
        differs = F.when(F.col("type") == "tree", ~F.col("b.hash").eqNullSafe(F.col("t.hash"))).otherwise(~F.col("b").eqNullSafe(F.col("t")))
        step = both.where(differs).withColumn("path", F.concat("prefix", "name"))
        step = materialize(step.select(*pair, "path", "type", "b", "t"), "tree-differences")
        files.append(step.where((F.col("type") == "blob") & path_kept(F.col("path"), include, exclude)).select(*pair, "path", "b", "t"))
        level = step.where(F.col("type") == "tree").select(
            *pair,
            F.concat("path", F.lit("/")).alias("prefix"),
            F.col("b.hash").alias("base_tree_hash"),
            F.col("t.hash").alias("target_tree_hash"),
        )


def _entries_of(children: DataFrame, sides: DataFrame) -> DataFrame:
    """The entries of the trees at hand; while these are counted to be few, entries are chosen where they are scanned."""
    wanted = sides.select("tree_hash").distinct()
    if wanted.count() > BROADCAST_ROWS:
        return children
    return materialize(children.join(F.broadcast(wanted), "tree_hash", "left_semi"), "tree-children")


def pair_columns(diff: DataFrame) -> list[str]:
    """The two commits, and whatever a diff has beside its own columns."""
    return [c for c in diff.columns if c in ("base_commit_hash", "target_commit_hash") or c not in schemas.DIFF_RESULTS.names]


def one_sided_files(diff: DataFrame) -> DataFrame:
    """Added and deleted files of a diff: ``pair, added, path, stack, hash``.

    ``pair`` holds the columns of the pair as one value, in which NULL equals NULL when it is joined.
    """
    added = F.col("diff_change_type") == "A"
    return diff.where(F.col("diff_change_type").isin("A", "D")).select(
        F.struct(*pair_columns(diff)).alias("pair"),
        added.alias("added"),
        F.when(added, F.col("target_path")).otherwise(F.col("base_path")).alias("path"),
        F.when(added, F.col("target_tech_stack")).otherwise(F.col("base_tech_stack")).alias("stack"),
        F.when(added, F.col("target_file_hash")).otherwise(F.col("base_file_hash")).alias("hash"),
    )


def ranked_files(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Files numbered from 1 within their group (``rank``), by the first two digits of the path's SHA-1, then by path.

    Ranks are counted within those digits first, so a group of very many files is not ranked in one task.
    """
    rows = materialize(rows.withColumn("digits", F.left(F.sha1("path"), F.lit(2))), "one-sided")
    counts = rows.groupBy(*group, "digits").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*group).orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "digits", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*group, "digits").orderBy("path")
    ranked = rows.withColumn("place", F.row_number().over(inside)).join(counts, [*group, "digits"])
    return materialize(ranked.select(*group, "path", "stack", (F.col("place") + F.col("before")).alias("rank")), "ranked")


def with_renames(diff: DataFrame) -> DataFrame:
    """A diff in which a deleted and an added file of one commit pair with the same content are one renamed file (``R``).

    Every deleted file takes part in at most one rename, and so does every added one. Where several files have one content, they
    are paired by rank (``ranked_files``). Other rows stay as they are.
    """
    ranked = ranked_files(one_sided_files(diff), ["pair", "added", "hash"])

    def side(is_added: bool, name: str) -> DataFrame:
        chosen = ranked.where("added" if is_added else "NOT added")
        return chosen.select("pair", "hash", "rank", *[F.col(c).alias(f"{name}_{c}") for c in ("path", "stack")])

    both = side(False, "base").join(side(True, "target"), ["pair", "hash", "rank"], "full_outer")
    gone, new = F.col("base_path").isNotNull(), F.col("target_path").isNotNull()
    found = both.select(
        "pair.*",
        F.coalesce("base_path", "target_path").alias("base_path"),
        F.coalesce("target_path", "base_path").alias("target_path"),
        F.when(gone & new, "R").when(new, "A").otherwise("D").alias("diff_change_type"),
        F.when(gone, F.col("base_stack")).otherwise(F.col("target_stack")).alias("base_tech_stack"),
        F.when(new, F.col("target_stack")).otherwise(F.col("base_stack")).alias("target_tech_stack"),
        F.when(gone, F.col("hash")).otherwise(F.lit(ZERO_HASH)).alias("base_file_hash"),
        F.when(new, F.col("hash")).otherwise(F.lit(ZERO_HASH)).alias("target_file_hash"),
        F.lit(None).cast("int").alias("hunk_char_count"),
        F.lit(None).cast("int").alias("hunk_line_count"),
    )
    rest = diff.where(~F.col("diff_change_type").isin("A", "D") | F.col("diff_change_type").isNull())
    return rest.unionByName(found.select(*diff.columns))


def diff_sides(diff: DataFrame) -> DataFrame:
    """Each diff row as a base file and a target file: ``commit_hash, path, hash, tech_stack``.

    An added file has a base row with the zero hash, a deleted one a target row.
    """
    extra = [
        c
        for c in diff.columns
        if not c.startswith(("base_", "target_", "hunk_")) and c not in ("diff_change_type",)
    ]
    side = [
        F.struct(
            F.lit(s).alias("side"),
            F.col(f"{s}_commit_hash").alias("commit_hash"),
            F.col(f"{s}_path").alias("path"),
            F.col(f"{s}_file_hash").alias("hash"),
            F.col(f"{s}_tech_stack").alias("tech_stack"),
        )
        for s in ("base", "target")
    ]
    exploded = diff.select(*extra, F.explode(F.array(*side)).alias("s"))
    return exploded.select(*extra, "s.side", "s.commit_hash", "s.path", "s.hash", "s.tech_stack")


def diff_commits(commits: DataFrame, base: str, target: str, base_branch: str, target_branch: str) -> DataFrame:
    """The base row and the target row of a diff, each with its branch."""

    def side(commit_hash: str, branch: str) -> DataFrame:
        return commits.where(F.col("hash") == commit_hash).withColumn("branch", F.lit(branch))

    return side(base, base_branch).unionByName(side(target, target_branch))

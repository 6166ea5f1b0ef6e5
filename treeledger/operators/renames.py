"""Renamed files that changed on the way, and copied files: what rows by path alone show as deleted and added."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.content import has_text, snapshot_text
from ..functions.paths import DEFAULT_STACKS, StackRule, extract_stack
from ..scratch import materialize
from . import skew
from .skew import short_list, spread_join
from .trees import one_sided_files, pair_columns, ranked_files, with_renames

# Share of the larger text, in per cent, that common lines must have in a renamed file that changed.
LEAST_SIMILARITY = 50


def with_similar_renames(diff: DataFrame, blobs: DataFrame, least: int = LEAST_SIMILARITY) -> DataFrame:
    """``with_renames``, then deleted and added files of similar content are renamed files (``R``) too, one to one.

    Similar are texts whose common lines (as a multiset, unchanged) hold at least ``least`` per cent of the characters that the lines
    of the longer text have. Of all similar contents of a commit pair the most similar ones are paired first, ties by the smaller
    base hash, then target hash; of several files with one content those of lower rank (``ranked_files``) go first. Binary contents,
    missing ones and texts of blank lines are similar to none. Rows of other files stay as they are.

    Candidates come from rare lines: in the order from rare to frequent, similar texts share a line among the first that leave less
    than ``least`` per cent behind, so a line that all files share makes none unless a text is mostly made of such lines. Contents
    are compared, not files; copies of a content cost nothing more.
    """
    if not 0 < least <= 100:
        raise ValueError("the least similarity is a percentage above 0")
    diff = with_renames(diff)
    files = materialize(one_sided_files(diff), "one-sided")
    contents = materialize(files.groupBy("pair", "added", "hash").agg(F.count(F.lit(1)).alias("n")), "contents")
    edges = _similar(contents, blobs, least)
    chosen = _best_first(edges)
    ranked = ranked_files(files, ["pair", "added", "hash"])
    return _renamed(diff, ranked, chosen)


def _similar(contents: DataFrame, blobs: DataFrame, least: int) -> DataFrame:
    """``pair, b, t, score, b_left, t_left``: similar deleted and added contents, the similarity and how many files have each."""
    lines = _lines(contents, blobs)
    frequency = lines.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    rest = Window.partitionBy("hash").orderBy(F.desc("df"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("weight").over(Window.partitionBy("hash"))
    n_lines = lines.count()
    by_rarity = spread_join(lines, frequency, ["key"], ["hash"], most=n_lines)
    by_rarity = by_rarity.select("hash", "key", total.alias("total"), F.sum("weight").over(rest).alias("rest"))
    telling = by_rarity.where(F.col("rest") * 100 >= F.col("total") * least).select("hash", "key", "total")
    telling = materialize(telling, "telling-lines")
    n_contents, n_telling = contents.count(), telling.count()

    def side(added: bool, name: str) -> DataFrame:
        chosen = contents.where("added" if added else "NOT added").select("pair", "hash", "n")
        found = spread_join(telling, chosen, ["hash"], ["key"], spread_right=["pair"], most=n_telling, most_right=n_contents)
        return found.select("pair", "key", F.col("hash").alias(name), F.col("total").alias(f"{name}_total"), F.col("n").alias(f"{name}_left"))

    met = spread_join(side(False, "b"), side(True, "t"), ["pair", "key"], ["b"], spread_right=["t"])
    larger, smaller = F.greatest("b_total", "t_total"), F.least("b_total", "t_total")
    met = met.where(smaller * 100 >= larger * least).drop("key").distinct()
    met = materialize(met, "rename-candidates")
    couples = materialize(met.select("b", "t").distinct(), "rename-couples")
    n_met = met.count()
    of_base = lines.select(F.col("hash").alias("b"), "key", F.col("n").alias("b_n"), "chars")
    of_target = lines.select(F.col("hash").alias("t"), "key", F.col("n").alias("t_n"))
    of_couple = spread_join(couples, of_base, ["b"], ["t"], spread_right=["key"], most=n_met, most_right=n_lines)
    shared = spread_join(of_couple, of_target, ["t", "key"], ["b"])
    common = shared.groupBy("b", "t").agg(F.sum(F.least("b_n", "t_n") * F.col("chars")).alias("common"))
    scored = spread_join(met, common, ["b", "t"], ["pair"], most=n_met)
    scored = scored.where(F.col("common") * 100 >= larger * least)
    return scored.select("pair", "b", "t", (F.col("common") / larger).alias("score"), "b_left", "t_left")


def _lines(contents: DataFrame, blobs: DataFrame) -> DataFrame:
    """``hash, key, n, chars, weight``: the distinct lines of every content with a text, how often and how long."""
    hashes = short_list(contents.select("hash").distinct())
    text: Column = snapshot_text(F.col("hash"), F.col("content"))
    texts = blobs.join(hashes, "hash", "left_semi").select("hash", text.alias("text")).where(has_text(F.col("text")))
    line = texts.select("hash", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    keyed = line.select("hash", F.xxhash64("line").alias("key"), F.char_length("line").cast("bigint").alias("chars"))
    counted = keyed.groupBy("hash", "key").agg(F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars"))
    return materialize(counted.withColumn("weight", F.col("n") * F.col("chars")), "content-lines")


def _best_first(edges: DataFrame) -> DataFrame:
    """``pair, b, t, b_used, t_used, n``: contents paired greedily by similarity, ``n`` files each, behind those used before.

    Each round takes the edges that are best at both ends, which the greedy order takes before any other edge of the two.
    """
    order = F.struct((-F.col("score")).alias("cost"), "b", "t")
    zero = F.lit(0).cast("bigint")
    edges = edges.select("pair", "b", "t", order.alias("order"), "b_left", "t_left", zero.alias("b_used"), zero.alias("t_used"))
    taken: list[DataFrame] = []
    while True:
        edges = materialize(edges, "rename-edges")
        most = edges.count()
        best = {end: edges.groupBy("pair", end).agg(F.min("order").alias(f"best_of_{end}")) for end in ("b", "t")}
        mutual = spread_join(edges, best["b"], ["pair", "b"], ["t"], most=most)
        mutual = spread_join(mutual, best["t"], ["pair", "t"], ["b"], most=most)
        mutual = mutual.where((F.col("order") == F.col("best_of_b")) & (F.col("order") == F.col("best_of_t")))
        chosen = mutual.select("pair", "b", "t", "b_used", "t_used", F.least("b_left", "t_left").alias("n"))
        chosen = materialize(chosen, "renames-chosen")
        taken.append(chosen)
        if chosen.isEmpty():
            break
        at_b = chosen.select("pair", "b", F.col("n").alias("b_n"))
        at_t = chosen.select("pair", "t", F.col("n").alias("t_n"))
        edges = spread_join(edges, at_b, ["pair", "b"], ["t"], "left", most=most)
        edges = spread_join(edges, at_t, ["pair", "t"], ["b"], "left", most=most)
        for end in ("b", "t"):
            gone = F.coalesce(f"{end}_n", zero)
            edges = edges.withColumns({f"{end}_left": F.col(f"{end}_left") - gone, f"{end}_used": F.col(f"{end}_used") + gone})
        edges = edges.where("b_left > 0 AND t_left > 0").drop("b_n", "t_n")
    out = taken[0]
    for more in taken[1:-1]:
        out = out.unionByName(more)
    return out


def _renamed(diff: DataFrame, ranked: DataFrame, chosen: DataFrame) -> DataFrame:
    """The diff with the chosen files as renamed ones in place of their deleted and added rows."""

    def side(added: bool, end: str, name: str) -> DataFrame:
        place = F.col("rank") - F.col(f"{end}_used")
        files = ranked.where("added" if added else "NOT added").withColumnRenamed("hash", end)
        found = spread_join(files, chosen, ["pair", end], ["path"], spread_right=["b", "t"]).where((place >= 1) & (place <= F.col("n")))
        return found.select("pair", "b", "t", place.alias("place"), F.col("path").alias(f"{name}_path"), F.col("stack").alias(f"{name}_stack"))

    both = side(False, "b", "base").join(side(True, "t", "target"), ["pair", "b", "t", "place"])
    both = materialize(both, "renamed")
    found = both.select(
        "pair.*",
        "base_path",
        "target_path",
        F.lit("R").alias("diff_change_type"),
        F.col("base_stack").alias("base_tech_stack"),
        F.col("target_stack").alias("target_tech_stack"),
        F.col("b").alias("base_file_hash"),
        F.col("t").alias("target_file_hash"),
        F.lit(None).cast("int").alias("hunk_char_count"),
        F.lit(None).cast("int").alias("hunk_line_count"),
    )
    gone = both.select("pair", F.col("base_path").alias("_path"), F.lit("D").alias("_type"))
    new = both.select("pair", F.col("target_path").alias("_path"), F.lit("A").alias("_type"))
    replaced = gone.unionByName(new).withColumn("_replaced", F.lit(True))
    marked = diff.withColumns(
        {
            "pair": F.struct(*pair_columns(diff)),
            "_type": F.col("diff_change_type"),
            "_path": F.when(F.col("diff_change_type") == "D", F.col("base_path")).otherwise(F.col("target_path")),
        }
    )
    kept = marked.join(replaced, ["pair", "_path", "_type"], "left_anti").select(*diff.columns)
    return kept.unionByName(found.select(*diff.columns))


def with_copies(diff: DataFrame, tree_entries: DataFrame, stacks: Sequence[StackRule] = DEFAULT_STACKS) -> DataFrame:
    """A diff in which an added file whose content some file of the base commit has is a copy (``C``) of it.

    The source is the base file with the first path by code point. Unlike a rename it stays where it is, and may be copied any number of
    times. Apply it after the renames, which take deleted files for themselves. Other rows stay as they are.
    """
    pair = pair_columns(diff)
    added = F.col("diff_change_type") == "A"
    rows = materialize(diff.where(added), "added")
    wanted = rows.select(F.col("base_commit_hash").alias("commit_hash"), F.col("target_file_hash").alias("hash")).distinct()
    if wanted.count() <= skew.BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    held = tree_entries.select("commit_hash", "hash", "path").join(wanted, ["commit_hash", "hash"], "left_semi")
    sources = held.groupBy(F.col("commit_hash").alias("base_commit_hash"), F.col("hash").alias("target_file_hash")).agg(
        F.min("path").alias("_source")
    )
    sources = materialize(sources, "copy-sources")
    joined = spread_join(rows, sources, ["base_commit_hash", "target_file_hash"], [*pair, "target_path"], "left")
    copied = F.col("_source").isNotNull()
    found = joined.withColumns(
        {
            "base_path": F.coalesce("_source", "base_path"),
            "diff_change_type": F.when(copied, "C").otherwise(F.col("diff_change_type")),
            "base_tech_stack": F.when(copied, extract_stack(F.col("_source"), stacks)).otherwise(F.col("base_tech_stack")),
            "base_file_hash": F.when(copied, F.col("target_file_hash")).otherwise(F.col("base_file_hash")),
        }
    )
    return diff.where(~added | added.isNull()).unionByName(found.select(*diff.columns))

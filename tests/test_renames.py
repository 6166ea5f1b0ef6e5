"""Renames with changes and copies against brute force, and diffs of nested trees."""

import random

from pyspark.sql import functions as F

from treeledger.operators import renames, trees
from treeledger.schemas import DIFF_RESULTS

ZERO = "0" * 40


def diff_of(spark, rows):
    """Rows of ``project, base path, target path, letter, base hash, target hash``."""
    schema = "project string, base_path string, target_path string, diff_change_type string, base_file_hash string, target_file_hash string"
    made = spark.createDataFrame(rows, schema).selectExpr(
        "project", "'b' AS base_commit_hash", "'t' AS target_commit_hash", "base_path", "target_path", "diff_change_type",
        "'s' AS base_tech_stack", "'s' AS target_tech_stack", "base_file_hash", "target_file_hash",
        "CAST(NULL AS INT) AS hunk_char_count", "CAST(NULL AS INT) AS hunk_line_count",
    )
    return made.select("project", *DIFF_RESULTS.names)


def similarity(a, b):
    x, y = ([line for line in text.split("\n") if line.strip(" ")] for text in (a, b))
    common = sum(min(x.count(line), y.count(line)) * len(line) for line in set(x))
    longest = max(sum(map(len, x)), sum(map(len, y)))
    return common, longest


def brute(gone, new, texts, least):
    """Contents paired greedily: from ``hash -> number of files`` on both sides to ``(b, t) -> number of renames``."""
    left, right = dict(gone), dict(new)
    edges = []
    for b in gone:
        for t in new:
            common, longest = similarity(texts[b], texts[t]) if b in texts and t in texts else (0, 0)
            if common and 100 * common >= least * longest:
                edges.append((-common / longest, b, t))
    out = {}
    for _, b, t in sorted(edges):
        n = min(left[b], right[t])
        if n:
            out[b, t] = n
            left[b] -= n
            right[t] -= n
    return out


def test_similar_renames_against_brute_force(spark):
    rng = random.Random(5)
    licence = [f"licence line {i} of all files" for i in range(4)]
    texts, rows, want = {}, [], {}
    for number, project in enumerate(["p", "q", None]):
        gone, new = {}, {}
        for at in range(24):
            # few different lines, so that many contents are similar to several others
            lines = [f"line {rng.randrange(14)} {'x' * rng.randrange(3)}" for _ in range(rng.randint(1, 9))]
            lines = licence[: rng.randint(0, 4)] + lines + [" "] * rng.randint(0, 2)
            name = f"{number}b{at}"
            texts[name] = "\n".join(lines)
            gone[name] = rng.randint(1, 3)
            changed = [rng.choice(licence) if rng.random() < 0.3 else line for line in lines] + ["y"] * rng.randint(0, 2)
            texts[f"{number}t{at}"] = "\n".join(changed)
            new[f"{number}t{at}"] = rng.randint(1, 3)
        texts[f"{number}empty"] = ""
        texts[f"{number}blank"] = " \n "
        gone |= {f"{number}empty": 1, f"{number}missing": 1}
        new |= {f"{number}blank": 1, f"{number}away": 2}
        for side, letter in ((gone, "D"), (new, "A")):
            for name, n in side.items():
                for i in range(n):
                    path = f"{letter}/{name}/{i}"
                    rows.append((project, path, path, letter, name if letter == "D" else ZERO, name if letter == "A" else ZERO))
        rows.append((project, "m", "m", "M", "h1", "h2"))
        for pair, n in brute(gone, new, texts, 50).items():
            want[project, *pair] = n
    blobs = spark.createDataFrame([(h, bytearray(t.encode())) for h, t in texts.items()], "hash string, content binary")
    diff = diff_of(spark, rows)
    found = renames.with_similar_renames(diff, blobs)
    assert found.columns == diff.columns
    out = found.collect()
    got = {}
    for r in out:
        if r.diff_change_type == "R":
            key = (r.project, r.base_file_hash, r.target_file_hash)
            got[key] = got.get(key, 0) + 1
    assert got == want and len(want) > 30
    # every deleted and every added file is in one row
    for letter, column in (("D", "base_path"), ("A", "target_path")):
        before = sorted((str(r[0]), r[1]) for r in rows if r[3] == letter)
        after = sorted((str(r.project), r[column]) for r in out if r.diff_change_type in (letter, "R"))
        assert before == after
    assert sum(r.diff_change_type == "M" for r in out) == 3


def test_similar_renames_of_nothing(spark):
    blobs = spark.createDataFrame([], "hash string, content binary")
    diff = diff_of(spark, [("p", "m", "m", "M", "h1", "h2"), ("p", "d", "d", "D", "h3", ZERO)])
    found = renames.with_similar_renames(diff, blobs)
    assert sorted(r.diff_change_type for r in found.collect()) == ["D", "M"]
    assert renames.with_similar_renames(diff.limit(0), blobs).count() == 0


def test_exact_renames_with_null_columns(spark):
    diff = diff_of(spark, [(None, "d", "d", "D", "h", ZERO), (None, "a", "a", "A", ZERO, "h")])
    row = trees.with_renames(diff).collect()
    assert [(r.project, r.diff_change_type, r.base_path, r.target_path) for r in row] == [(None, "R", "d", "a")]


def test_copies(spark):
    entries = [("b", "x/2.py", "h"), ("b", "x/1.java", "h"), ("b", "y", "g"), ("other", "a", "k")]
    entries = spark.createDataFrame(entries, "commit_hash string, path string, hash string")
    rows = [(None, "n1", "n1", "A", ZERO, "h"), ("p", "n2", "n2", "A", ZERO, "h"), ("p", "n3", "n3", "A", ZERO, "k"), ("p", "y", "y", "D", "g", ZERO)]
    diff = diff_of(spark, rows)
    found = renames.with_copies(diff, entries)
    assert found.columns == diff.columns
    got = sorted((r.target_path, r.diff_change_type, r.base_path, r.base_file_hash, r.base_tech_stack) for r in found.collect())
    assert got == [
        ("n1", "C", "x/1.java", "h", "Java"),
        ("n2", "C", "x/1.java", "h", "Java"),
        ("n3", "A", "n3", ZERO, "s"),
        ("y", "D", "y", "g", "s"),
    ]


def random_tree(rng, depth):
    """A nested dictionary of files (hashes) and folders, no folder empty."""
    out = {f"f{i}": f"h{rng.randrange(6)}" for i in range(rng.randint(1, 3))}
    if depth:
        out |= {f"{rng.choice('fd')}{i}": random_tree(rng, depth - 1) for i in range(rng.randint(1, 3))}
    return out


def changed_tree(rng, tree):
    out = {}
    for name, value in tree.items():
        draw = rng.random()
        if draw < 0.1:
            continue
        if draw < 0.2:
            out[name] = random_tree(rng, 1) if rng.random() < 0.5 else f"h{rng.randrange(6)}"
        else:
            out[name] = changed_tree(rng, value) if isinstance(value, dict) and draw < 0.6 else value
    return out or {"only": "h0"}


def stored(tree, objects):
    """The hash of a tree, whose objects are put into the set."""
    entries = sorted((n, "tree" if isinstance(v, dict) else "blob", stored(v, objects) if isinstance(v, dict) else v) for n, v in tree.items())
    name = f"t{abs(hash(tuple(entries)))}"
    objects |= {(name, *e) for e in entries}
    return name


def flat(tree, prefix=""):
    for name, value in tree.items():
        if isinstance(value, dict):
            yield from flat(value, f"{prefix}{name}/")
        else:
            yield prefix + name, value


def test_nested_diff_equals_flat_diff(spark):
    rng = random.Random(11)
    objects, pairs, entries = set(), [], []
    for number in range(12):
        base = random_tree(rng, 3)
        target = changed_tree(rng, base) if number else base
        pairs.append((f"p{number}" if number % 3 else None, f"b{number}", f"t{number}", stored(base, objects), stored(target, objects)))
        for commit, tree in ((f"b{number}", base), (f"t{number}", target)):
            entries += [(commit, path, h) for path, h in flat(tree)]
    pairs.append(("root", "none", "t3", None, pairs[3][4]))
    objects |= {(pairs[1][3], "sub", "commit", "h1"), (pairs[1][4], "sub", "commit", "h2")}
    objects = spark.createDataFrame(sorted(objects), "tree_hash string, name string, type string, child_hash string")
    roots = "project string, base_commit_hash string, target_commit_hash string, base_tree_hash string, target_tree_hash string"
    pairs = spark.createDataFrame(pairs, roots)
    flat_diff = trees.tree_diff(
        spark.createDataFrame(entries, "commit_hash string, path string, hash string"), pairs.drop("base_tree_hash", "target_tree_hash")
    )
    nested = trees.nested_tree_diff(objects, pairs)
    assert nested.columns == flat_diff.columns
    assert sorted(map(str, nested.collect())) == sorted(map(str, flat_diff.collect()))
    assert nested.count() > 50


def test_nested_diff_reads_no_equal_subtree(spark):
    """Equal folders are not even stored, and a level has rows for the changed ones only."""
    rows = [(side, f"d{i}", "tree", "changed-" + side if i == 7 else f"same{i}") for side in ("base", "target") for i in range(500)]
    rows += [("changed-base", "x", "blob", "1"), ("changed-target", "x", "blob", "2"), ("changed-target", "y", "blob", "1")]
    objects = spark.createDataFrame(rows, "tree_hash string, name string, type string, child_hash string")
    pairs = spark.createDataFrame([("b", "t", "base", "target")], "base_commit_hash string, target_commit_hash string, base_tree_hash string, target_tree_hash string")
    got = trees.nested_tree_diff(objects, pairs).select("target_path", "diff_change_type").collect()
    assert sorted(map(tuple, got)) == [("d7/x", "M"), ("d7/y", "A")]
    modes = objects.withColumn("mode", F.when(F.col("name") == "d9", F.col("tree_hash")).otherwise(F.lit("1")))
    assert trees.nested_tree_diff(modes, pairs).count() == 2
    same = pairs.withColumn("target_tree_hash", F.col("base_tree_hash"))
    assert trees.nested_tree_diff(objects, same).count() == 0

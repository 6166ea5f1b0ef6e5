"""Operators against brute force on small inputs, and with the hot-key paths switched on."""

import difflib
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from treeledger import schemas
from treeledger.operators import analysis, analyzers, lineage, lines, skew, trees
from treeledger.operators.analyzers import Analyzer, AnalyzerRule, bind_analyzers


@pytest.fixture
def hot(monkeypatch):
    """Every key with at least four rows is hot, so all salting takes place."""
    monkeypatch.setattr(skew, "HOT_FLOOR", 4)
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 2)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 1)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


# -- skew ----------------------------------------------------------------------------------------------------------


def skewed(spark, n, seed):
    rng = random.Random(seed)
    keys = [rng.choice(["hot", "hot", "warm", None, f"k{rng.randint(0, 20)}"]) for _ in range(n)]
    return [(k, i) for i, k in enumerate(keys)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join(spark, hot, how):
    left = spark.createDataFrame(skewed(spark, 300, 1), "k string, a int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("k4", 4), (None, 5)], "k string, b int")
    assert {"hot", "warm", None} < {r.k for r in skew.hot_keys(left, ["k"]).collect()}
    assert rows(skew.spread_join(left, right, ["k"], ["a"], how)) == rows(left.join(right, ["k"], how))


def test_spread_join_both_sides(spark, hot):
    left = spark.createDataFrame(skewed(spark, 200, 2), "k string, a int")
    right = spark.createDataFrame(skewed(spark, 100, 3), "k string, b int")
    got = skew.spread_join(left, right, ["k"], ["a"], spread_right=["b"])
    assert rows(got) == rows(left.join(right, ["k"]))
    with pytest.raises(ValueError):
        skew.spread_join(left, right, ["k"], ["a"], "left", spread_right=["b"])


def test_only_null_keys_are_hot(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_FLOOR", 50)
    left = spark.createDataFrame([(None, i) for i in range(60)] + [("a", 1)], "k string, a int")
    right = spark.createDataFrame([("a", 1), (None, 2)], "k string, b int")
    joined = skew.spread_join(left, right, ["k"], ["a"], "left")
    assert rows(joined) == rows(left.join(right, ["k"], "left"))
    assert "_left_salt" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_every_hot_key_is_spread_by_its_size(spark, monkeypatch):
    df = spark.createDataFrame([(i % 300, i) for i in range(3000)] + [(0, -i) for i in range(90)], "k int, a int")
    monkeypatch.setattr(skew, "HOT_FLOOR", 11)
    assert [tuple(r) for r in skew.hot_keys(df, ["k"]).collect()] == [(0, 1)]
    monkeypatch.setattr(skew, "HOT_FLOOR", 10)
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 5)
    parts = {r.k: r["_parts"] for r in skew.hot_keys(df, ["k"]).collect()}
    assert parts == {k: 20 if k == 0 else 2 for k in range(300)}
    right = spark.createDataFrame([(k, str(k)) for k in range(0, 400, 3)], "k int, b string")
    for rows_sent in (10**6, 10):
        monkeypatch.setattr(skew, "BROADCAST_ROWS", rows_sent)
        assert rows(skew.spread_join(df, right, ["k"], ["a"], "left")) == rows(df.join(right, ["k"], "left"))
    assert skew.largest_group(df, ["k"]) == 100


# -- trees ---------------------------------------------------------------------------------------------------------


def entries(spark, trees_):
    data = [(c, p, m, h) for c, files in trees_.items() for p, (h, m) in files.items()]
    return spark.createDataFrame(data, schemas.TREE_ENTRIES)


def random_trees(seed, commits=6):
    rng = random.Random(seed)
    return {
        f"c{i}": {
            f"src/f{j}.java": (rng.choice("abc") * 40, rng.choice(["100644", "100644", "100755"]))
            for j in range(12)
            if rng.random() < 0.7
        }
        for i in range(commits)
    }


def plain_diff(base, target):
    out = set()
    for path in base.keys() | target.keys():
        if base.get(path) != target.get(path):
            letter = "A" if path not in base else "D" if path not in target else "M"
            zero = ("0" * 40, "")
            out.add((path, letter, base.get(path, zero)[0], target.get(path, zero)[0]))
    return sorted(out)


COLUMNS = ["target_path", "diff_change_type", "base_file_hash", "target_file_hash"]


def test_diff_of_one_pair(spark):
    all_trees = random_trees(1)
    df = entries(spark, all_trees)
    diff = trees.tree_diff(df, ("c0", "c1"))
    assert rows(diff, *COLUMNS) == plain_diff(all_trees["c0"], all_trees["c1"])
    assert diff.columns == schemas.DIFF_RESULTS.names
    assert trees.tree_diff(df, ("c0", "c0")).count() == 0
    back = {(r[0], {"A": "D", "D": "A"}.get(r[1], r[1]), r[3], r[2]) for r in rows(trees.tree_diff(df, ("c1", "c0")), *COLUMNS)}
    assert sorted(back) == plain_diff(all_trees["c0"], all_trees["c1"])
    # an empty side
    assert all(r.diff_change_type == "A" for r in trees.tree_diff(df, ("none", "c1")).collect())


@pytest.mark.parametrize("many", [False, True])
def test_diff_of_many_pairs(spark, request, many):
    if many:
        request.getfixturevalue("hot")
    all_trees = random_trees(2)
    pairs = [("c0", f"c{i}") for i in range(6)] + [("c4", "c2"), ("c5", "c1")]
    table = spark.createDataFrame([(b, t, f"run{i}") for i, (b, t) in enumerate(pairs)], "base_commit_hash string, target_commit_hash string, run string")
    got = defaultdict(list)
    for r in trees.tree_diff(entries(spark, all_trees), table).select("run", *COLUMNS).collect():
        got[r.run].append(tuple(r)[1:])
    for i, (b, t) in enumerate(pairs):
        assert sorted(got[f"run{i}"]) == plain_diff(all_trees[b], all_trees[t])


def test_snapshot_by_list_and_by_table(spark, hot):
    df = entries(spark, random_trees(3))
    table = spark.createDataFrame([("c1",), ("c3",), ("c1",)], "commit_hash string")
    by_table = trees.snapshot_files(df, table, exclude=["src/f1"])
    assert rows(by_table) == rows(trees.snapshot_files(df, ["c1", "c3"], exclude=["src/f1"]))
    assert {r.tech_stack for r in by_table.collect()} == {"Java"}


@pytest.mark.parametrize("salted", [False, True])
def test_flatten_tree(spark, request, salted):
    if salted:
        request.getfixturevalue("hot")
    objects = [
        ("root1", "lib", "tree", "lib"),
        ("root1", "a.txt", "blob", "h1"),
        ("root1", "module", "commit", "zzz"),
        ("root2", "copy", "tree", "lib"),
        ("root2", "other", "tree", "lib"),
        ("lib", "deep", "tree", "deep"),
        ("lib", "b.txt", "blob", "h2"),
        ("deep", "c.txt", "blob", "h3"),
        ("empty", "none", "commit", "y"),
    ]
    df = spark.createDataFrame(objects, schemas.TREE_OBJECTS)
    roots = spark.createDataFrame([("c1", "root1"), ("c2", "root2"), ("c3", "root2"), ("c4", "empty"), ("c5", "gone")], "commit_hash string, tree_hash string")
    got = rows(trees.flatten_tree(df, roots))
    one = [("a.txt", "h1"), ("lib/b.txt", "h2"), ("lib/deep/c.txt", "h3")]
    two = [(f"{d}/{p}", h) for d in ("copy", "other") for p, h in (("b.txt", "h2"), ("deep/c.txt", "h3"))]
    assert got == sorted([("c1", *x) for x in one] + [(c, *x) for c in ("c2", "c3") for x in two])


# -- history of commits --------------------------------------------------------------------------------------------


def random_history(seed, n):
    rng = random.Random(seed)
    parents = {}
    for i in range(1, n):
        count = rng.choice([0, 1, 1, 1, 2, 3])
        parents[f"n{i}"] = [f"n{max(0, i - rng.randint(1, 9))}" for _ in range(count)]
    return parents


def ancestors(parents, tip):
    seen, work = {tip}, [tip]
    while work:
        for p in parents.get(work.pop(), []):
            if p not in seen:
                seen.add(p)
                work.append(p)
    return seen


def edges(spark, parents):
    data = [(c, p, i) for c, ps in parents.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(data, schemas.COMMIT_PARENTS)


@pytest.mark.parametrize("seed", [1, 2])
def test_reachable(spark, hot, seed):
    parents = random_history(seed, 60)
    tips = ["n59", "n40", "n7", "n0", "elsewhere"]
    got = defaultdict(set)
    found = lineage.reachable(edges(spark, parents), spark.createDataFrame([(t,) for t in tips], "hash string"))
    for r in found.collect():
        assert r.hash not in got[r.tip]
        got[r.tip].add(r.hash)
    assert got == {t: ancestors(parents, t) for t in tips}


def test_long_history_and_membership(spark):
    parents = {f"n{i}": [f"n{i - 1}"] for i in range(1, 700)}
    parents["side2"], parents["side1"] = ["side1"], ["n10"]
    parents["n650"] = ["n649", "side2"]
    df = edges(spark, parents)
    index = lineage.index_history(df)
    assert len(index.jumps) == 5
    tips = spark.createDataFrame([("n699",)], "hash string")
    assert lineage.reachable(df, tips, index).count() == 702
    assert lineage.commit_in_branch(df, "n699", "side1")
    assert not lineage.commit_in_branch(df, "n649", "side1")
    assert lineage.commit_in_branch(df, "n5", "n5")


def test_resolve(spark):
    commits = spark.createDataFrame([("abcd1111",), ("abcd2222",), ("ef012345",), ("main",)], "hash string")
    refs = spark.createDataFrame([("r", "main", "ef012345", True), ("r", "dev", "abcd1111", False), ("s", "two", "x", False), ("t", "two", "y", False)], schemas.REFS)
    specs = spark.createDataFrame([(s,) for s in ("main", "dev", "abcd1", "abcd", "ef01", "zz", "ef0", "two", "ef012345")], "spec string")
    got = {r.spec: (r.hash, r.status) for r in lineage.resolve_refs(refs, commits, specs).collect()}
    assert got == {
        "main": ("ef012345", "ok"),
        "dev": ("abcd1111", "ok"),
        "abcd1": ("abcd1111", "ok"),
        "abcd": (None, "ambiguous"),
        "ef01": ("ef012345", "ok"),
        "zz": (None, "unknown"),
        "ef0": (None, "unknown"),
        "two": (None, "ambiguous"),
        "ef012345": ("ef012345", "ok"),
    }
    assert lineage.resolve_ref(refs, commits) == "ef012345"
    for spec in ("abcd", "nothing"):
        with pytest.raises(ValueError):
            lineage.resolve_ref(refs, commits, spec)
    with pytest.raises(ValueError):
        lineage.branch_tip(refs, "gone")


# -- analyzers -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rule", analyzers.DEFAULT_ANALYZERS, ids=lambda r: r.name)
@pytest.mark.parametrize("engine", ["auto", "python"])
def test_analyzer_cases(spark, rule, engine):
    params = {**rule.params, "engine": engine} if rule.params else {}
    analyzer = analyzers.get_analyzer(rule.analyzer, params)
    assert analyzer.get_description()
    for case in analyzer.get_test_cases():
        df = spark.createDataFrame([(case["content"],)], "t string")
        count, detail = analyzer.columns(F.col("t"))
        row = df.select(count.alias("n"), detail.alias("d")).first()
        assert row.n == case["expected_count"]
        want = case["expected_result"]
        assert json.dumps(json.loads(row.d or "null"), sort_keys=True) == json.dumps(want, sort_keys=True)


def test_xml_counts(spark):
    analyzer = analyzers.XMLElementCountAnalyzer()
    texts = ["<a/>", "<a><b/><!-- c --><?p?><b x='1'>t</b></a>", "<a>", "", "<a>&nope;</a>", "<?xml version='1.0' encoding='latin-1'?><a>é</a>", "<x:a/>"]
    assert [analyzer.analyze(t)[0] for t in texts] == [1, 3, 0, 0, 0, 1, 0]


def test_regex_engines_agree(spark):
    texts = ["class A {", "no", "class B extends C implements D, E {\nclass F {", "a1.2 b33:4", "é\t😀"]
    patterns = [analyzers.JAVA_CLASS_PATTERN, r"([0-9]+)[.:]([0-9]+)", r"\w", r"\w", "\t"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    found = []
    for engine in ("auto", "python"):
        analyzer = analyzers.RegexMatchCountAnalyzer({"patterns": patterns, "engine": engine})
        count, detail = analyzer.columns(F.col("t"))
        found.append([(r.n, json.loads(r.d or "null")) for r in df.select(count.alias("n"), detail.alias("d")).collect()])
    assert found[0] == found[1]
    plain = analyzers.RegexMatchCountAnalyzer({"patterns": patterns})
    assert [n for n, _ in found[0]] == [*[plain.analyze(t)[0] for t in texts], None]
    with pytest.raises(ValueError):
        analyzers.RegexMatchCountAnalyzer({"patterns": "a"})


def test_regex_groups_come_from_one_search(spark):
    texts = ["a1.2 b33:4 12.", "xyy y xbcbc", "ab ab abcd", "class class_ xclass 1class class", "é\u00e9class é class", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    apart = [r"([0-9]+)[.:]([0-9]+)", r"(x)?(y)", r"(ab?)(c|bcd)?", r"(a|ab)(c|bcd)", r"(\w+) (\1)", r"(b+?)(c{1,2})"]
    around = [r"\bclass(_?)", r"\bclass\b", r"\bc?l", r"(?<=a)(b)(c)?", r"(a)(b)$", r"\b(c)(l)", r"\bx{0,1}c", r"(c++)(l)"]
    for pattern in apart + around:
        analyzer = analyzers.RegexMatchCountAnalyzer({"patterns": [pattern]})
        count, detail = analyzer.columns(F.col("t"))
        found = df.select(count.alias("n"), detail.alias("d"))
        plain = [(None, None) if t is None else analyzer.analyze(t) for t in texts]
        told = [(r.n, json.loads(r.d or "null")) for r in found.collect()]
        assert told == [(n, json.loads(json.dumps(d))) for n, d in plain], pattern
        searches = df.select(detail.alias("d"))._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(")
        assert searches == (1 if pattern in apart else analyzers.jvm_pattern(pattern).groups or 1 if analyzers.jvm_pattern(pattern) else 0), pattern


class WordCount(Analyzer):
    """Number of words."""

    def analyze(self, text):
        return len(text.split()), {"first": text.split()[:1]}


def test_registry_and_user_analyzers(spark):
    analyzers.register_analyzer("WordCount", WordCount)
    rules = [AnalyzerRule("Words", "WordCount", ("All",)), AnalyzerRule("Ghost", "Missing", ("All",))]
    bound, unknown = bind_analyzers(rules)
    assert unknown == ["Ghost"] and [b.rule.name for b in bound] == ["Words"]
    files = spark.createDataFrame([("c", "a.java", "Java", "h")], schemas.COMMIT_FILES)
    blobs = spark.createDataFrame([("h", b"one two")], schemas.BLOBS)
    row = analysis.analyze(files, blobs, bound).first()
    assert (row.analyzer_type, row["count"], json.loads(row.content)) == ("Words", 2, {"first": ["one"]})
    module_rules = [AnalyzerRule("D", "Decoder", ("All",))]
    found, missing = bind_analyzers(module_rules, user_module="user_analyzers_for_tests")
    assert not missing and type(found[0].analyzer).__name__ == "Decoder"
    parsed = analyzers.parse_analyzer_rules([{"name": "N", "class": "C", "tech_stacks": ["All"]}])
    assert parsed == (AnalyzerRule("N", "C", ("All",)),)
    assert WordCount().validate_result(1, {}) and WordCount().validate_result(1, None) and not WordCount().validate_result("1", {})


FILES = [
    ("c1", "a.java", "Java", "java"),
    ("c1", "b.java", "Java", "java"),
    ("c2", "a.java", "Java", "java"),
    ("c2", "x.xml", "XML", "xml"),
    ("c2", "copy.java", "Java", "xml"),
    ("c2", "e.sh", "Script", "empty"),
    ("c2", "bin.sh", "Script", "bin"),
    ("c2", "gone.sh", "Script", "gone"),
    ("c2", "zero.sh", "Script", "0" * 40),
    ("c2", "literal.sh", "Script", "literal"),
    ("c2", "none", None, "java"),
]
BLOBS = [
    ("java", b"class A {\n}"),
    ("xml", b"<a><b/></a>"),
    ("empty", b""),
    ("bin", b"\0a"),
    ("literal", b"<binary>"),
    ("0" * 40, b"never"),
    ("unused", b"x"),
]


def plain_analysis():
    want = []
    for commit, path, stack, key in FILES:
        if stack is None:
            continue
        text = {"java": "class A {\n}", "xml": "<a><b/></a>"}.get(key)
        want.append((commit, path, "FileLineCount", text.count("\n") + 1 if text else 0))
        want.append((commit, path, "FileCharCount", len(text or "")))
        if stack == "XML":
            want.append((commit, path, "XMLElementCount", 2))
        if stack == "Java":
            want.append((commit, path, "JavaClassCount", 1 if key == "java" else 0))
    return sorted(want, key=str)


@pytest.mark.parametrize("limit", [0, 1000])
@pytest.mark.parametrize("floor", [2, 1000])
def test_analyze(spark, monkeypatch, limit, floor):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(skew, "HOT_FLOOR", floor)
    files = spark.createDataFrame(FILES, schemas.COMMIT_FILES)
    blobs = spark.createDataFrame(BLOBS, schemas.BLOBS)
    got = analysis.analyze(files, blobs, bind_analyzers()[0])
    assert got.columns == schemas.ANALYSIS_RESULTS.names
    assert rows(got, "commit_hash", "path", "analyzer_type", "count") == plain_analysis()
    empty = got.where("path IN ('e.sh', 'bin.sh', 'gone.sh', 'zero.sh', 'literal.sh')").collect()
    assert all(r["count"] == 0 and r.content is None for r in empty)
    expanded = analysis.expand_analyzers(files, bind_analyzers()[0])
    assert rows(expanded, "commit_hash", "path", "analyzer_type") == [r[:3] for r in plain_analysis()]
    assert rows(analysis.unclassified_files(files)) == [("c2", "none")]
    assert analysis.analyze(files, blobs, []).count() == 0


def test_content_is_analyzed_once_per_blob_without_shuffling_it(spark):
    files = spark.createDataFrame(FILES, schemas.COMMIT_FILES)
    blobs = spark.createDataFrame(BLOBS, schemas.BLOBS)
    plan = analysis.analyze(files, blobs, bind_analyzers()[0])._jdf.queryExecution().executedPlan().toString()
    below_exchange = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "BroadcastHashJoin" in plan and not any("content" in line and "binary" in line for line in below_exchange)


def test_file_texts_and_snapshots(spark, hot):
    files = spark.createDataFrame(FILES, schemas.COMMIT_FILES)
    blobs = spark.createDataFrame(BLOBS, schemas.BLOBS)
    texts = {(r.commit_hash, r.path): r.text for r in analysis.file_texts(files, blobs).collect()}
    assert len(texts) == len(FILES)
    assert texts["c1", "a.java"] == "class A {\n}" and texts["c2", "gone.sh"] == "<invalid>"
    assert texts["c2", "bin.sh"] == "<binary>" and texts["c2", "zero.sh"] == "<invalid>"
    kept = {r.commit_file_hash: r.content_snapshot for r in analysis.file_snapshots(files, blobs).collect()}
    assert set(kept) == {f[3] for f in FILES} and kept["gone"] == "<invalid>"


# -- line changes --------------------------------------------------------------------------------------------------

TEXTS = {
    "a": "one\ntwo\n\n three \nfour\none",
    "b": "one\nt w o\nthree\nfive\n  \nfour\nsix　",
    "c": "\n \n",
    "d": "four\none\none",
    "e": "a    b\nx　y",
    "f": "ab\nab\na  b\nxy",
}
ASCII_SPACE = dict.fromkeys(b" \t\r\x0b\x0c")


def counted(text):
    return [(x.translate(ASCII_SPACE), len(x.strip())) for x in text.split("\n") if x.strip()]


def diff_table(spark, pairs):
    data = [("b", "t", f"p{i}", f"p{i}", "M", None, None, x, y, None, None) for i, (x, y) in enumerate(pairs)]
    return spark.createDataFrame(data, schemas.DIFF_RESULTS)


PAIRS = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "d"), ("0" * 40, "a"), ("d", "0" * 40), ("a", "a"), ("e", "f"), ("f", "e")]


def test_line_changes_as_multisets(spark, hot):
    blobs = spark.createDataFrame([(k, v.encode()) for k, v in TEXTS.items()], schemas.BLOBS)
    got = {r.file_path: tuple(r)[3:] for r in lines.line_changes(diff_table(spark, PAIRS), blobs).collect()}
    for i, (x, y) in enumerate(PAIRS):
        base, target = (Counter(k for k, _ in counted(TEXTS.get(s, ""))) for s in (x, y))
        added, deleted = target - base, base - target

        def chars(side, changed):
            own = defaultdict(list)
            for key, n in sorted(counted(TEXTS.get(side, ""))):
                own[key].append(n)
            return sum(sum(own[key][:n]) for key, n in changed.items())

        want = (added.total(), deleted.total(), chars(y, added), chars(x, deleted))
        assert got[f"p{i}"] == want
    swapped = {r.file_path: tuple(r)[3:] for r in lines.line_changes(diff_table(spark, PAIRS), blobs, reverse=True).collect()}
    assert swapped == {p: (d, a, dc, ac) for p, (a, d, ac, dc) in got.items()}


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b):
            previous, row[j + 1] = row[j + 1], previous + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_ordered_line_changes(spark):
    blobs = spark.createDataFrame([(k, v.encode()) for k, v in TEXTS.items()], schemas.BLOBS)
    got = {r.file_path: tuple(r)[3:] for r in lines.line_changes_ordered(diff_table(spark, PAIRS), blobs).collect()}
    for i, (x, y) in enumerate(PAIRS):
        base, target = ([k for k, _ in counted(TEXTS.get(s, ""))] for s in (x, y))
        common = common_length(base, target)
        assert got[f"p{i}"][:2] == (len(target) - common, len(base) - common)


def test_unmatched_is_a_shortest_edit():
    rng = random.Random(9)
    for _ in range(300):
        a, b = (rng.choices("abcdef", k=rng.randint(0, 14)) for _ in range(2))
        deleted, added = lines._unmatched(a, b)
        kept_a = [x for i, x in enumerate(a) if i not in deleted]
        kept_b = [x for i, x in enumerate(b) if i not in added]
        assert kept_a == kept_b and len(kept_a) == common_length(a, b)
        assert len(kept_a) >= sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def random_history(seed, size=140):
    """Parents of commits 0 to size, some with none, most with one, some with two or three; first parents in order."""
    import random

    rng = random.Random(seed)
    parents = {}
    for k in range(1, size):
        count = rng.choice([0, 1, 1, 1, 1, 2, 2, 3]) if k > 1 else 1
        near = [max(0, k - rng.randint(1, 1 + rng.choice([2, 2, 30]))) for _ in range(count)]
        parents[f"n{k}"] = list(dict.fromkeys(f"n{p}" for p in near))
    return parents


@pytest.mark.parametrize("seed", [1, 2])
def test_ancestors_and_merge_bases(spark, seed):
    parents = random_history(seed)
    rows = [(child, p, k) for child, ps in parents.items() for k, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "child string, parent string, ordinal int")
    index = lineage.index_history(df)

    def closure(commit):
        found, work = set(), [commit]
        while work:
            c = work.pop()
            if c not in found:
                found.add(c)
                work += parents.get(c, [])
        return found

    linked = {r[0] for r in rows} | {r[1] for r in rows}
    commits = sorted(linked)[::7]
    pairs = [(a, b) for a in commits for b in commits]
    expected = set()
    for a, b in pairs:
        common = closure(a) & closure(b)
        expected |= {(a, b, c) for c in common if not any(c in parents.get(d, []) for d in common)}
    pairs += [("gone", "gone"), ("gone", commits[0])]
    found = lineage.merge_bases(df, spark.createDataFrame(pairs, "a string, b string"), index).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == expected | {("gone", "gone", "gone")}

    specs = [(c, n) for c in linked for n in (0, 1, 2, 3, 7, 50, 10**6)] + [("n9", -1), ("n9", None), ("gone", 0), ("gone", 1)]
    found = lineage.ancestors(df, spark.createDataFrame(specs, "hash string, steps int"), index).collect()
    assert len(found) == len(specs)
    for r in found:
        at = r.hash if r.steps is not None and r.steps >= 0 else None
        for _ in range(min(r.steps or 0, 1000)):
            at = parents.get(at, [None])[0] if parents.get(at) else None
        assert r.ancestor == at, r


def test_a_comb_of_merges_takes_few_rounds(spark):
    """A main line of 600 commits that forks and merges at every other one: chains follow the line, not the forks."""
    rows = []
    for k in range(1, 600):
        rows.append((f"m{k}", f"m{k - 1}", 0))
        if k % 2 == 0:
            rows += [(f"s{k}", f"m{k - 2}", 0), (f"m{k}", f"s{k}", 1)]
    index = lineage.index_history(spark.createDataFrame(rows, "child string, parent string, ordinal int"))
    chains = {r.hash: (r.chain, r.position) for r in index.nodes.collect()}
    assert len({chains[f"m{k}"][0] for k in range(600)}) == 1
    assert [chains[f"m{k}"][1] for k in range(600)] == list(range(-599, 1))


def test_unfitting_statistic_is_left_out(spark):
    from treeledger.operators import stats
    from treeledger.plans import jobs

    class Wants(stats.Statistic):
        name = "wants"
        needs = ("commits",)

        def single(self, tables):
            return tables.commits.select("no_such_column")

    runs = spark.createDataFrame([("r", "20240101-120000", "snapshot", "")], "repo string, run string, run_type string, ended_at string")
    commits = spark.createDataFrame([("r", "20240101-120000", "c", "ann")], "repo string, run string, hash string, author_name string")
    from treeledger.operators import history

    tables = stats.RunTables(history.with_labels(runs), commits=commits, commit_files=None, diff_results=None, analysis_results=None)
    stats.register_statistic(Wants())
    try:
        with pytest.warns(UserWarning, match="wants"):
            assert "wants" not in jobs.statistics_job(tables)
    finally:
        stats.unregister_statistic("wants")
    assert "wants" not in stats.registered_statistics()


def test_renames(spark):
    """Each file is in one rename at most; pairs of commits do not mix, and further columns stay."""
    rows = [("p1", "a", "b", "x/1", "h", "D"), ("p1", "a", "b", "y/1", "h", "A"), ("p1", "a", "b", "y/2", "h", "A")]
    rows += [("p2", "a", "c", "x/1", "h", "D"), ("p2", "a", "c", "z", "g", "A"), ("p2", "a", "c", "m", "k", "M")]
    diff = spark.createDataFrame(rows, "project string, base_commit_hash string, target_commit_hash string, path string, hash string, t string")
    zero = "0" * 40
    diff = diff.selectExpr(
        "project", "base_commit_hash", "target_commit_hash", "path AS base_path", "path AS target_path", "t AS diff_change_type",
        "'s' AS base_tech_stack", "'s' AS target_tech_stack", f"IF(t = 'A', '{zero}', hash) AS base_file_hash",
        f"IF(t = 'D', '{zero}', hash) AS target_file_hash", "CAST(NULL AS INT) AS hunk_char_count", "CAST(NULL AS INT) AS hunk_line_count",
    )
    found = trees.with_renames(diff)
    assert found.columns == diff.columns
    out = sorted((r.project, r.diff_change_type, r.base_path, r.target_path) for r in found.collect())
    kinds = [(p, t) for p, t, _, _ in out]
    assert kinds == [("p1", "A"), ("p1", "R"), ("p2", "A"), ("p2", "D"), ("p2", "M")]
    renamed = [x for x in out if x[1] == "R"][0]
    added = [x for x in out if x[:2] == ("p1", "A")][0]
    assert renamed[2] == "x/1" and {renamed[3], added[3]} == {"y/1", "y/2"}

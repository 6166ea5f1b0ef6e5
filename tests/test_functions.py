"""Truth tables and random checks of the column expressions against plain Python."""

import hashlib
import random
import re
from datetime import datetime, timezone
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from treeledger.functions import content, paths, times
from treeledger.functions.paths import StackRule
from treeledger.functions.regex import jvm_pattern


def apply(spark, values, function, type_="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {type_}")
    return [r.out for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_file_extension(spark):
    cases = {
        ".github/x.yml": "<dev-config>",
        "Makefile": "<no-extension>",
        "a.tar.gz": "gz",
        "a.b/Makefile": "b/Makefile",
        "x.": "<no-extension>",
        "": "<no-extension>",
    }
    assert apply(spark, cases, paths.file_extension) == list(cases.values())


def test_extract_stack(spark):
    cases = {
        "tests/x.py": "PyTest",
        "core.py": None,
        "github_tool/core.py": "Python",
        "gitx.py": "Python",
        "src/x.py": None,
        "a.XML": None,
        "a.xml": "XML",
        ".a.xml": None,
        "notebooks/a.ipynb": "Jupyter",
        "notebooks/a.py": "Python",
        "a.java/b": None,
        "run.bat": "Script",
    }
    assert apply(spark, cases, paths.extract_stack) == list(cases.values())


def test_extract_stack_rules_with_one_list_or_none(spark):
    rules = [
        StackRule("none"),
        StackRule("bare", (), ("<no-extension>",)),
        StackRule("dev", (), ("<dev-config>",)),
        StackRule("dotted", (), ("tar.gz", "")),
        StackRule("lib", ("lib",)),
    ]
    cases = {"x.": "bare", "x": "bare", ".x": "dev", "a.tar.gz": None, "library/a.gz": "lib", "a/lib.c": None}
    assert apply(spark, cases, lambda c: paths.extract_stack(c, rules)) == list(cases.values())
    assert apply(spark, ["a"], lambda c: paths.extract_stack(c, [])) == [None]


def reference_report_stack(path, rules):
    """The report classifier written out in plain Python."""
    normalized = (path or "").strip().replace("\\", "/").strip("/").lower()
    if not normalized:
        return None
    name = PurePosixPath(normalized).name
    dot = name.rfind(".")
    extension = name[dot + 1 :] if 0 < dot < len(name) - 1 else ""
    for rule in paths.normalize_stack_rules(rules):
        if extension and extension in rule.extensions:
            return rule.name
        if any(normalized == p or normalized.startswith(p + "/") for p in rule.paths):
            return rule.name
    return None


def test_report_stack(spark):
    cases = {
        "tests/x.py": "Python",
        "a.XML": "XML",
        "configs/readme": None,
        "config/readme": "Python",
        ".gitignore": None,
        "a/.py": None,
        "": None,
        None: None,
        " \\config\\x\\ ": "Python",
        "a/b.py/.": "Python",
        "TESTS/readme": "PyTest",
        "　a.xml ": "XML",
    }
    assert apply(spark, cases, paths.report_stack) == list(cases.values())
    assert [reference_report_stack(p, paths.DEFAULT_STACKS) for p in cases] == list(cases.values())


def test_report_stack_random(spark):
    rng = random.Random(3)
    rules = [
        StackRule("A", ("/src/Main/", "x+y"), (".JAVA",)),
        StackRule(" ", ("all",), ("txt",)),
        StackRule("B", ("src",), ("py", "txt")),
        StackRule("C", ("lib", "src/main/deep"), ()),
    ]
    parts = ["src", "Main", "main", "lib", "x+y", "a.java", "b.py", ".txt", "c.TXT", "..", "deep", "d.", " ", "\\", "/"]
    values = ["/".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(400)]
    values = [v for v in values if "/.." not in v and not v.startswith("..")]
    got = apply(spark, values, lambda c: paths.report_stack(c, rules))
    assert got == [reference_report_stack(v, rules) for v in values]


def test_stack_labels_and_filter(spark):
    assert paths.stack_labels(paths.DEFAULT_STACKS)[0] == "全部"
    assert paths.stack_labels([]) == ["全部"]
    rows = spark.createDataFrame([("", "a.py"), ("b.xml", "a.py"), (None, "c")], "target_path string, source_path string")
    assert paths.filter_by_stack(rows, "Python").count() == 1
    assert paths.filter_by_stack(rows, "XML").count() == 1
    assert paths.filter_by_stack(rows, paths.UNCATEGORIZED_LABEL).count() == 1
    assert paths.filter_by_stack(rows, paths.ALL_LABEL).count() == 3
    # without rules nothing is uncategorised: the label is an ordinary stack name that no file has
    assert paths.filter_by_stack(rows, paths.UNCATEGORIZED_LABEL, []).count() == 0
    bare = spark.createDataFrame([(1,)], "x int")
    assert paths.filter_by_stack(bare, "Python").count() == 1


def test_path_filter(spark):
    values = ["database/x.py", "docker/x", "src/data/x", ".vscode", "a"]
    kept = apply(spark, values, lambda c: paths.path_kept(c, [], paths.DEFAULT_EXCLUDE))
    assert kept == [False, False, True, False, True]
    kept = apply(spark, values, lambda c: paths.path_kept(c, ["d", "a"], ["doc"]))
    assert kept == [True, False, False, False, True]


def test_normalized_path(spark):
    rows = spark.createDataFrame([("\\a\\b/", "x"), ("//", "/c"), (None, None)], "path string, file_path string")
    assert [r.path for r in paths.normalize_paths(rows).collect()] == ["a/b", "c", ""]
    assert paths.normalize_paths(spark.createDataFrame([(1,)], "x int")).first().path == ""


def test_delta_and_bins(spark):
    assert apply(spark, ["ADDED", "renamed", "8", "0", "99", None], paths.delta_status) == ["A", "R", "T", "=", "X", "X"]
    values = [0, 999, 1000, 49_999, 50_000, -1]
    labels = ["<1k", "<1k", "1k-2k", "10k-50k", ">=50k", ">=50k"]
    assert apply(spark, values, paths.size_bin, "bigint") == labels


def test_rule_parsing():
    entries = [{"name": " Py ", "paths": ["\\Src\\", " "], "extensions": [".PY"]}, {"name": ""}, {"name": "X", "paths": None}]
    assert paths.normalize_stack_rules(entries) == (StackRule("Py", ("src",), ("py",)), StackRule("X"))
    assert paths.parse_stack_rules(None) == ()
    assert paths.parse_stack_rules(entries)[0] == StackRule(" Py ", ("\\Src\\", " "), (".PY",))


def plain_text(data):
    return "<binary>" if b"\0" in data[:1024] else data.decode("utf-8", "ignore").replace("\0", "")


def test_decoding_like_python(spark):
    rng = random.Random(5)
    alphabet = [0x00, 0x41, 0x80, 0xA0, 0xBF, 0xC2, 0xDF, 0xE0, 0xE1, 0xED, 0xEF, 0xF0, 0xF4, 0xF5, 0xFF, 0xBD, 0x6E, 0x66]
    values = [bytes(rng.choices(alphabet, k=rng.randint(0, 9))) for _ in range(20_000)]
    values += [b"a" * 1024 + v for v in values[:500]] + [b"\xef\xbf\xbd\x80", "é€😀".encode()]
    got = apply(spark, values, lambda c: content.snapshot_text(F.lit("h"), c), "binary")
    assert got == [plain_text(v) for v in values]


def test_snapshot_text_of_missing_content(spark):
    rows = spark.createDataFrame([("0" * 40, b"a"), ("x", None), (None, b"a")], "h string, c binary")
    texts = rows.select(content.snapshot_text(F.col("h"), F.col("c")).alias("t")).collect()
    assert [r.t for r in texts] == ["<invalid>"] * 3


def test_counts_and_hash(spark):
    texts = ["", "a", "a\n", "\n\n", "这是一个测试文本。", "😀"]
    assert apply(spark, texts, content.char_count) == [len(t) for t in texts]
    assert apply(spark, texts, content.line_count) == [t.count("\n") + 1 for t in texts]
    blobs = [b"", b"hello", bytes(range(256))]
    ids = [hashlib.sha1(b"blob %d\0" % len(b) + b).hexdigest() for b in blobs]
    assert apply(spark, blobs, content.git_blob_hash, "binary") == ids
    assert ids[1] == "b6fc4c620b67d95f953a5c1c1230aaab5db5a1b0"


PATTERNS = [
    r"(?<!\w)\bclass\s+(\w+)\b(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w\s,]+))?\s*\{",
    r"\bclass\s+(\w+)",
    r"\w+",
    r"\W",
    r"\d+",
    r"[^\d\s]+",
    r"\s+",
    r"^a.*$",
    r"\B.",
    r"[\w.-]+@[\w-]+",
    r"[]x[&&]+",
    r"(?P<first>a)(?P<second>b)?",
    r"a{,2}b{1}",
    r"x{y}",
    r"(a|b)\1",
    r"end\Z",
    r"\Astart|.$",
    r"\x41é|\t",
    r"[a-z\]\-]+?\.",
    "é+",
    r"(?:a|b)c?|d",
    r"(?=a)a|(?<=b)b",
]
SAMPLES = [
    "class A extends B implements C, D {",
    "éclass X\n class Éa_1 {\r\n}",
    "aab b abab xy{ x{y} a.b-c@d-e ²³ ١٢ _",
    "start\nabc\n\nend",
    "a b\u0085c d\x1ce",
    "[]&x- end",
    "é ‿ µ Aé \t.",
    "",
    "abb baa aa bb\n",
    "😀a😀 class  Z",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_jvm_regex_like_python(spark, pattern):
    jvm = jvm_pattern(pattern)
    assert jvm is not None
    group = min(jvm.groups, 1)
    got = apply(spark, SAMPLES, lambda c: F.regexp_extract_all(c, F.lit(jvm.regex), F.lit(group)))
    want = []
    for sample in SAMPLES:
        found = [m.group(group) or "" for m in re.finditer(pattern, sample)]
        assert all(jvm.literal in m.group() for m in re.finditer(pattern, sample))
        want.append(found)
    assert got == want


def test_regex_left_to_python():
    for pattern in (r"(?i)a", r"(a|b)*", r"(?:ab)+", r"(?P<x>a)(?P=x)", r"(?m)^a", r"(a)?(?(1)b|c)", r"[^\W]", "(?x) a", "a*", "(a?)", "a|b?", "(?=a)", r"\b", "a{0,2}"):
        assert jvm_pattern(pattern) is None


def test_required_literal():
    assert jvm_pattern(r"\bclass\s+x").literal == "class"
    assert jvm_pattern(r"ab?c|d").literal == ""
    assert jvm_pattern(r"(abc)").literal == ""
    assert jvm_pattern(r"abc{0,3}x").literal in ("ab",)


def test_run_timestamps_like_strptime(spark):
    values = [
        "20240101-120000",
        "20240101_120000",
        "2024-01-01-12-00-00",
        "2024-01-01_12-00-00",
        "20240101120000",
        "snap_20240101-120000-abc1234",
        "2024-1-5-3-4-5",
        "20240230-120000",
        "20240101-120060",
        "2024115-101112",
        "20241301-000000",
        "20240101-120000x",
        "2024-01-01 10:00:00",
        "",
    ]

    def plain(text):
        for layout in times.RUN_NAME_LAYOUTS:
            try:
                return datetime.strptime(text, layout)
            except ValueError:
                continue
        return None

    assert apply(spark, values, times.parse_run_timestamp) == [plain(v) for v in values]


def test_metadata_timestamps_like_python(spark):
    values = [
        "2024-01-01T00:00:00+00:00Z",
        "2024-01-01T00:00:00Z",
        "2024-01-01 00:00:00",
        " 2024-01-01T01:02:03 ",
        "2024-01-01T01:02:03+09:00",
        "2024-01-01T01:02:03-0530",
        "2024-01-01T10:11:12.000001+01:00:30",
        "2024-01-01T10+02",
        "2024-01-01",
        "20240101",
        "2024-01-01T10",
        "20240101T101112",
        "2024-01-01T10:11:12.5",
        "2024-01-01T10:11:12,123456789",
        "2024-1-1T1:2:3",
        "2024-02-30T00:00:00",
        "2024-01-01T25:00:00",
        "2024-01-01-10:11:12",
        "2024-0101",
        "nope",
        "  ",
        "",
        None,
    ]

    def plain(text):
        text = (text or "").strip()
        text = text[:-1] if text.endswith("Z") else text
        try:
            parsed = datetime.fromisoformat(text)
        except ValueError:
            for layout in times.METADATA_LAYOUTS:
                try:
                    return datetime.strptime(text, layout)
                except ValueError:
                    continue
            return None
        return parsed.astimezone(timezone.utc).replace(tzinfo=None) if parsed.tzinfo else parsed

    assert apply(spark, values, times.parse_metadata_timestamp) == [plain(v) for v in values]


def test_timestamps_do_not_depend_on_the_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = apply(spark, ["2024-03-10T02:30:00+00:00Z"], times.parse_metadata_timestamp)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [datetime(2024, 3, 10, 2, 30)]

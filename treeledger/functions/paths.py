"""Path predicates, file types, technology stacks and size bins, all compiled to plain column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers used in place of an extension.
DEV_CONFIG = "<dev-config>"
NO_EXTENSION = "<no-extension>"

# Labels of the two pseudo stacks.
ALL_LABEL = "全部"
UNCATEGORIZED_LABEL = "未分类"

# The characters Python's str.strip() removes.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Change letters by the name and by the number of the delta status.
DELTA_LETTERS = {
    "UNMODIFIED": "=",
    "ADDED": "A",
    "DELETED": "D",
    "MODIFIED": "M",
    "RENAMED": "R",
    "COPIED": "C",
    "IGNORED": "I",
    "UNTRACKED": "?",
    "TYPECHANGE": "T",
    "UNREADABLE": "!",
    "CONFLICTED": "U",
}
DELTA_NUMBERS = {
    0: "UNMODIFIED",
    1: "ADDED",
    2: "DELETED",
    3: "MODIFIED",
    4: "RENAMED",
    5: "COPIED",
    6: "IGNORED",
    7: "UNTRACKED",
    8: "TYPECHANGE",
    9: "UNREADABLE",
    10: "CONFLICTED",
}


@dataclass(frozen=True)
class StackRule:
    """One technology stack: matched by path prefixes, by extensions, or by both together."""

    name: str
    paths: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Bin:
    """Half-open interval [lower, upper); an upper bound of None is open."""

    label: str
    lower: int
    upper: int | None


# The shipped stacks, in matching order.
DEFAULT_STACKS = (
    StackRule("Java", (), ("java",)),
    StackRule("XML", (), ("xml",)),
    StackRule("Script", (), ("sh", "bat")),
    StackRule("Python", ("config", "database", "git", "notebooks", "analyzers"), ("py",)),
    StackRule("PyTest", ("tests",), ("py",)),
    StackRule("Yaml", (), ("yaml",)),
    StackRule("Jupyter", ("notebooks",), ("ipynb",)),
)

# The shipped path filter.
DEFAULT_INCLUDE: tuple[str, ...] = ()
DEFAULT_EXCLUDE = (".vscode", "data", "doc")

# The size bins.
SIZE_BINS = (
    Bin("<1k", 0, 1_000),
    Bin("1k-2k", 1_000, 2_000),
    Bin("2k-3k", 2_000, 3_000),
    Bin("3k-10k", 3_000, 10_000),
    Bin("10k-50k", 10_000, 50_000),
    Bin(">=50k", 50_000, None),
)


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def path_kept(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """True for paths that survive the filter. Prefixes are raw strings, so ``data`` also drops ``database/x``."""
    kept = ~_any(path.startswith(p) for p in exclude)
    if include:
        kept = kept & _any(path.startswith(p) for p in include)
    return kept


def file_extension(path: Column) -> Column:
    """Text after the last dot of the whole path, or one of the two markers."""
    tail = F.substring_index(path, ".", -1)
    return (
        F.when(path.startswith("."), DEV_CONFIG)
        .when(path.contains(".") & (tail != ""), tail)
        .otherwise(NO_EXTENSION)
    )


def parse_stack_rules(entries: Iterable[Mapping] | None) -> tuple[StackRule, ...]:
    """Rules as written in a configuration mapping, unchanged; a missing section classifies nothing."""
    return tuple(
        StackRule(e["name"], tuple(e.get("paths") or ()), tuple(e.get("extensions") or ())) for e in entries or ()
    )


def normalize_stack_rules(rules: Iterable[StackRule | Mapping]) -> tuple[StackRule, ...]:
    """Rules in the spelling the report classifier needs: forward slashes, no edge slashes or dots, lower case."""
    out = []
    for rule in rules:
        if isinstance(rule, Mapping):
            rule = StackRule(rule.get("name") or "", rule.get("paths") or (), rule.get("extensions") or ())
        name = str(rule.name).strip()
        if not name:
            continue
        paths = tuple(str(p).strip().replace("\\", "/").strip("/").lower() for p in rule.paths if str(p).strip())
        extensions = tuple(str(e).strip().lstrip(".").lower() for e in rule.extensions if str(e).strip())
        out.append(StackRule(name, paths, extensions))
    return tuple(out)


def _first_match(rules: Iterable[tuple[Column, str]]) -> Column:
    """CASE chain over (condition, label); NULL when nothing matches."""
    chain = None
    for condition, label in rules:
        chain = F.when(condition, label) if chain is None else chain.when(condition, label)
    return F.lit(None).cast("string") if chain is None else chain


def _has_extension(path: Column, extension: str) -> Column:
    """``file_extension(path) == extension`` as an end-of-string test, which is cheap to repeat and pushed to scans."""
    if "." in extension or not extension:
        return F.lit(False)
    ends = ~path.startswith(".") & path.endswith("." + extension)
    if extension == DEV_CONFIG:
        return path.startswith(".") | ends
    if extension == NO_EXTENSION:
        return (~path.startswith(".") & (~path.contains(".") | path.endswith("."))) | ends
    return ends


def extract_stack(path: Column, rules: Sequence[StackRule] = DEFAULT_STACKS) -> Column:
    """Stack at extraction time: first rule whose prefixes and extensions all match; case-sensitive, raw prefixes.

    A rule without prefixes matches on extension alone and the other way round; a rule with neither never matches.
    """

    def condition(rule: StackRule) -> Column:
        by_path = _any(path.startswith(p) for p in rule.paths)
        by_extension = _any(_has_extension(path, e) for e in rule.extensions)
        if rule.paths and rule.extensions:
            return by_path & by_extension
        return by_path if rule.paths else by_extension

    return _first_match((condition(r), r.name) for r in rules if r.paths or r.extensions)


def report_path(path: Column) -> Column:
    """Trimmed, forward-slash, edge-slash-free form used by the report classifier."""
    trimmed = F.btrim(F.coalesce(path, F.lit("")), F.lit(PY_WHITESPACE))
    return F.btrim(F.translate(trimmed, "\\", "/"), F.lit("/"))


def _position(key: Column, positions: Mapping[str, int]) -> Column:
    """Position of a text in a fixed table, or NULL."""
    if not positions:
        return F.lit(None).cast("int")
    table = F.create_map(*[F.lit(x) for item in positions.items() for x in item])
    return F.try_element_at(table, key)


def report_stack(path: Column, rules: Sequence[StackRule] = DEFAULT_STACKS) -> Column:
    """Stack in reports: first rule matched by extension OR by a prefix ending on a path boundary; case-insensitive.

    The extension comes from the last path component, so ``.gitignore`` has none. As either test is enough, the first
    rule is the smaller of the first by extension and the first by prefix, each found with one look at the path.
    """
    rules = normalize_stack_rules(rules)
    if not rules:
        return F.lit(None).cast("string")
    normalized = F.lower(report_path(path))
    by_extension: dict[str, int] = {}
    by_prefix: dict[str, int] = {}
    for i, rule in enumerate(rules, 1):
        for extension in filter(None, rule.extensions):
            by_extension.setdefault(extension, i)
        for prefix in filter(None, rule.paths):
            by_prefix.setdefault(prefix, i)
    extension = F.regexp_extract(normalized, r"(?s)(?:^|/)[^/]+\.([^./]+)(?:/+\.)*$", 1)
    positions = [_position(extension, by_extension)]
    if by_prefix:
        # alternatives are tried in rule order, so the first that fits belongs to the first rule
        alternatives = "|".join(_quoted(p) for p in by_prefix)
        positions.append(_position(F.regexp_extract(normalized, f"^({alternatives})(?:/|\\z)", 1), by_prefix))
    first = F.least(*positions) if len(positions) > 1 else positions[0]
    return F.get(F.array(*[F.lit(r.name) for r in rules]), first - 1)


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def stack_labels(rules: Sequence[StackRule]) -> list[str]:
    """Choices for a stack filter: everything, each stack, and the rest if any stack is defined."""
    names = [r.name for r in normalize_stack_rules(rules)]
    return [ALL_LABEL, *names, *([UNCATEGORIZED_LABEL] if names else [])]


def stack_path(df: DataFrame) -> Column | None:
    """The column a table is classified by, or None for a table without paths."""
    if "target_path" in df.columns:
        target = F.coalesce(F.col("target_path"), F.lit(""))
        if "source_path" in df.columns:
            return F.when(target != "", target).otherwise(F.coalesce(F.col("source_path"), F.lit("")))
        return target
    for name in ("path", "file_path"):
        if name in df.columns:
            return F.coalesce(F.col(name), F.lit(""))
    return None


def stack_condition(df: DataFrame, label: str, rules: Sequence[StackRule] = DEFAULT_STACKS) -> Column | None:
    """Row condition for a stack label, or None when every row stays."""
    path = stack_path(df)
    if label == ALL_LABEL or path is None:
        return None
    stack = report_stack(path, rules)
    if label == UNCATEGORIZED_LABEL and normalize_stack_rules(rules):
        return stack.isNull()
    return F.coalesce(stack == label, F.lit(False))


def filter_by_stack(df: DataFrame, label: str, rules: Sequence[StackRule] = DEFAULT_STACKS) -> DataFrame:
    """Rows of one stack; a table without a path column comes back unchanged."""
    condition = stack_condition(df, label, rules)
    return df if condition is None else df.where(condition)


def normalized_path(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """First non-empty of the given columns, with forward slashes and no edge slashes; ``""`` if there is none."""
    names = list(columns or [c for c in ("path", "file_path") if c in df.columns])
    cleaned = [F.nullif(F.btrim(F.translate(F.col(c), "\\", "/"), F.lit("/")), F.lit("")) for c in names]
    return F.coalesce(*cleaned, F.lit(""))


def normalize_paths(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Table with ``path`` in normalised form."""
    return df.withColumn("path", normalized_path(df, columns))


def delta_status(code: Column) -> Column:
    """Change letter of a delta status given by name or by number; unknown codes give ``X``."""
    keys = dict(DELTA_LETTERS)
    keys.update({str(number): DELTA_LETTERS[name] for number, name in DELTA_NUMBERS.items()})
    table = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(code.cast("string"))), F.lit("X"))


def size_bin(value: Column, bins: Sequence[Bin] = SIZE_BINS) -> Column:
    """Label of the first bin holding the value; a value in no bin (a negative one) gets the last label."""
    cases = []
    for b in bins:
        inside = value >= b.lower
        cases.append((inside if b.upper is None else inside & (value < b.upper), b.label))
    return F.coalesce(_first_match(cases), F.lit(bins[-1].label))

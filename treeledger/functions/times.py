"""Run names, run timestamps and labels. Times are naive UTC (``timestamp_ntz``), so no session setting changes them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import PY_WHITESPACE

# Layouts of a time stamp inside a run name, in the order they are tried.
RUN_NAME_LAYOUTS = (
    "%Y%m%d-%H%M%S",
    "%Y%m%d_%H%M%S",
    "%Y-%m-%d-%H-%M-%S",
    "%Y-%m-%d_%H-%M-%S",
    "%Y%m%d%H%M%S",
)

# Fallback layouts of a metadata time stamp.
METADATA_LAYOUTS = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S")

# The text each directive accepts (documented strptime behaviour, leading zeros optional).
DIRECTIVES = {
    "%Y": r"(\d{4})",
    "%m": r"(1[0-2]|0[1-9]|[1-9])",
    "%d": r"(3[01]|[12]\d|0[1-9]|[1-9])",
    "%H": r"(2[0-3]|[01]\d|\d)",
    "%M": r"([0-5]\d|\d)",
    "%S": r"(6[01]|[0-5]\d|\d)",
}

# ISO-8601 calendar forms: date, optional time of rising precision, optional offset.
_ISO = (
    r"^(\d{4})(?:-(\d\d)-(\d\d)|(\d\d)(\d\d))"
    r"(?:(?s:.)(\d\d)(?::?(\d\d)(?::?(\d\d)(?:[.,](\d+))?)?)?"
    r"(?:Z|([+-])([01]\d|2[0-3])(?::?([0-5]\d)(?::?([0-5]\d))?)?)?)?$"
)


def _layout_pattern(layouts: Sequence[str]) -> tuple[str, str]:
    """One pattern for all layouts, and the replacement that writes any match as ``Y-m-d H:M:S``."""
    alternatives, groups = [], {directive: "" for directive in DIRECTIVES}
    for layout in layouts:
        found = re.findall("%[YmdHMS]", layout)
        for directive in found:
            groups[directive] += f"${len(alternatives) * len(DIRECTIVES) + found.index(directive) + 1}"
        pattern = layout
        for directive, accepted in DIRECTIVES.items():
            pattern = pattern.replace(directive, accepted)
        alternatives.append(pattern)
    # a group of an alternative that did not match is written as nothing
    replacement = "{%Y}-{%m}-{%d} {%H}:{%M}:{%S}"
    for directive, references in groups.items():
        replacement = replacement.replace("{" + directive + "}", references)
    return f"^(?:{'|'.join(alternatives)})$", replacement


def strptime(text: Column, layouts: Sequence[str]) -> Column:
    """Whole-string parse by the first fitting layout of the six numeric directives; NULL where none fits."""
    pattern, replacement = _layout_pattern(layouts)
    written = F.regexp_replace(text, pattern, replacement)
    return F.when(F.regexp_like(text, F.lit(pattern)), written.try_cast("timestamp_ntz"))


def parse_run_timestamp(name: Column) -> Column:
    """Time stamp when the whole run name is one, else NULL."""
    return strptime(name, RUN_NAME_LAYOUTS)


def parse_iso(text: Column) -> Column:
    """Naive UTC time of an ISO-8601 text, else NULL."""
    # parts that are missing come out empty and are filled up with zeros
    written = F.regexp_replace(text, _ISO, "$1-$2$4-$3$5 h$6:m$7:s$8.$9")
    for marker in ("h:", "m:", "s."):
        written = F.replace(written, F.lit(marker), F.lit("00" + marker[1]))
    local = F.concat(F.translate(written, "hms", ""), F.lit("0")).try_cast("timestamp_ntz")
    offset = F.regexp_replace(F.regexp_replace(text, _ISO, "$10$11:$12:$13"), ":(?=:|$)", ":00")
    shift = F.coalesce(offset.try_cast("interval hour to second"), F.expr("INTERVAL '0' SECOND"))
    return F.when(F.regexp_like(text, F.lit(_ISO)), local - shift)


def parse_metadata_timestamp(value: Column) -> Column:
    """Time stamp of run metadata: blanks trimmed, one closing ``Z`` dropped, ISO-8601 or a fallback layout."""
    text = F.regexp_replace(F.btrim(value, F.lit(PY_WHITESPACE)), "Z$", "")
    return F.coalesce(parse_iso(text), strptime(text, METADATA_LAYOUTS))


def run_type(mode: Column) -> Column:
    """``snapshot`` for snap and hist, else ``diff``."""
    return F.when(mode.isin("snap", "hist"), "snapshot").otherwise("diff")


def scope_key(mode: Column, base: Column, target: Column) -> Column:
    """The commit of a snapshot, or ``base..target``."""
    base, target = F.coalesce(base, F.lit("")), F.coalesce(target, F.lit(""))
    return F.when(mode.isin("snap", "hist"), base).otherwise(F.concat(base, F.lit(".."), target))


def run_id(mode: Column, started: Column, base: Column, target: Column) -> Column:
    """``mode_yyyyMMdd-HHmmss-short`` with the first seven characters of the target, else the base, else ``run``."""
    short = F.coalesce(F.nullif(target, F.lit("")), F.nullif(base, F.lit("")), F.lit("run"))
    return F.concat(mode, F.lit("_"), F.date_format(started, "yyyyMMdd-HHmmss"), F.lit("-"), F.left(short, F.lit(7)))


def trend_timestamp(ended_at: Column, name_timestamp: Column) -> Column:
    """Time a run is ordered and charted by."""
    return F.coalesce(ended_at, name_timestamp)


def display_label(trend: Column, run: Column) -> Column:
    """Second-precise label, or the run name."""
    return F.coalesce(F.date_format(trend, "yyyy-MM-dd HH:mm:ss"), run)


def trend_label(trend: Column, run: Column) -> Column:
    """Date label, or the run name."""
    return F.coalesce(F.date_format(trend, "yyyy-MM-dd"), run)

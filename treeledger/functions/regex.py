"""Spelling a Python regular expression for the JVM, where that gives exactly the same matches."""

from __future__ import annotations

import re
from dataclasses import dataclass

# The JVM spelling of Python's Unicode classes (letters, numbers and underscore; digits; white space).
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_CLASSES = {"w": WORD, "d": DIGIT, "s": SPACE}
_BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_NO_BOUNDARY = f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"
_PLAIN_GROUPS = ("(?:", "(?=", "(?!", "(?<=", "(?<!")
_QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")
# Assertions, and quantifiers that give nothing back: with these a match may depend on what is around it.
_AROUND = re.compile(r"\(\?[=!<]|[\^$]|\\[AzbB]|[*+?}]\+")


@dataclass(frozen=True)
class JvmPattern:
    """A pattern in JVM spelling, its number of groups, and a text every match contains (possibly empty).

    ``alone``: what is around a match does not count, so its groups can be found from the match itself.
    """

    regex: str
    groups: int
    literal: str
    alone: bool = False


class _Unsupported(Exception):
    pass


def jvm_pattern(pattern: str) -> JvmPattern | None:
    """JVM spelling of a Python pattern, or None where the two engines may differ.

    Left to Python: inline flags, conditional groups, named references, verbose syntax, patterns that match an empty text
    (the JVM also finds those inside a surrogate pair), and groups under an unbounded quantifier, which the JVM matches
    by recursion and may not finish on a long text.
    """
    groups = re.compile(pattern).groups
    try:
        regex, literal = _translate(pattern)
    except _Unsupported:
        return None
    return JvmPattern("(?d)" + regex, groups, literal, _AROUND.search(regex) is None)


class _Width:
    """Whether every alternative of a group takes at least one character."""

    def __init__(self, counts: bool = True):
        self.counts = counts
        self.taken = False
        self.alternatives = True

    def next_alternative(self) -> None:
        self.alternatives = self.alternatives and self.taken
        self.taken = False

    def always(self) -> bool:
        return self.counts and self.alternatives and self.taken


def _translate(pattern: str) -> tuple[str, str]:
    out: list[str] = []
    runs: list[str] = []
    run = ""
    groups = [_Width()]
    choices = False
    i = 0

    def optional(at: int) -> bool:
        bounds = _QUANTIFIER.match(pattern, at)
        return pattern[at : at + 1] in ("*", "?") or (bounds is not None and int(bounds[1] or 0) == 0)

    while i < len(pattern):
        c = pattern[i]
        literal = None
        takes = True
        if c == "\\":
            piece, literal, i = _escape(pattern, i)
            takes = literal is not None or piece.startswith("[")
            following = pattern[i : i + 1]
            if piece == _BOUNDARY and following.isascii() and (following.isalnum() or following == "_") and not optional(i + 1):
                # before a letter only what precedes it decides, and few places of a text have the letter
                piece = f"(?={following})(?<![{WORD}])"
        elif c == "[":
            piece, i = _char_class(pattern, i)
        elif c == "(":
            piece, i = _group(pattern, i)
            groups.append(_Width(piece in ("(", "(?:")))
            takes = False
        elif c == ")":
            piece, i = c, i + 1
            bounds = _QUANTIFIER.match(pattern, i)
            if pattern[i : i + 1] in ("*", "+") or (bounds and bounds[2] and not bounds[3]):
                raise _Unsupported(")" + pattern[i : i + 1])
            takes = groups.pop().always()
        elif c == "{":
            bounds = _QUANTIFIER.match(pattern, i)
            if bounds and (bounds[1] or bounds[3]):
                piece, i = "{" + (bounds[1] or "0") + bounds[2] + bounds[3] + "}", bounds.end()
                takes = False
            else:
                piece, literal, i = r"\{", "{", i + 1
        elif c in "}]":
            piece, literal, i = "\\" + c, c, i + 1
        else:
            if c == "|":
                choices = True
                groups[-1].next_alternative()
            piece, i = c, i + 1
            takes = c not in "^$*+?|"
            literal = c if takes and c != "." else None
        out.append(piece)
        takes = takes and not optional(i)
        groups[-1].taken = groups[-1].taken or takes
        if literal is not None and len(groups) == 1 and takes and not _QUANTIFIER.match(pattern, i):
            run += literal
        else:
            runs.append(run)
            run = ""
    groups[0].next_alternative()
    if not groups[0].alternatives:
        raise _Unsupported("a pattern that matches the empty text")
    return "".join(out), "" if choices else max([*runs, run], key=len)


def _escape(pattern: str, i: int) -> tuple[str, str | None, int]:
    e = pattern[i + 1]
    if e.lower() in _CLASSES:
        return f"[{'^' if e.isupper() else ''}{_CLASSES[e.lower()]}]", None, i + 2
    if e in "bB":
        return (_BOUNDARY if e == "b" else _NO_BOUNDARY), None, i + 2
    if e == "A":
        return r"\A", None, i + 2
    if e == "Z":
        return r"\z", None, i + 2
    if e in "123456789" and not pattern[i + 2 : i + 3].isdigit():
        return "\\" + e, None, i + 2
    char, end = _escaped_char(pattern, i)
    return _quote(char), char, end


def _escaped_char(pattern: str, i: int) -> tuple[str, int]:
    e = pattern[i + 1]
    if e in "ntrfva":
        return {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a"}[e], i + 2
    if e in "xuU":
        width = {"x": 2, "u": 4, "U": 8}[e]
        return chr(int(pattern[i + 2 : i + 2 + width], 16)), i + 2 + width
    if e.isalnum():
        raise _Unsupported("\\" + e)
    return e, i + 2


def _quote(char: str) -> str:
    return char if char.isalnum() or char == "_" else f"\\x{{{ord(char):x}}}"


def _char_class(pattern: str, i: int) -> tuple[str, int]:
    out = ["["]
    i += 1
    negated = pattern[i] == "^"
    if negated:
        out.append("^")
        i += 1
    start = i
    while pattern[i] != "]" or i == start:
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1]
            if e in _CLASSES:
                out.append(_CLASSES[e])
                i += 2
                continue
            if e.lower() in _CLASSES:
                raise _Unsupported("\\" + e)
            char, i = ("\b", i + 2) if e == "b" else _escaped_char(pattern, i)
            out.append(_quote(char))
        elif c == "-":
            edge = i == start or pattern[i + 1] == "]" or pattern[i - 2 : i] in (r"\w", r"\d", r"\s")
            out.append(r"\-" if edge else "-")
            i += 1
        else:
            out.append(_quote(c))
            i += 1
    return "".join(out) + "]", i + 1


def _group(pattern: str, i: int) -> tuple[str, int]:
    if not pattern.startswith("(?", i):
        return "(", i + 1
    for opening in _PLAIN_GROUPS:
        if pattern.startswith(opening, i):
            return opening, i + len(opening)
    name = re.match(r"\(\?P<\w+>", pattern[i:])
    if name:
        return "(", i + name.end()
    raise _Unsupported(pattern[i : i + 4])

"""Blob bytes to text, content hashes and the cheap counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stand-ins for content that is not text, and the hash of an absent side.
INVALID = "<invalid>"
BINARY = "<binary>"
DECODE_ERROR = "<utf-8-decode-error>"
NOT_TEXT = (INVALID, BINARY, DECODE_ERROR)
ZERO_HASH = "0" * 40

_NUL = "\x00"
_REPLACEMENT = "\ufffd"


def is_binary(content: Column) -> Column:
    """A NUL among the first 1024 bytes."""
    return F.contains(F.substring(content, 1, 1024), F.lit(b"\x00"))


def utf8_text(content: Column) -> Column:
    """UTF-8 text with undecodable bytes and NULs left out.

    ``make_valid_utf8`` marks every bad sequence with U+FFFD. A U+FFFD that was in the data all along must stay, so it is
    first rewritten as NUL + ``f`` (and NUL as NUL + ``n``), which the repair step leaves alone.
    """
    raw = content.cast("string")
    nul, mark = F.lit(_NUL), F.lit(_REPLACEMENT)
    escaped = F.replace(F.replace(raw, nul, F.lit(_NUL + "n")), mark, F.lit(_NUL + "f"))
    repaired = F.replace(F.make_valid_utf8(escaped), mark, F.lit(""))
    restored = F.replace(F.replace(repaired, F.lit(_NUL + "f"), mark), F.lit(_NUL + "n"), F.lit(""))
    return F.when(F.is_valid_utf8(raw), F.replace(raw, nul, F.lit(""))).otherwise(restored)


def snapshot_text(file_hash: Column, content: Column) -> Column:
    """Text of a blob, or the stand-in for a missing or binary one."""
    return (
        F.when(file_hash.isNull() | (file_hash == ZERO_HASH) | content.isNull(), INVALID)
        .when(is_binary(content), BINARY)
        .otherwise(utf8_text(content))
    )


def has_text(text: Column) -> Column:
    """False for empty text and for the stand-ins."""
    return (text != "") & ~text.isin(*NOT_TEXT)


def git_blob_hash(content: Column) -> Column:
    """Object id git gives to these bytes."""
    header = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8")
    return F.sha1(F.concat(header, F.lit(b"\x00"), content))


def char_count(text: Column) -> Column:
    """Number of code points."""
    return F.char_length(text).cast("bigint")


def line_count(text: Column) -> Column:
    """Number of line feeds plus one."""
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")

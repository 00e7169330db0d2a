"""Text functions over statements, messages and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def hostvars_to_markers(sql: Column) -> Column:
    """Host variables ``:NAME[.PART]`` become parameter markers."""
    return F.regexp_replace(sql, r":[A-Za-z_][A-Za-z0-9_.]*", "?")


def object_name(name: Column) -> Column:
    """``"LIB"."OBJ"`` or ``lib/obj`` as ``LIB/OBJ``."""
    return F.upper(F.regexp_replace(F.regexp_replace(name, '["`]', ""), r"[./]", "/"))


def error_signature(message: Column) -> Column:
    """The message id, or the first 80 characters with every run of digits as N."""
    code = F.regexp_extract(message, r"\b([A-Z]{3}[0-9A-F]{4})\b", 1)
    return F.when(code != "", code).otherwise(F.substring(F.regexp_replace(message, r"\d+", "N"), 1, 80))


def parse_error_signature(message: Column) -> Column:
    """A parser's message without its place and without long quotations, 160 characters at most."""
    placed = F.regexp_replace(message, r"Line \d+, Col: \d+", "_")
    return F.substring(F.regexp_replace(placed, r"'[^']{40,}'", "'…'"), 1, 160)


def duration(seconds: Column) -> Column:
    """mm:ss, or h:mm:ss from an hour on."""
    whole = F.floor(seconds).cast("long")
    parts = ((whole / 3600).cast("long"), F.pmod((whole / 60).cast("long"), F.lit(60)), F.pmod(whole, F.lit(60)))
    return F.when(whole >= 3600, F.format_string("%d:%02d:%02d", *parts)).otherwise(F.format_string("%02d:%02d", *parts[1:]))


def member_path(library: Column, srcfile: Column, member: Column) -> Column:
    """Where the integrated file system shows a source member."""
    return F.format_string("/QSYS.LIB/%s.LIB/%s.FILE/%s.MBR", F.upper(library), F.upper(srcfile), F.upper(member))


def markup_escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def split_statements(script: Column) -> Column:
    """Statements of a script as an array: split at semicolons outside quotes, comments outside quotes gone.

    Quoted strings are set aside one by one, so a semicolon or a dash pair inside one is left alone.
    """
    pieces = F.regexp_extract_all(script, F.lit(r"((?:--[^\n]*(?:\n|$)|'(?:[^']|'')*'?|[^;'-]|-(?!-))+|;)"), F.lit(1))
    bare = F.transform(pieces, lambda p: F.trim(F.regexp_replace(p, r"('(?:[^']|'')*'?)|--[^\n]*(?:\n|$)", "$1")))
    return F.filter(bare, lambda p: (p != ";") & (p != ""))

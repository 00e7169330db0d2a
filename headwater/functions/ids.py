"""Node identity: ``file:LIB/NAME[(MBR)]``, ``program:LIB/NAME`` and ``column:LIB/FILE.COL``, upper case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the library of a name that no library list resolves.
ANY_LIBRARY = "*LIBL"


def _library(lib: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.trim(lib)), F.lit("")), F.lit(ANY_LIBRARY))


def file_id(lib: Column, name: Column, member: Column | None = None) -> Column:
    plain = F.concat(F.lit("file:"), _library(lib), F.lit("/"), F.upper(F.trim(name)))
    return plain if member is None else F.when(member.isNull(), plain).otherwise(F.concat(plain, F.lit("("), F.upper(F.trim(member)), F.lit(")")))


def program_id(lib: Column, name: Column) -> Column:
    return F.concat(F.lit("program:"), _library(lib), F.lit("/"), F.upper(F.trim(name)))


def column_id(lib: Column, file: Column, column: Column) -> Column:
    return F.concat(F.lit("column:"), _library(lib), F.lit("/"), F.upper(F.trim(file)), F.lit("."), F.upper(F.trim(column)))


def kind_of(node: Column) -> Column:
    return F.substring_index(node, ":", 1)


def spec_of(node: Column) -> Column:
    """LIB/NAME of any node: without its kind, its member and its column."""
    bare = F.regexp_replace(F.regexp_replace(node, "^[a-z]+:", ""), r"\(.*\)$", "")
    return F.when(node.startswith("column:"), F.regexp_replace(bare, r"\.[^.]*$", "")).otherwise(bare)


def file_of_column(node: Column) -> Column:
    """The file node of a column node."""
    return F.concat(F.lit("file:"), spec_of(node))


def column_name(node: Column) -> Column:
    return F.when(node.startswith("column:"), F.substring_index(node, ".", -1))


def library_of(node: Column) -> Column:
    """The library, or null where it is not known."""
    return F.nullif(F.substring_index(spec_of(node), "/", 1), F.lit(ANY_LIBRARY))


def short_name(node: Column) -> Column:
    """The name without its library."""
    return F.substring_index(spec_of(node), "/", -1)


def split_qualified(name: Column) -> tuple[Column, Column]:
    """(library or null, name) of ``LIB/NAME`` or ``NAME``, upper case."""
    upper = F.upper(F.trim(name))
    qualified = upper.contains("/")
    lib = F.when(qualified, F.nullif(F.substring_index(upper, "/", 1), F.lit("")))
    return lib, F.when(qualified, F.regexp_replace(upper, "^[^/]*/", "")).otherwise(upper)

"""Source lines as a relation, cut by fixed columns.

lines: (library, srcfile, member, member_type, seq, line_text). A program is named LIBRARY/MEMBER.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.members import language_of

MEMBER = ("library", "srcfile", "member")
#: Fixed value: what a field name looks like.
NAME = r"^[A-Z#$@][A-Z0-9#$@_]*$"


def of_language(lines: DataFrame, language: str) -> DataFrame:
    """A language's lines as (library, srcfile, member, kind, program, seq, line); a null line is empty."""
    rows = lines.where(language_of(F.col("member_type")) == language)
    return rows.select(
        *MEMBER, F.upper(F.trim(F.coalesce("member_type", F.lit("")))).alias("kind"), F.concat_ws("/", "library", "member").alias("program"), "seq", F.coalesce("line_text", F.lit("")).alias("line")
    )


def cut(start: int, end: int | None = None, line: Column | None = None) -> Column:
    """Columns start to end - 1 of the line, counted from 0, as they are."""
    return F.substring(line if line is not None else F.col("line"), start + 1, (end - start) if end is not None else 1 << 20)


def cell(start: int, end: int | None = None) -> Column:
    """The same trimmed, in upper case, and null where blank."""
    return F.nullif(F.upper(F.trim(cut(start, end))), F.lit(""))


def char(at: int) -> Column:
    return F.upper(F.rpad(cut(at, at + 1), 1, " "))


def by_member(*order: str):
    return W.partitionBy(*MEMBER).orderBy(*(order or ("seq",)))


def so_far(order=None):
    return (order if order is not None else by_member()).rowsBetween(W.unboundedPreceding, 0)


def before(order=None):
    return (order if order is not None else by_member()).rowsBetween(W.unboundedPreceding, -1)


def joined(by: str, text: str, separator: str) -> Column:
    """An aggregate: the texts of a group in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by), F.col(text)))), lambda x: x[text]), separator)


def is_name(value: Column) -> Column:
    return F.coalesce(value.rlike(NAME), F.lit(False))

"""Source members: lines of text assembled into one row each, and how a member's text is fetched."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Member types by language.
CL_TYPES = ("CLP", "CLLE", "CL")
RPG_TYPES = ("RPGLE", "SQLRPGLE", "RPG", "RPG38", "RPT", "SQLRPG")
DDS_TYPES = ("PF", "LF", "PF38", "LF38")
SQL_TYPES = ("SQL", "TABLE", "VIEW", "SQLTABL", "SQLVIEW", "SQLIDX", "SQLPRC", "SQLFNC", "SQLTRG", "SQLSEQ", "SQLALIAS", "SQLUDT", "SQLUDF")


def language_of(member_type: Column) -> Column:
    """cl, rpg, dds, sql or null."""
    kind = F.upper(F.trim(F.coalesce(member_type, F.lit(""))))
    sql = kind.isin(*SQL_TYPES) | (kind.startswith("SQL") & ~kind.contains("RPG") & ~kind.contains("CBL"))
    return F.when(kind.isin(*CL_TYPES), "cl").when(kind.isin(*RPG_TYPES), "rpg").when(kind.isin(*DDS_TYPES), "dds").when(sql, "sql")


def embeds_sql(member_type: Column) -> Column:
    return F.upper(F.trim(F.coalesce(member_type, F.lit("")))).isin("SQLRPG", "SQLRPGLE")


def assemble(lines: DataFrame) -> DataFrame:
    """(library, srcfile, member, member_type, lines): a member's lines in order of seq; a null line is empty.

    lines: (library, srcfile, member, member_type, seq, line_text).
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("line_text", F.lit("")).alias("text"))))
    return lines.groupBy("library", "srcfile", "member").agg(F.max("member_type").alias("member_type"), F.transform(ordered, lambda x: x["text"]).alias("lines"))


def first_members(members: DataFrame) -> DataFrame:
    """(name, library, srcfile): the first member of each name."""
    return members.groupBy(F.upper("member").alias("name")).agg(F.min(F.struct("library", "srcfile")).alias("m")).select("name", "m.library", "m.srcfile")


def has_text(lines: DataFrame) -> bool:
    """Whether any line holds anything: the check that a harvest brought text back."""
    return not lines.where("length(trim(coalesce(line_text, ''))) > 0").isEmpty()


def printable_share(lines: DataFrame) -> DataFrame:
    """(printable_share): the share of printable characters; text in the wrong encoding shows by it."""
    text = F.coalesce("line_text", F.lit(""))
    return lines.agg(F.round(F.sum(F.length(F.regexp_replace(text, r"[^\x20-\x7E\t]", ""))) / F.greatest(F.sum(F.length(text)), F.lit(1)), 4).alias("printable_share"))


def text_by_path(library: str, srcfile: str, member: str) -> str:
    """The lines of a member as the integrated file system shows it."""
    place = f"/QSYS.LIB/{library.upper()}.LIB/{srcfile.upper()}.FILE/{member.upper()}.MBR"
    return f"SELECT LINE_NUMBER, LINE FROM TABLE(QSYS2.IFS_READ(PATH_NAME => '{place}')) ORDER BY LINE_NUMBER"


def alias_commands(scratch: str, library: str, srcfile: str, member: str) -> tuple[str, str, str]:
    """(command that puts an alias over the member, its text as a query, command that drops it)."""
    alias = f"{scratch}.HWMEMBER"
    run = lambda sql: f"RUNSQL SQL('{sql}') COMMIT(*NONE)"
    return run(f"CREATE OR REPLACE ALIAS {alias} FOR {library}.{srcfile} ({member})"), f"SELECT SRCSEQ, SRCDTA FROM {alias} ORDER BY SRCSEQ", run(f"DROP ALIAS {alias}")


@dataclass
class RetrievalStats:
    fetched: int = 0
    failed: int = 0
    fallbacks: int = 0
    errors: list[str] = field(default_factory=list)


class MemberReader:
    """Fetches members by the first way that works: the file system, else an alias over the member.

    In mode ``auto`` the file system is given up after ``patience`` members in a row that needed the alias.
    """

    def __init__(self, by_path: Callable[[str, str, str], list[str]] | None, by_alias: Callable[[str, str, str], list[str]], mode: str = "auto", patience: int = 5):
        self.by_path, self.by_alias, self.mode, self.patience = by_path, by_alias, mode, patience
        self.stats, self.in_a_row = RetrievalStats(), 0

    def read(self, library: str, srcfile: str, member: str) -> list[str]:
        trouble = ""
        if self.by_path is not None and self.mode in ("auto", "ifs"):
            try:
                lines = self.by_path(library, srcfile, member)
                if lines:
                    self.in_a_row = 0
                    self.stats.fetched += 1
                    return lines
                trouble = "the file system gave no lines"
            except Exception as error:  # the host says in its own words what failed
                trouble = str(error)
            if self.mode == "ifs":
                return self._failed(library, srcfile, member, trouble)
            self.stats.fallbacks += 1
            self.in_a_row += 1
            if self.in_a_row >= self.patience:
                self.mode = "alias"
        try:
            lines = self.by_alias(library, srcfile, member)
        except Exception:
            try:
                lines = self.by_alias(library, srcfile, member)  # an alias left over from a broken run goes with the first try
            except Exception as error:
                return self._failed(library, srcfile, member, "; ".join(filter(None, (trouble, str(error)))))
        self.stats.fetched += 1
        return lines

    def _failed(self, library: str, srcfile: str, member: str, why: str) -> list[str]:
        self.stats.failed += 1
        self.stats.errors.append(f"{library}/{srcfile}({member}): {why}")
        return []

"""Sessions with the host: over JDBC, or recorded responses; and what a host says about itself."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class HostError(RuntimeError):
    pass


@dataclass
class QueryResult:
    columns: list[str]
    rows: list[tuple]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The rows as text columns with the host's labels; later casts decide what is a number."""
        text = [tuple(None if v is None else str(v) for v in r) for r in self.rows]
        return spark.createDataFrame(text, ", ".join(f"`{c}` string" for c in self.columns))

    def dicts(self) -> list[dict]:
        return [{c.lower(): v for c, v in zip(self.columns, r, strict=True)} for r in self.rows]


class HostSession(Protocol):
    def pull(self, spark: SparkSession, sql: str, tag: str = "") -> DataFrame: ...
    def query(self, sql: str, params: tuple = (), tag: str = "") -> QueryResult: ...
    def run_command(self, command: str, tag: str = "") -> None: ...
    def close(self) -> None: ...


class RecordedSession:
    """Answers by tag, from memory or from ``{tag}.json`` files of ``{columns, rows}``; every call is kept."""

    def __init__(self, responses: dict[str, dict] | None = None, folder: str | Path | None = None):
        self.responses, self.folder = dict(responses or {}), Path(folder) if folder else None
        self.queries: list[tuple[str, str, tuple]] = []
        self.commands: list[str] = []
        self._tag = ""

    def with_tag(self, tag: str) -> RecordedSession:
        """The tag of the next query."""
        self._tag = tag
        return self

    def query(self, sql: str, params: tuple = (), tag: str = "") -> QueryResult:
        tag, self._tag = tag or self._tag, ""
        self.queries.append((tag, sql, tuple(params)))
        found = self.responses.get(tag)
        if found is None and self.folder and (path := self.folder / f"{tag}.json").exists():
            found = json.loads(path.read_text(encoding="utf-8"))
        if found is None:
            raise HostError(f"no recorded response for {tag!r}")
        if isinstance(found, Exception):
            raise found
        return QueryResult(list(found["columns"]), [tuple(r) for r in found["rows"]])

    def pull(self, spark: SparkSession, sql: str, tag: str = "") -> DataFrame:
        return self.query(sql, tag=tag).frame(spark)

    def run_command(self, command: str, tag: str = "") -> None:
        self.commands.append(command)
        found = self.responses.get(f"command:{command}")
        if isinstance(found, Exception):
            raise found

    def close(self) -> None:
        pass

    @staticmethod
    def record(responses: dict[str, dict], folder: str | Path) -> None:
        """Write responses to files that a session can serve."""
        Path(folder).mkdir(parents=True, exist_ok=True)
        for tag, response in responses.items():
            (Path(folder) / f"{tag}.json").write_text(json.dumps(response), encoding="utf-8")


class JdbcSession:
    """Queries over the JDBC reader, with four tries and doubling waits; commands through the host's command procedure."""

    WAITS = (2, 4, 8, 16)

    def __init__(self, spark: SparkSession, url: str, user: str, password: str, driver: str, sleep: Callable[[float], None] = time.sleep):
        self.spark, self.sleep = spark, sleep
        self.options = {"url": url, "user": user, "password": password, "driver": driver}

    def frame(self, sql: str, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
        """A query as a DataFrame. partition: (column, lower, upper, number) reads it in parallel slices."""
        reader = self.spark.read.format("jdbc").options(**self.options).option("fetchsize", 10_000)
        if partition:
            column, low, high, n = partition
            return reader.option("dbtable", f"({sql}) q").option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n).load()
        return reader.option("query", sql).load()

    def query(self, sql: str, params: tuple = (), tag: str = "") -> QueryResult:
        """Small results, as rows; what may be large is pulled."""
        if params:
            raise HostError("parameters are written into the text before a JDBC read")

        def rows() -> QueryResult:
            found = self.frame(sql)
            return QueryResult(found.columns, [tuple(r) for r in found.toLocalIterator()])

        return self._tried(rows)

    def pull(self, spark: SparkSession, sql: str, tag: str = "") -> DataFrame:
        """A result as text columns that executors read from the host; nothing of it passes the driver."""
        found = self._tried(lambda: self.frame(sql))
        return found.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in found.columns])

    def _tried(self, read: Callable):
        for wait in (*self.WAITS, None):
            try:
                return read()
            except Exception as error:
                if wait is None:
                    raise HostError(str(error)) from error
                self.sleep(wait)
        raise HostError("unreachable")

    def run_command(self, command: str, tag: str = "") -> None:
        connection = self.spark._jvm.java.sql.DriverManager.getConnection(self.options["url"], self.options["user"], self.options["password"])
        try:
            call = connection.prepareCall("CALL QSYS2.QCMDEXC(?)")
            call.setString(1, command)
            call.execute()
        finally:
            connection.close()

    def close(self) -> None:
        pass


def open_session(spark: SparkSession, settings: dict) -> HostSession:
    """kind ``recorded`` with a folder, or ``jdbc`` with a url, user, password and driver."""
    kind = settings.get("kind", "jdbc")
    if kind == "recorded":
        return RecordedSession(folder=settings["folder"])
    if kind == "jdbc":
        return JdbcSession(spark, settings["url"], settings["user"], settings["password"], settings["driver"])
    raise HostError(f"no session of kind {kind}")


CATALOG_VIEWS = ("SYSTABLES", "SYSCOLUMNS", "SYSVIEWS", "SYSVIEWDEP", "SYSPARTITIONSTAT", "SYSPARTITIONSTAT")


@dataclass
class HostProfile:
    version: str = ""
    release: str = ""
    columns: dict[str, set[str]] = field(default_factory=dict)
    has_ifs_read: bool = False

    @property
    def label(self) -> str:
        return f"V{self.version}R{self.release}" if self.version and self.release else "unknown"

    def columns_of(self, view: str) -> set[str]:
        return self.columns.get(view.upper(), set())

    def rows(self) -> list[tuple[str, str]]:
        return [("version", self.version), ("release", self.release), ("columns", json.dumps({k: sorted(v) for k, v in sorted(self.columns.items())})), ("has_ifs_read", json.dumps(self.has_ifs_read))]

    @classmethod
    def of_rows(cls, rows: Iterable[tuple[str, str]]) -> HostProfile:
        held = dict(rows)
        return cls(held.get("version", ""), held.get("release", ""), {k: set(v) for k, v in json.loads(held.get("columns") or "{}").items()}, json.loads(held.get("has_ifs_read") or "false"))


def probe(session: HostSession) -> HostProfile:
    """Version, catalog columns and whether member text can be read by path; a step that fails leaves its part empty."""
    found = HostProfile()

    def attempt(tag: str, sql: str) -> QueryResult | None:
        try:
            return session.query(sql, tag=tag)
        except Exception:
            return None

    if (env := attempt("probe.env", "SELECT OS_VERSION, OS_RELEASE FROM SYSIBMADM.ENV_SYS_INFO")) and env.rows:
        found.version, found.release = (str(x).strip() for x in env.rows[0][:2])
    views = ", ".join(f"'{v}'" for v in dict.fromkeys(CATALOG_VIEWS))
    if cols := attempt("probe.catalog_columns", f"SELECT TABLE_NAME, COLUMN_NAME FROM QSYS2.SYSCOLUMNS WHERE TABLE_SCHEMA = 'QSYS2' AND TABLE_NAME IN ({views})"):
        for view, column in (r[:2] for r in cols.rows):
            found.columns.setdefault(str(view).strip().upper(), set()).add(str(column).strip().upper())
    if (ifs := attempt("probe.ifs_read", "SELECT COUNT(*) FROM QSYS2.SYSROUTINES WHERE ROUTINE_SCHEMA = 'QSYS2' AND ROUTINE_NAME = 'IFS_READ_UTF8'")) and ifs.rows:
        found.has_ifs_read = int(ifs.rows[0][0] or 0) > 0
    return found


def source_of(session: HostSession, library: str, name: str, kind: str = "pgm") -> tuple[str, str, str] | None:
    """(library, file, member) that an object was made from; None where the host does not say."""
    try:
        found = session.query(f"SELECT SOURCE_LIBRARY, SOURCE_FILE, SOURCE_MEMBER FROM TABLE(QSYS2.OBJECT_STATISTICS('{library}', '{kind.upper()}', '{name}'))", tag=f"objstat.{library}.{name}.{kind}")
    except Exception:
        return None
    row = found.rows[0] if found.rows else ()
    parts = tuple(str(x or "").strip() for x in row[:3])
    return parts if len(parts) == 3 and all(parts) else None


def sources_in_bulk(session: HostSession, library: str, kind: str = "pgm") -> dict[str, tuple[str, str, str]] | None:
    """The same for every object of a library in one scan; None, not empty, where the scan fails."""
    try:
        found = session.query(f"SELECT OBJNAME, SOURCE_LIBRARY, SOURCE_FILE, SOURCE_MEMBER FROM TABLE(QSYS2.OBJECT_STATISTICS('{library}', '{kind.upper()}'))", tag=f"objstat.{library}.*ALL.{kind}")
    except Exception:
        return None
    rows = [tuple(str(x or "").strip() for x in r[:4]) for r in found.rows]
    return {r[0]: r[1:] for r in rows if all(r)}


def join_sources(objects: DataFrame, sources: DataFrame) -> DataFrame:
    """objects (library, name) with where they were made from; sources: (library, name, src_library, src_file, src_member)."""
    known = sources.where("coalesce(trim(src_member), '') <> ''").select(F.upper("library").alias("library"), F.upper("name").alias("name"), "src_library", "src_file", "src_member")
    return objects.join(known, ["library", "name"], "left")

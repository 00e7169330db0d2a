"""Extraction: catalog, cross-reference and source from a session into raw tables.

Full extraction pulls whole libraries. Targeted extraction starts from the outputs and goes round: what
the graph so far reaches is what the next round pulls, until a round finds nothing new.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import library_of, short_name
from ..operators.closure import closure, lineage_flow, transitive_callers
from ..operators.resolve import ColumnShapeError, in_scope
from .calllog import LoggedSession
from .catalog import CATALOG_PULLS, OUTFILES, Pull, conform
from .config import Config
from .host import HostError, HostProfile, HostSession, JdbcSession, source_of, sources_in_bulk
from .members import MemberReader, alias_commands, text_by_path
from .store import LAYERS, Store

#: Messages of a library or object that is not there.
NOT_THERE = ("CPF3064", "CPF9810")
BULK_FROM = 20
MAX_ROUNDS = 5
PAIR_CHUNK = 500
#: Source lines that the driver holds before they go to the store.
PORTION = 200_000


@dataclass
class Notes:
    rows: dict[str, int] = field(default_factory=dict)
    failed: list[str] = field(default_factory=list)
    dead: set[str] = field(default_factory=set)

    def fail(self, what: str, error: Exception) -> None:
        if len(self.failed) < 3:
            self.failed.append(f"{what}: {str(error).splitlines()[0] if str(error) else type(error).__name__}")


def pair_predicates(schema: str, name: str, pairs: list[tuple[str, str]], alias: str | None = None, chunk: int = PAIR_CHUNK) -> list[str]:
    """WHERE texts that select the pairs under either name, a bounded number of pairs in each."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    out = []
    for at in range(0, len(pairs), chunk):
        by_lib: dict[str, list[str]] = {}
        for lib, obj in pairs[at : at + chunk]:
            by_lib.setdefault(lib, []).append(quote(obj))
        parts = []
        for lib, names in sorted(by_lib.items()):
            listed = ", ".join(sorted(set(names)))
            either = f"{name} IN ({listed})" + (f" OR {alias} IN ({listed})" if alias else "")
            parts.append(f"({schema} = {quote(lib)} AND ({either}))")
        out.append(" OR ".join(parts))
    return out


def select_text(pull: Pull, available: set[str], where: str = "") -> str:
    """The pull as text for the host: the first candidate that it has, null for what it lacks."""
    columns = []
    for name, candidates, kind, required in pull.columns:
        found = next((c for c in (*candidates, name) if c.upper() in available), None) if available else candidates[0]
        if found is None and required:
            raise ColumnShapeError(name, candidates, sorted(available))
        columns.append(f"{found.upper()} AS {name.upper()}" if found else f"CAST(NULL AS VARCHAR(1)) AS {name.upper()}")
    return f"SELECT {', '.join(columns)} FROM QSYS2.{pull.source}" + (f" WHERE {where}" if where else "")


def labelled(frame: DataFrame, pull: Pull) -> DataFrame:
    """A result as the pull's table: by label, or by place where the labels say nothing and the width agrees."""
    try:
        return conform(frame, pull)
    except ColumnShapeError:
        if len(frame.columns) != len(pull.columns):
            raise
        return conform(frame.toDF(*[c[0] for c in pull.columns]), pull)


class Extractor:
    def __init__(self, spark: SparkSession, session: HostSession, config: Config, store: Store, profile: HostProfile | None = None):
        self.spark, self.session, self.config, self.store = spark, session, config, store
        self.profile, self.notes = profile or HostProfile(), Notes()
        self.touched: set[str] = set()
        own = session.session if isinstance(session, LoggedSession) else session
        if isinstance(own, JdbcSession) and config.scratch == "QTEMP":
            raise HostError("scratch: each JDBC read has a QTEMP of its own, so outfiles and aliases need a library")

    def _append(self, table: str, rows: DataFrame, keys: tuple[str, ...]) -> None:
        have = self.store.read(table)
        fresh = rows.join(have.select(*keys).distinct(), list(keys), "left_anti") if not have.isEmpty() else rows
        fresh = fresh.dropDuplicates()
        self.store.write(table, fresh, "append")
        self.touched.add(table)

    def _counted(self) -> Notes:
        """The notes with the rows of every table that was written."""
        self.notes.rows |= {table: self.store.count(table) for table in sorted(self.touched)}
        return self.notes

    def catalog(self, only: list[tuple[str, str]] | None = None) -> None:
        """Every catalog pull, of the configured libraries or of the given (library, name) pairs."""
        if only is not None and not only:
            return
        for pull in CATALOG_PULLS:
            if only is None and not self.store.read(pull.table).isEmpty():
                continue
            libraries = ", ".join(f"'{x}'" for x in self.config.libraries)
            wheres = [f"{pull.schema.upper()} IN ({libraries})"] if only is None else pair_predicates(pull.schema.upper(), pull.name.upper(), only, pull.alias.upper() if pull.alias else None)
            for where in wheres:
                text = select_text(pull, self.profile.columns_of(pull.source), where)
                tag = f"catalog.{pull.table.removeprefix('raw_')}"
                try:
                    found = labelled(self.session.pull(self.spark, text, tag), pull)
                    if only is not None:  # hosts may select more than asked for
                        found = in_scope(found, self.spark.createDataFrame(only, "lib string, name string"), pull.schema, pull.name, pull.alias)
                    self._append(pull.table, found, (pull.schema, pull.name))
                except ColumnShapeError:
                    raise
                except Exception as error:
                    self.notes.fail(tag, error)

    def outfiles(self, targets: dict[str, list[tuple[str, str]]] | None = None) -> None:
        """Cross-reference pulls: of all objects in each library, or of given (library, name) targets by table."""
        for pull in OUTFILES:
            wanted = [(lib, "*ALL") for lib in self.config.libraries] if targets is None else targets.get(pull.table, [])
            done = {(r[0], r[1]) for r in self.store.read(pull.table).select(pull.schema, pull.name).distinct().toLocalIterator()} if wanted else set()
            tag = f"xref.{pull.source.lower()}"
            for lib, name in wanted:
                if lib in self.notes.dead or (lib, name) in done:
                    continue
                try:
                    self.session.run_command(f"{pull.source} {'PGM' if pull.source == 'DSPPGMREF' else 'FILE'}({lib}/{name}) OUTPUT(*OUTFILE) OUTFILE({self.config.scratch}/{pull.source})")
                    found = labelled(self.session.pull(self.spark, f"SELECT * FROM {self.config.scratch}.{pull.source}", tag), pull)
                    if name != "*ALL":
                        found = found.where((F.upper(pull.schema) == lib) & (F.upper(pull.name) == name))
                    self._append(pull.table, found, (pull.schema, pull.name))
                except ColumnShapeError:
                    raise
                except Exception as error:
                    if any(code in str(error) for code in NOT_THERE) and name == "*ALL":
                        self.notes.dead.add(lib)
                    else:
                        self.notes.fail(f"{tag} {lib}/{name}", error)

    def reader(self) -> MemberReader:
        """Reads members the way that is configured; ``auto`` tries paths unless the host is known to lack them."""

        def lines(sql: str, library: str, srcfile: str, member: str) -> list[str]:
            return [str(r[-1] or "") for r in self.session.query(sql, tag=f"source.text.{library}.{srcfile}.{member}").rows]

        def by_path(*where: str) -> list[str]:
            return lines(text_by_path(*where), *where)

        def by_alias(*where: str) -> list[str]:
            create, text, drop = alias_commands(self.config.scratch, *where)
            self.session.run_command(create)
            try:
                return lines(text, *where)
            finally:
                self.session.run_command(drop)

        way = self.config.options.get("source_strategy", "auto")
        lacking = self.profile.label != "unknown" and not self.profile.has_ifs_read
        return MemberReader(by_path, by_alias, "alias" if way == "auto" and lacking else way)

    def members(self, only: set[str] | None = None) -> None:
        """The text of the members of every configured source file; one that fails is noted and passed over.

        Lines go to the store in portions, so the driver holds one portion and one member.
        """
        rows: list[tuple] = []

        def put() -> None:
            if rows:
                found = self.spark.createDataFrame(rows, LAYERS["raw"]["raw_source_members"])
                self._append("raw_source_members", found, ("library", "srcfile", "member"))
                rows.clear()

        reader = self.reader()
        for library, srcfile in self.config.source_files:
            try:
                listed = self.session.query(f"SELECT * FROM QSYS2.SYSPARTITIONSTAT WHERE TABLE_SCHEMA = '{library}' AND TABLE_NAME = '{srcfile}'", tag=f"source.members.{library}.{srcfile}")
            except Exception as error:
                self.notes.fail(f"{library}/{srcfile}", error)
                continue
            for row in listed.dicts():
                name = str(row.get("member") or row.get("table_partition") or row.get("partition_name") or "").strip()
                kind = row.get("member_type") or row.get("source_type")
                if name and (only is None or name.upper() in only):
                    rows += [(library, srcfile, name, kind, i, text) for i, text in enumerate(reader.read(library, srcfile, name), 1)]
                    if len(rows) >= PORTION:
                        put()
        put()
        self.notes.failed += reader.stats.errors[:3]

    def full(self) -> Notes:
        self.catalog()
        self.outfiles()
        self.members()
        return self._counted()

    def targeted(self, rounds: int = MAX_ROUNDS) -> Notes:
        """From the outputs outwards, at most ``rounds`` times: pull what the graph reaches, parse it, look again."""
        from ..plans import pipeline

        for pull in OUTFILES[:1]:  # programs by library: which program writes an output is the question
            self.outfiles({pull.table: [(lib, "*ALL") for lib in self.config.libraries]})
        known: dict[tuple[str, str, str], tuple[int, str, str]] = {("file", s.library.upper(), s.file.upper()): (0, "seed", s.id) for s in self.config.seeds}
        for number in range(1, rounds + 1):
            files = sorted({(lib, name) for kind, lib, name in known if kind == "file" and lib})
            self.catalog(files)
            covered = {(r[0], r[1]) for r in self.store.read("raw_syscolumns").select("table_schema", "table_name").distinct().toLocalIterator()}
            derived = {(r[0], r[1]) for r in self.store.read("raw_systables").where("table_type NOT IN ('T', 'P')").select("table_schema", "table_name").toLocalIterator()}
            self.outfiles({"raw_dspffd": [f for f in files if f not in covered], "raw_dspdbr": [f for f in files if f in derived or f not in covered]})
            programs = sorted({(lib, name) for kind, lib, name in known if kind == "program" and lib})
            self.members(self._member_names(programs, files))
            tables = self.store.tables("raw")
            tables |= pipeline.parse(tables["raw_source_members"])
            graph = pipeline.build(self.spark, tables, self.config)
            found = self._reached(graph)
            fresh = {k: (number, *why) for k, why in found.items() if k not in known}
            if not fresh:
                break
            known |= fresh
        rows = [(kind, lib, name, n, why, source) for (kind, lib, name), (n, why, source) in sorted(known.items())]
        self.store.write("slice_objects", self.spark.createDataFrame(rows, LAYERS["raw"]["slice_objects"]))
        return self._counted()

    def _reached(self, graph: dict[str, DataFrame]) -> dict[tuple[str, str, str], tuple[str, str]]:
        """Files and programs upstream of the outputs, and the programs that call those. The slice is what one run explains; it is configured to be small."""
        seeds = self.spark.createDataFrame([(s.id, s.node) for s in self.config.seeds], "seed string, node string")
        cone = closure(seeds, lineage_flow(graph["edges"])).where("node NOT LIKE 'column:%'")
        programs = cone.where("node LIKE 'program:%'").select("seed", "node")
        calls = graph["edges"].where("kind = 'calls'").select("src", "dst")
        callers = transitive_callers(programs, calls).select("seed", "node", F.lit("calls").alias("why"))
        every = cone.select("seed", "node", F.lit("lineage").alias("why")).unionByName(callers)
        rows = every.groupBy("node").agg(F.min("why").alias("why"), F.min("seed").alias("seed")).select(F.substring_index("node", ":", 1).alias("kind"), F.coalesce(library_of(F.col("node")), F.lit("")).alias("lib"), short_name(F.col("node")).alias("name"), "why", "seed")
        return {(r["kind"], r["lib"] or self.config.libraries[0], r["name"]): (r["why"], r["seed"]) for r in rows.toLocalIterator()}

    def _member_names(self, programs: list[tuple[str, str]], files: list[tuple[str, str]]) -> set[str]:
        """Members to fetch: the one that the host names for an object, or else the one of the object's name."""
        names: set[str] = set()
        for kind, objects in (("pgm", programs), ("file", files)):
            by_lib: dict[str, list[str]] = {}
            for lib, name in objects:
                by_lib.setdefault(lib, []).append(name)
            for lib, wanted in by_lib.items():
                bulk = sources_in_bulk(self.session, lib, kind) if len(wanted) >= BULK_FROM else None
                for name in wanted:
                    found = bulk.get(name) if bulk is not None else source_of(self.session, lib, name, kind)
                    names.add((found[2] if found else name).upper())
        return names

"""The graph build: edge-producing passes over raw and parsed tables, in a fixed order.

Every pass is a projection or a join that yields edges, and gaps where a name cannot be resolved. The
order of passes only matters for which writer's context a repeated edge keeps, so each edge carries its
pass number and the passes are united before one aggregation. Names go through one resolver: the
configured library list for a missing library, then the catalog's canonical (system) name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import ANY_LIBRARY, column_id, file_id, program_id, short_name, split_qualified
from ..operators import edges as E
from ..operators.closure import follow_last
from ..operators.resolve import catalog_objects, first_in_library_list, without_source
from ..session import checkpoint
from ..sources.config import Config
from .overrides import call_sites

#: Names whose value the running program sets.
RUNTIME_WORDS = ("UDATE", "UDAY", "UMONTH", "UYEAR", "UDATE0", "TIME", "TIMDAT")
MAX_RELAYS = 8
GAP = "kind string, object_id string, detail string, context map<string,string>"


def _context(**entries: Column) -> Column:
    pairs = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))) for k, v in sorted(entries.items())])
    return F.map_from_entries(F.array_compact(pairs)) if entries else F.create_map().cast("map<string,string>")


class GraphBuilder:
    """tables: raw and parsed tables by name. Each pass adds to ``edges`` and ``gaps``."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], config: Config):
        self.spark, self.t, self.config = spark, tables, config
        self.edges: list[DataFrame] = []
        self.gaps: list[DataFrame] = []
        cat = lambda t, /, **c: tables[t].select(*[F.upper(F.trim(F.col(v))).alias(k) for k, v in c.items()])
        systables = cat("raw_systables", lib="table_schema", name="table_name", alias="system_name")
        columns = cat("raw_syscolumns", lib="table_schema", name="table_name", alias="system_name", column="column_name", system="system_column")
        self.objects = checkpoint(catalog_objects(systables, columns))
        self.libraries = spark.createDataFrame([(lib, i) for i, lib in enumerate(config.search_list)], "lib string, place int")
        named = systables.where("coalesce(alias, '') <> ''").unionByName(columns.select("lib", "name", "alias").where("coalesce(alias, '') <> ''").distinct())
        labels = named.select("lib", F.explode(F.array("name", "alias")).alias("name"), F.col("alias").alias("canon"))
        self.labels = checkpoint(labels.groupBy("lib", "name").agg(F.max("canon").alias("canon")))
        col_label = columns.select("lib", F.coalesce("alias", "name").alias("file"), F.explode(F.array("column", "system")).alias("column"), F.coalesce(F.nullif("system", F.lit("")), F.col("column")).alias("canon")).where("column IS NOT NULL")
        self.column_labels = checkpoint(col_label.groupBy("lib", "file", "column").agg(F.max("canon").alias("canon")))
        ffd = cat("raw_dspffd", lib="file_lib", file="file_name", field="field_name")
        from_catalog = columns.select("lib", F.explode(F.array_distinct(F.array_compact(F.array("name", "alias")))).alias("file"), F.coalesce(F.nullif("system", F.lit("")), F.col("column")).alias("field"))
        self.fields = checkpoint(ffd.unionByName(from_catalog).where("lib IS NOT NULL AND file IS NOT NULL AND field IS NOT NULL").distinct())

    # -- names ---------------------------------------------------------------

    def resolved(self, df: DataFrame, lib: str, name: str, why: Column | None = None) -> DataFrame:
        """df with the library filled from the library list and the name in canonical form."""
        upper = df.withColumn(lib, F.nullif(F.upper(F.trim(lib)), F.lit(""))).withColumn(name, F.upper(F.trim(name)))
        looked = first_in_library_list(upper, self.objects, self.libraries, name)
        if why is not None:
            many = looked.where(F.col(lib).isNull() & F.col("ambiguous"))
            self.gaps.append(many.select(F.lit("ambiguous_liblist").alias("kind"), file_id(F.col("found_lib"), F.col(name)).alias("object_id"), F.concat(F.lit("found in more than one library of the list: "), why).alias("detail"), _context().alias("context")))
        looked = looked.withColumn(lib, F.coalesce(F.col(lib), "found_lib")).drop("found_lib", "ambiguous")
        return self.canonical(looked, lib, name)

    def canonical(self, df: DataFrame, lib: str, name: str) -> DataFrame:
        known = self.labels.select(F.col("lib").alias("_l"), F.col("name").alias("_n"), F.col("canon").alias("_c"))
        return df.join(known, (F.col(lib) == F.col("_l")) & (F.col(name) == F.col("_n")), "left").withColumn(name, F.coalesce("_c", F.col(name))).drop("_l", "_n", "_c")

    def canonical_column(self, df: DataFrame, lib: str, file: str, column: str) -> DataFrame:
        known = self.column_labels.select(F.col("lib").alias("_l"), F.col("file").alias("_f"), F.col("column").alias("_n"), F.col("canon").alias("_c"))
        return df.join(known, (F.col(lib) == F.col("_l")) & (F.col(file) == F.col("_f")) & (F.upper(F.col(column)) == F.col("_n")), "left").withColumn(column, F.coalesce("_c", F.upper(F.col(column)))).drop("_l", "_f", "_n", "_c")

    def reference(self, df: DataFrame, ref: str, to: str) -> DataFrame:
        """df with the column node that ``LIB/TABLE.COL`` or ``TABLE.COL`` names; rows that name none are dropped."""
        ok = df.where(F.col(ref).contains(".") & ~F.col(ref).endswith(".*"))
        table, column = F.regexp_replace(ref, r"\.[^.]*$", ""), F.substring_index(ref, ".", -1)
        lib, name = split_qualified(table)
        named = ok.withColumn("_lib", lib).withColumn("_file", name).withColumn("_col", column)
        found = self.canonical_column(self.resolved(named, "_lib", "_file"), "_lib", "_file", "_col")
        return found.withColumn(to, column_id(F.col("_lib"), F.col("_file"), F.col("_col"))).drop("_lib", "_file", "_col")

    def gap(self, df: DataFrame, kind: str, object_id: Column, detail: Column, **context: Column) -> None:
        self.gaps.append(df.select(F.lit(kind).alias("kind"), object_id.alias("object_id"), detail.alias("detail"), _context(**context).alias("context")))

    @staticmethod
    def program(column: str = "program") -> Column:
        lib, name = split_qualified(F.col(column))
        return program_id(lib, name)

    # -- catalog and cross-reference ------------------------------------------

    def catalog_passes(self) -> None:
        refs = self.t["raw_dsppgmref"].where("coalesce(trim(program_name), '') <> '' AND coalesce(trim(object_name), '') <> ''")
        refs = refs.withColumn("object_lib", F.when(~F.upper(F.trim("object_lib")).isin("*LIBL", "*CURLIB", ""), F.col("object_lib")))
        is_file = ~F.upper(F.coalesce("object_type", F.lit(""))).contains("PGM")
        files = self.resolved(refs.where(is_file), "object_lib", "object_name", F.concat(F.lit("reference of "), "program_name"))
        self.edges.append(E.reference_edges(files.unionByName(refs.where(~is_file))))
        dbr = self.t["raw_dspdbr"].where("coalesce(trim(dep_file), '') <> '' AND coalesce(trim(based_file), '') <> ''")
        for lib, name in (("dep_lib", "dep_file"), ("based_lib", "based_file")):
            dbr = self.canonical(dbr.withColumn(lib, F.upper(F.trim(lib))).withColumn(name, F.upper(F.trim(name))), lib, name)
        self.relations = checkpoint(dbr)
        self.edges.append(E.dependency_edges(self.relations))
        dep = self.t["raw_sysviewdep"]
        for lib, name in (("view_schema", "view_name"), ("object_schema", "object_name")):
            dep = self.canonical(dep.withColumn(lib, F.upper(F.trim(lib))).withColumn(name, F.upper(F.trim(name))), lib, name)
        self.edges.append(E.view_edges(dep))
        self.view_columns()

    def view_columns(self) -> None:
        from ..parsers.sql import analyze_all

        views = self.t["raw_sysviews"].where("coalesce(trim(view_definition), '') <> ''").withColumn("view_lib", F.upper(F.trim("table_schema"))).withColumn("view", F.upper(F.trim(F.coalesce(F.nullif("system_name", F.lit("")), F.col("table_name")))))
        text = F.when(F.col("view_definition").rlike(r"(?i)^\s*CREATE\b"), F.col("view_definition")).otherwise(F.concat(F.lit("CREATE VIEW Q AS "), "view_definition"))
        done = analyze_all(views.select(F.concat_ws("/", "view_lib", "view").alias("program"), F.lit(0).alias("seq"), text.alias("raw_sql")))
        self.gap(done.where("parse_error IS NOT NULL"), "parse_error", F.concat(F.lit("file:"), "program"), F.concat(F.lit("view definition: "), F.substring("parse_error", 1, 200)))
        items = done.where("parse_error IS NULL").select("program", F.explode("column_lineage").alias("item")).select("program", F.substring_index("item.target", ".", -1).alias("column"), F.explode("item.sources").alias("source")).where("column <> '*'")
        lib, name = split_qualified(F.col("program"))
        placed = self.canonical_column(items.withColumn("lib", lib).withColumn("file", name), "lib", "file", "column")
        found = self.reference(placed, "source", "to")
        self.edges.append(E.make_edges(found, column_id(F.col("lib"), F.col("file"), F.col("column")), F.col("to"), "derives_from", "source_sql", "parsed", 5))

    # -- definitions and control programs -------------------------------------

    def definition_passes(self) -> None:
        files = self.t["parsed_dds_files"].withColumn("library", F.upper("library")).withColumn("file", F.upper("file"))
        based = files.select("library", "file", F.explode("based_on").alias("base")).distinct()
        lib, name = split_qualified(F.col("base"))
        bases = self.resolved(based.withColumn("base_lib", lib).withColumn("base_file", name), "base_lib", "base_file", F.concat(F.lit("base of "), "file"))
        self.edges.append(E.make_edges(bases, file_id(F.col("library"), F.col("file")), file_id(F.col("base_lib"), F.col("base_file")), "derives_from", "dds", "parsed", 6))

        kinds = files.groupBy("library", "file").agg(F.max("dds_type").alias("dds_type"))
        fields = self.t["parsed_dds_fields"].withColumn("library", F.upper("library")).withColumn("file", F.upper("file")).join(kinds, ["library", "file"], "left")
        sources = F.when(F.size("concat_fields") > 0, F.col("concat_fields")).otherwise(F.array_compact(F.array("ref_field")))
        wanted = fields.select("library", "file", "dds_type", "field_name", "renamed_from", "ref_file", F.explode(sources).alias("source"))
        no_base = wanted.where("ref_file IS NULL")
        self.gap(no_base, "unresolved_dynamic_name", column_id(F.col("library"), F.col("file"), F.col("field_name")), F.concat(F.lit("field refers to "), "source", F.lit(" of no known base file")))
        lib, name = split_qualified(F.col("ref_file"))
        placed = self.resolved(wanted.where("ref_file IS NOT NULL").withColumn("ref_lib", lib).withColumn("ref_name", name), "ref_lib", "ref_name")
        placed = self.canonical_column(placed, "ref_lib", "ref_name", "source")
        dds_columns = E.make_edges(placed, column_id(F.col("library"), F.col("file"), F.col("field_name")), column_id(F.col("ref_lib"), F.col("ref_name"), F.col("source")), "derives_from", "dds", "parsed", 7, renamed_from=F.col("renamed_from"))
        self.edges.append(dds_columns)

        so_far = reduce(DataFrame.unionByName, self.edges).where("kind = 'derives_from' AND src LIKE 'column:%'")
        spec = F.regexp_extract("src", r"^column:([^/]*)/(.*)\.([^.]*)$", 1), F.regexp_extract("src", r"^column:([^/]*)/(.*)\.([^.]*)$", 2), F.regexp_extract("src", r"^column:([^/]*)/(.*)\.([^.]*)$", 3)
        evidence = so_far.select(spec[0].alias("lib"), spec[1].alias("file"), spec[2].alias("field"))
        same = E.same_name_columns(self.relations.select("dep_lib", "dep_file", "based_lib", "based_file").distinct(), self.fields, evidence)
        self.edges.append(E.make_edges(same, column_id(F.col("dep_lib"), F.col("dep_file"), F.col("field")), column_id(F.col("based_lib"), F.col("based_file"), F.col("field")), "derives_from", "xref", "inferred", 8, mechanism=F.lit("lf_field_passthrough")))

    def control_passes(self) -> None:
        calls = self.t["parsed_cl_calls"]
        direct = self.resolved(calls.where("via IN ('CALL', 'SBMJOB') AND called_pgm IS NOT NULL"), "called_lib", "called_pgm")
        self.edges.append(E.make_edges(direct, self.program(), program_id(F.col("called_lib"), F.col("called_pgm")), "calls", "source_cl", F.when(F.col("resolved"), "parsed").otherwise("unresolved"), 9, F.col("seq"), via=F.col("via")))
        self.gap(calls.where("via IN ('CALL', 'SBMJOB') AND (NOT resolved OR called_pgm IS NULL)"), "unresolved_dynamic_name", self.program(), F.lit("CALL target is known at run time only"), expr=F.col("expr"), seq=F.col("seq"))
        copied = calls.where("via = 'CPYF'").select("program", "seq", "resolved", "expr", *[F.col("operands")[k].alias(k) for k in ("from_lib", "from_file", "to_lib", "to_file", "fmtopt")])
        known = copied.where("resolved AND from_file IS NOT NULL AND to_file IS NOT NULL")
        self.gap(copied.where("NOT (resolved AND from_file IS NOT NULL AND to_file IS NOT NULL)"), "unresolved_dynamic_name", self.program(), F.lit("CPYF file is known at run time only"), expr=F.col("expr"))
        known = self.resolved(self.resolved(known, "from_lib", "from_file"), "to_lib", "to_file")
        self.copies = checkpoint(known)
        a, b = file_id(F.col("from_lib"), F.col("from_file")), file_id(F.col("to_lib"), F.col("to_file"))
        self.edges += [
            E.make_edges(self.copies, b, a, "derives_from", "source_cl", "parsed", 10, F.col("seq"), via=F.lit("CPYF"), program=F.col("program")),
            E.make_edges(self.copies, self.program(), a, "reads", "source_cl", "parsed", 10, F.col("seq"), via=F.lit("CPYF")),
            E.make_edges(self.copies, self.program(), b, "writes", "source_cl", "parsed", 10, F.col("seq"), via=F.lit("CPYF")),
        ]
        over = self.t["parsed_cl_overrides"]
        self.gap(over.where("NOT resolved"), "unresolved_dynamic_name", self.program(), F.lit("OVRDBF TOFILE is known at run time only"), expr=F.col("expr"), file=F.col("file"))
        sites = call_sites(self.t["parsed_cl_statements"], over, calls)
        self.sites = checkpoint(self.resolved(sites, "to_library", "to_file"))
        moved, gone = self.redirect(self.reference_rows(), "file_name")
        self.edges.append(E.make_edges(moved, F.col("src"), file_id(F.col("to_library"), F.col("to_file"), F.col("to_member")), F.col("kind"), "source_cl", "parsed", 11, F.col("site"), override_origin=F.col("origin"), call_stack=F.col("stack"), overridden_file=F.col("file_name")))
        self.gone = gone

    def reference_rows(self) -> DataFrame:
        xref = reduce(DataFrame.unionByName, self.edges).where("provenance = 'xref' AND kind IN ('reads', 'writes') AND src LIKE 'program:%' AND dst LIKE 'file:%'")
        return xref.withColumn("short", F.upper(short_name(F.col("src")))).withColumn("file_name", F.upper(short_name(F.col("dst"))))

    def redirect(self, refs: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
        """(references joined to their override targets, (short, file_name) of which every call site overrides)."""
        known = self.sites.where("file IS NOT NULL").select(F.col("program").alias("_p"), F.col("file").alias("_f"), "site", "to_library", "to_file", "to_member", "origin", "stack")
        moved = refs.join(known, (F.col("short") == F.col("_p")) & (F.col(file) == F.col("_f"))).drop("_p", "_f")
        rows = refs.select(F.col("short").alias("program"), F.col(file).alias("file"))
        gone = E.superseded(rows, self.sites.select("program", "site", "file"))
        return moved, gone.select(F.col("program").alias("short"), F.col("file").alias("file_name"))

    # -- programs -------------------------------------------------------------

    def program_passes(self) -> None:
        declared = self.t["parsed_rpg_files"].withColumn("short", F.upper(F.substring_index("program", "/", -1))).withColumn("file", F.upper("file")).withColumn("ext", F.upper(F.coalesce("extname", "file")))
        by_file, gone_file = self.redirect(declared, "file")
        by_ext, gone_ext = self.redirect(declared.join(by_file.select("program", "file").distinct(), ["program", "file"], "left_anti"), "ext")
        moved = by_file.unionByName(by_ext).select("program", "short", "file", "ext", "usage", "site", F.col("to_library").alias("lib"), F.col("to_file").alias("to"), F.col("to_member").alias("member"), "origin", "stack")
        gone = gone_file.unionByName(gone_ext).distinct()
        over = declared.join(gone.withColumnRenamed("file_name", "file"), ["short", "file"], "left_semi").select("short", "file", "ext").unionByName(declared.join(gone.withColumnRenamed("file_name", "ext"), ["short", "ext"], "left_semi").select("short", "file", "ext")).distinct()
        self.gone = self.gone.unionByName(gone).unionByName(over.select("short", F.explode(F.array("file", "ext")).alias("file_name"))).distinct()
        plain = declared.join(over, ["short", "file", "ext"], "left_anti").withColumn("lib", F.lit(None).cast("string")).withColumn("to", F.col("ext"))
        plain = self.resolved(plain, "lib", "to", F.concat(F.lit("file of "), "program"))
        self.gap(plain.where("lib IS NULL"), "outside_scope", file_id(F.lit(None).cast("string"), F.col("to")), F.concat(F.lit("file of "), "program", F.lit(" is in no library of the list")), program=F.col("program"))
        null = F.lit(None).cast("string")
        targets = plain.select("program", "short", "file", "ext", "usage", F.lit(0).alias("site"), "lib", "to", null.alias("member"), null.alias("origin"), null.alias("stack")).unionByName(moved)
        ways = F.when(F.col("usage") == "output", F.array(F.lit("writes"))).when(F.col("usage").isin("update", "combined"), F.array(F.lit("reads"), F.lit("writes"))).otherwise(F.array(F.lit("reads")))
        targets = checkpoint(targets.withColumn("way", F.explode(ways)))
        node = file_id(F.col("lib"), F.col("to"), F.col("member"))
        self.edges += [
            E.make_edges(targets.where("origin IS NULL"), self.program(), node, F.col("way"), "source_rpg", "parsed", 12, declared_file=F.col("file")),
            E.make_edges(targets.where("origin IS NOT NULL"), self.program(), node, F.col("way"), "source_cl", "parsed", 13, F.col("site"), override_origin=F.col("origin"), call_stack=F.col("stack"), declared_file=F.col("file")),
        ]
        self.read_targets = targets.where("way = 'reads'").select("program", F.concat_ws("/", F.coalesce("lib", F.lit(ANY_LIBRARY)), "to").alias("file")).distinct()
        self.declared = declared

    def statement_passes(self) -> None:
        stmts = self.t["parsed_sql_statements"].withColumn("owner", F.substring_index("program", "#", 1))
        failed, partial = F.col("stmt_type") == "PARSE_ERROR", F.col("parse_error").isNotNull() & (F.col("stmt_type") != "PARSE_ERROR")
        pid = self.program("owner")
        sql = F.substring("raw_sql", 1, 500)
        self.gap(stmts.where(failed), "parse_error", pid, F.concat(F.lit("SQL statement failed to parse: "), F.substring("parse_error", 1, 200)), sql=sql)
        self.gap(stmts.where(partial), "parse_error", pid, F.concat(F.lit("SQL statement partly parsed: "), F.substring("parse_error", 1, 200)), sql=sql)
        self.gap(stmts.where("stmt_type = 'DYNAMIC'"), "unresolved_dynamic_name", pid, F.lit("SQL text is known at run time only"), sql=sql)
        live = checkpoint(stmts.where(~failed & (F.col("stmt_type") != "DYNAMIC")).withColumn("conf", F.when(partial, "inferred").otherwise("parsed")))
        tables = live.select("owner", "conf", F.explode(F.array(F.struct(F.lit("reads").alias("way"), F.col("tables_read").alias("names")), F.struct(F.lit("writes").alias("way"), F.col("tables_written").alias("names")))).alias("x")).select("owner", "conf", "x.way", F.explode("x.names").alias("name"))
        lib, name = split_qualified(F.col("name"))
        placed = self.resolved(tables.withColumn("lib", lib).withColumn("file", name), "lib", "file", F.concat(F.lit("SQL of "), "owner"))
        self.gap(placed.where("lib IS NULL"), "outside_scope", file_id(F.lit(None).cast("string"), F.col("file")), F.concat(F.lit("table of "), "owner", F.lit(" is in no library of the list")), program=F.col("owner"))
        self.edges.append(E.make_edges(placed, pid, file_id(F.col("lib"), F.col("file")), F.col("way"), "source_sql", F.col("conf"), 14))
        items = live.select("owner", "conf", F.explode("column_lineage").alias("item")).select("owner", "conf", F.col("item.target").alias("target"), F.explode("item.sources").alias("source"))
        found = self.reference(self.reference(items, "target", "a"), "source", "b")
        self.edges.append(E.make_edges(found, F.col("a"), F.col("b"), "derives_from", "source_sql", F.col("conf"), 15, program=F.col("owner")))
        used = live.select("owner", "conf", "tables_read", F.explode("columns_used").alias("ref"))
        used = used.where(F.array_contains("tables_read", F.regexp_replace("ref", r"\.[^.]*$", "")))
        found = self.reference(used, "ref", "b")
        self.edges.append(E.make_edges(found, pid, F.col("b"), "reads", "source_sql", F.col("conf"), 17, mechanism=F.lit("sql_reference")))

    def usage_passes(self) -> None:
        fields = self.fields.select(F.concat_ws("/", "lib", "file").alias("file"), "field")
        refs = self.t["parsed_rpg_field_refs"].select("program", F.col("field_name").alias("field"))
        used = E.field_usage(self.read_targets, fields, refs)
        lib, name = split_qualified(F.col("file"))
        self.edges.append(E.make_edges(used, self.program(), column_id(lib, name, F.col("field")), "reads", "source_rpg", F.col("confidence"), 16, mechanism=F.col("mechanism")))
        copies = self.copies.select("program", F.concat_ws("/", "from_lib", "from_file").alias("from_file"), F.concat_ws("/", "to_lib", "to_file").alias("to_file"), "fmtopt")
        lib, name = split_qualified(F.col("from_file"))
        self.edges.append(E.make_edges(E.copied_fields(copies, fields), self.program(), column_id(lib, name, F.col("field")), "reads", "source_cl", F.col("confidence"), 18, mechanism=F.col("mechanism")))

    # -- fields through programs ----------------------------------------------

    def kept(self) -> DataFrame:
        """All edges so far, without the references that overrides supersede, each once."""
        every = reduce(DataFrame.unionByName, self.edges)
        is_ref = (F.col("provenance") == "xref") & F.col("kind").isin("reads", "writes") & F.col("dst").startswith("file:")
        marked = every.withColumn("short", F.when(is_ref, F.upper(short_name(F.col("src"))))).withColumn("file_name", F.when(is_ref, F.upper(short_name(F.col("dst")))))
        gone = self.gone.withColumn("_gone", F.lit(True))
        return E.first_context(marked.join(gone, ["short", "file_name"], "left").where("_gone IS NULL").drop("short", "file_name", "_gone"))

    def expansion_pass(self) -> None:
        """Which fields of what a program reads each field that it writes comes from."""
        short = lambda c: F.upper(F.substring_index(c, "/", -1))
        self.edges = [checkpoint(self.kept())]
        programs = self.declared.select("short").distinct()
        buffers = self.declared.where("program_described").select("short", F.explode(F.array_compact(F.array(F.upper(F.trim("file")), F.upper(F.trim("extname"))))).alias("name")).distinct().withColumn("buffer", F.lit(True))
        files = self.edges[0].where("src LIKE 'program:%' AND dst LIKE 'file:%' AND kind IN ('reads', 'writes')").withColumn("short", F.upper(short_name(F.col("src")))).join(programs, "short", "left_semi")
        files = files.select(F.regexp_replace("src", "^program:", "").alias("program"), "short", "kind", F.regexp_replace(F.regexp_replace("dst", "^file:", ""), r"\(.*\)$", "").alias("spec")).distinct()
        files = files.withColumn("name", F.substring_index("spec", "/", -1)).join(buffers, ["short", "name"], "left").withColumn("buffer", F.coalesce("buffer", F.lit(False)))
        catalog = self.fields.select(F.concat_ws("/", "lib", "file").alias("spec"), "field")
        given = lambda t: self.t[t].select(short("program").alias("short"), F.upper("file").alias("name"), F.upper("field_name").alias("field")).distinct()
        inputs, outputs = given("parsed_rpg_ispec_fields"), given("parsed_rpg_ospec_fields")

        reads = files.where("kind = 'reads'").select("program", "short", "name", "spec", "buffer")
        owned = checkpoint(reads.where("NOT buffer").join(catalog, "spec").select("program", "spec", "field").unionByName(reads.join(inputs, ["short", "name"]).select("program", "spec", "field")).distinct())

        writes = files.where("kind = 'writes'").select("program", "short", "name", "spec", "buffer")
        listed = writes.join(outputs, ["short", "name"])
        has_list = outputs.select("short", "name").distinct()
        has_catalog = catalog.select("spec").distinct().withColumn("known", F.lit(True))
        in_catalog = catalog.withColumn("hit", F.lit(True))
        checked = listed.join(has_catalog, "spec", "left").join(in_catalog, ["spec", "field"], "left")
        self.gap(checked.where("known AND hit IS NULL"), "ospec_field_unmapped", F.concat(F.lit("column:"), "spec", F.lit("."), "field"), F.concat(F.lit("output field of "), "program", F.lit(" has no column of its name")), program=F.col("program"))
        out_listed = checked.where("known IS NULL OR hit").select("program", "short", "spec", "field", F.lit("ospec_field").alias("direct"))
        out_plain = writes.where("NOT buffer").join(has_list, ["short", "name"], "left_anti").join(catalog, "spec").select("program", "short", "spec", "field", F.lit("record_read_through").alias("direct"))
        out = checkpoint(out_listed.unionByName(out_plain).distinct())

        moves = self.t["parsed_rpg_moves"].select(short("program").alias("short"), F.upper("result_field").alias("token"), F.upper("source_field").alias("source")).distinct()
        moves = checkpoint(moves)
        assigned = moves.select("short", F.col("token").alias("field")).distinct().withColumn("assigned", F.lit(True))
        out = out.join(assigned, ["short", "field"], "left").withColumn("assigned", F.coalesce("assigned", F.lit(False)))
        key = ["program", "short", "spec", "field", "direct"]
        owner = owned.select("program", F.col("spec").alias("from_spec"), F.col("field").alias("token"))

        def hits(states: DataFrame) -> DataFrame:
            return states.join(owner, ["program", "token"]).where("from_spec <> spec")

        found = [hits(out.where("NOT assigned").withColumn("token", F.col("field")).withColumn("path", F.lit(""))).select(*key, "token", "path", "from_spec", F.lit(False).alias("moved"))]
        dead = []
        # a move chain: breadth first, so a token keeps its shortest path and of those the first by name
        states = checkpoint(out.where("assigned").select(*key, F.col("field").alias("token"), F.lit("").alias("path")))
        seen = states.select(*key, "token")
        has_moves = moves.select("short", "token").distinct()
        for relay in range(MAX_RELAYS + 1):
            step = states.join(moves, ["short", "token"]).where("source IS NOT NULL")
            via = F.when(F.lit(relay == 0), F.lit("")).when(F.col("path") == "", F.col("token")).otherwise(F.concat_ws(" <- ", "path", "token"))
            fresh = step.select(*key, F.col("source").alias("token"), via.alias("path")).groupBy(*key, "token").agg(F.min("path").alias("path"))
            fresh = checkpoint(fresh.join(seen, [*key, "token"], "left_anti"))
            if fresh.isEmpty():
                break
            backed = hits(fresh)
            found.append(backed.select(*key, "token", "path", "from_spec", F.lit(True).alias("moved")))
            states = fresh.join(backed.select(*key, "token").distinct(), [*key, "token"], "left_anti")
            dead.append(states.join(has_moves, ["short", "token"], "left_anti").select(*key, "token"))
            seen = seen.unionByName(fresh.select(*key, "token"))
        traced = checkpoint(reduce(DataFrame.unionByName, found))

        relations = self.relations.select(F.concat_ws("/", "dep_lib", "dep_file").alias("src"), F.concat_ws("/", "based_lib", "based_file").alias("dst"), F.lit(0).alias("ord")).where("src <> dst")
        bases = follow_last(relations, traced.select(F.col("from_spec").alias("node")).distinct())
        based = traced.join(bases.withColumnRenamed("node", "from_spec"), "from_spec")
        counted = based.groupBy(*key, "token").agg(F.count_distinct("from_spec").alias("n_files"), F.count_distinct("base").alias("n_bases"), F.min("base").alias("one_base"))
        rows = traced.join(counted, [*key, "token"])
        conf = F.when(F.col("n_bases") == 1, "parsed").otherwise("inferred")
        to, source = F.concat(F.lit("column:"), "spec", F.lit("."), "field"), F.concat(F.lit("column:"), "from_spec", F.lit("."), "token")
        self.edges.append(
            E.make_edges(
                rows, to, source, "derives_from", "source_rpg", conf, 19,
                program=F.col("program"), mechanism=F.when(F.col("moved"), "cspec_move_chain").otherwise(F.col("direct")), via=F.nullif("path", F.lit("")),
                ambiguous_files=F.when(F.col("n_bases") > 1, F.col("n_files")), same_base=F.when((F.col("n_bases") == 1) & (F.col("n_files") > 1), F.col("one_base")),
            )
        )
        untraced = out.join(traced.select("program", "spec", "field").distinct(), ["program", "spec", "field"], "left_anti").where("assigned OR direct = 'ospec_field'")
        ends = reduce(DataFrame.unionByName, dead).groupBy("program", "spec", "field").agg(F.array_sort(F.collect_set("token")).alias("ends")) if dead else None
        untraced = untraced.join(ends, ["program", "spec", "field"], "left") if ends is not None else untraced.withColumn("ends", F.lit(None).cast("array<string>"))
        ends_ = F.coalesce("ends", F.array().cast("array<string>"))
        words = F.array(*map(F.lit, RUNTIME_WORDS))
        runtime, work = F.array_intersect(ends_, words), F.array_except(ends_, words)
        reason = F.when(F.size(runtime) > 0, "runtime_value").when(F.size(work) > 0, "work_variables").when(F.col("assigned"), "constant").otherwise("unowned")
        told = (
            F.when(F.size(runtime) > 0, F.concat(F.lit("set from "), F.array_join(runtime, ", ")))
            .when(F.size(work) > 0, F.concat(F.lit("its moves end at "), F.array_join(F.slice(work, 1, 6), ", ")))
            .when(F.col("assigned"), "set to constants")
            .otherwise("never set and in no file that is read")
        )
        self.gap(untraced, "rpg_untraced_output_field", to, F.concat("program", F.lit(" writes "), "field", F.lit(": "), told), program=F.col("program"), reason=reason)

    # -- all ------------------------------------------------------------------

    def build(self, phase: int = 3) -> dict[str, DataFrame]:
        """nodes, edges and gaps. Phase 1: catalog and cross-reference; 2: definitions and control programs; 3: everything."""
        self.gone = self.spark.createDataFrame([], "short string, file_name string")
        self.catalog_passes()
        if phase >= 2:
            self.definition_passes()
            self.control_passes()
        if phase >= 3:
            self.program_passes()
            self.statement_passes()
            self.usage_passes()
            self.expansion_pass()
        edges = checkpoint(self.kept())
        refs = self.t["raw_dsppgmref"].where("coalesce(trim(program_name), '') <> ''")
        members = self.t["raw_source_members"].select("member").distinct()
        if phase >= 2:
            lone = without_source(refs.select("program_lib", "program_name").distinct(), members, "program_name")
            self.gap(lone, "missing_source", program_id(F.col("program_lib"), F.col("program_name")), F.concat(F.lit("no source member is named "), "program_name"))
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(refs.select(program_id(F.col("program_lib"), F.col("program_name")).alias("id")))
        if phase >= 2:
            ends = ends.unionByName(self.t["parsed_cl_statements"].select(self.program().alias("id")))
        if phase >= 3:
            ends = ends.unionByName(self.t["parsed_rpg_files"].select(self.program().alias("id")))
        ends = ends.where("id NOT LIKE 'column:%'").distinct()
        member_of = ends.where(r"id LIKE 'file:%(%)'").select("id", F.regexp_replace("id", r"\(.*\)$", "").alias("whole"))
        owned = E.make_edges(member_of, F.col("id"), F.col("whole"), "derives_from", "catalog", "confirmed", 0, member_of=F.col("whole"))
        edges = E.first_context(edges.unionByName(owned))
        spec = F.regexp_replace("id", "^[a-z]+:", "")
        nodes = ends.unionByName(member_of.select(F.col("whole").alias("id"))).distinct().select("id", F.substring_index("id", ":", 1).alias("kind"), F.nullif(F.substring_index(spec, "/", 1), F.lit(ANY_LIBRARY)).alias("library"), F.regexp_replace(spec, "^[^/]*/", "").alias("name"), _context().alias("attrs"))
        gaps = reduce(DataFrame.unionByName, self.gaps) if self.gaps else self.spark.createDataFrame([], GAP)
        return {"nodes": nodes, "edges": edges.select(*E.KEY, "context"), "gaps": gaps.withColumn("_c", F.to_json("context")).dropDuplicates(["kind", "object_id", "detail", "_c"]).drop("_c")}

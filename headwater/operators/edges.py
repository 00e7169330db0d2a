"""Edges of the dependency graph, and the relations between edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import rank_of
from ..functions.ids import file_id, program_id

EDGE_SCHEMA = "src string, dst string, kind string, provenance string, confidence string, context map<string,string>, pass int, ord long"
KEY = ("src", "dst", "kind", "provenance", "confidence")


def usage_directions(flag: Column) -> Column:
    """What a usage flag of the compiled reference says: reading, writing or both; reading where it says nothing."""
    value = F.trim(F.coalesce(flag, F.lit("")))
    return F.when(value == "2", F.array(F.lit("writes"))).when(value.isin("3", "4"), F.array(F.lit("reads"), F.lit("writes"))).otherwise(F.array(F.lit("reads")))


def make_edges(df: DataFrame, src: Column, dst: Column, kind: Column | str, provenance: str, confidence: Column | str, pass_no: int, ord_by: Column | None = None, **context: Column) -> DataFrame:
    """Rows of EDGE_SCHEMA; a context entry that is null is left out, and loops are dropped."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    entries = F.map_from_entries(F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))) for k, v in sorted(context.items())]))) if context else F.create_map().cast("map<string,string>")
    made = df.select(
        src.alias("src"),
        dst.alias("dst"),
        lit(kind).alias("kind"),
        F.lit(provenance).alias("provenance"),
        lit(confidence).alias("confidence"),
        entries.alias("context"),
        F.lit(pass_no).alias("pass"),
        (ord_by if ord_by is not None else F.lit(0)).cast("long").alias("ord"),
    )
    return made.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")


def first_context(edges: DataFrame) -> DataFrame:
    """One row for each (src, dst, kind, provenance, confidence), with the context of the first writer."""
    order = F.struct("pass", "ord", F.to_json("context"))
    return edges.groupBy(*KEY).agg(F.min_by("context", order).alias("context"), F.min("pass").alias("pass"), F.min("ord").alias("ord"))


def reference_edges(refs: DataFrame) -> DataFrame:
    """Edges of the compiled cross-reference: calls to programs, reads and writes of files."""
    rows = refs.withColumn("_type", F.upper(F.regexp_replace(F.trim(F.coalesce("object_type", F.lit(""))), r"^\*", "")))
    program = program_id(F.col("program_lib"), F.col("program_name"))
    calls = make_edges(rows.where("_type = 'PGM'"), program, program_id(F.col("object_lib"), F.col("object_name")), "calls", "xref", "confirmed", 1)
    files = rows.where("_type IN ('FILE', 'F', '')").withColumn("_way", F.explode(usage_directions(F.col("usage_flag"))))
    return calls.unionByName(make_edges(files, program, file_id(F.col("object_lib"), F.col("object_name")), F.col("_way"), "xref", "confirmed", 2))


def dependency_edges(relations: DataFrame) -> DataFrame:
    """Dependent files derive from the files that they are based on; loops are dropped."""
    return make_edges(relations, file_id(F.col("dep_lib"), F.col("dep_file")), file_id(F.col("based_lib"), F.col("based_file")), "derives_from", "xref", "confirmed", 3)


def view_edges(dependencies: DataFrame) -> DataFrame:
    return make_edges(dependencies, file_id(F.col("view_schema"), F.col("view_name")), file_id(F.col("object_schema"), F.col("object_name")), "derives_from", "catalog", "confirmed", 4)


def same_name_columns(relations: DataFrame, fields: DataFrame, evidence: DataFrame) -> DataFrame:
    """(dep_lib, dep_file, based_lib, based_file, field): fields that a dependent file has in common with its base.

    Fields that already have evidence of their own, (lib, file, field), are left out one by one.
    """
    own = fields.select(F.col("lib").alias("dep_lib"), F.col("file").alias("dep_file"), "field")
    base = fields.select(F.col("lib").alias("based_lib"), F.col("file").alias("based_file"), "field")
    known = evidence.select(F.col("lib").alias("dep_lib"), F.col("file").alias("dep_file"), "field").distinct()
    return relations.join(own, ["dep_lib", "dep_file"]).join(base, ["based_lib", "based_file", "field"]).join(known, ["dep_lib", "dep_file", "field"], "left_anti").distinct()


def superseded(references: DataFrame, sites: DataFrame) -> DataFrame:
    """(program, file) whose every call site carries an override of the file.

    references: (program, file). sites: (program, site, file), file null where a site overrides nothing.
    """
    total = sites.groupBy("program").agg(F.count_distinct("site").alias("n_sites"))
    over = sites.where("file IS NOT NULL").groupBy("program", "file").agg(F.count_distinct("site").alias("n_over"))
    return references.select("program", "file").distinct().join(over, ["program", "file"]).join(total, "program").where("n_over = n_sites").select("program", "file")


def overridden(references: DataFrame, sites: DataFrame) -> DataFrame:
    """References redirected by overrides: those of superseded files are replaced, partly overridden ones joined by their targets.

    references: (program, file, kind). sites: (program, site, file, to_file). Result adds ``via``: default or override.
    """
    gone = superseded(references, sites)
    kept = references.join(gone, ["program", "file"], "left_anti").withColumn("via", F.lit("default"))
    targets = sites.where("to_file IS NOT NULL").select("program", "file", "to_file").distinct()
    moved = references.join(targets, ["program", "file"]).select("program", F.col("to_file").alias("file"), "kind", F.lit("override").alias("via"))
    return kept.select("program", "file", "kind", "via").unionByName(moved).distinct()


def field_usage(reads: DataFrame, fields: DataFrame, refs: DataFrame) -> DataFrame:
    """(program, file, field, confidence, mechanism): fields that a program names, and the rest that its records bring."""
    used = refs.select("program", "field").distinct().withColumn("_hit", F.lit(True))
    found = reads.select("program", "file").distinct().join(fields.select("file", "field").distinct(), "file").join(used, ["program", "field"], "left")
    named = F.col("_hit").isNotNull()
    return found.select("program", "file", "field", F.when(named, "parsed").otherwise("inferred").alias("confidence"), F.when(named, "field_reference").otherwise("record_io_all_fields").alias("mechanism"))


def copied_fields(copies: DataFrame, fields: DataFrame) -> DataFrame:
    """(program, from_file, to_file, field, confidence, mechanism): fields that a file copy brings across by name."""
    left = fields.select(F.col("file").alias("from_file"), "field").distinct()
    right = fields.select(F.col("file").alias("to_file"), "field").distinct()
    mapped = F.upper(F.coalesce("fmtopt", F.lit(""))).contains("*MAP")
    return copies.join(left, "from_file").join(right, ["to_file", "field"]).select(
        "program", "from_file", "to_file", "field", F.when(mapped, "parsed").otherwise("inferred").alias("confidence"), F.when(mapped, "cpyf_map").otherwise("cpyf_layout").alias("mechanism")
    )


def merge_parallel(edges: DataFrame) -> DataFrame:
    """(src, dst, kind, n, provenance, confidence): parallel edges as one, with the strongest one's provenance."""
    best = F.struct(rank_of("confidence").alias("rank"), "provenance", "confidence")
    return edges.groupBy("src", "dst", "kind").agg(F.count("*").alias("n"), F.max(best).alias("_best")).select("src", "dst", "kind", "n", "_best.provenance", "_best.confidence")


def evidence_counts(column_edges: DataFrame) -> DataFrame:
    """(up, down, n): distinct column edges between each pair of files."""
    return column_edges.groupBy("up", "down").agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_writers, n_readers): how often a node is written and read."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count_if(F.col("kind") == "writes").alias("n_writers"), F.count_if(F.col("kind") == "reads").alias("n_readers"))


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    own = nodes.select("node").distinct()
    return edges.join(own, edges["src"] == own["node"], "left_semi").join(own, edges["dst"] == own["node"], "left_semi")


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_group, edge columns): edges with an end among the nodes (node, node_group), each once in a group."""
    by_src = edges.join(nodes, edges["src"] == nodes["node"]).drop("node")
    by_dst = edges.join(nodes, edges["dst"] == nodes["node"]).drop("node")
    return by_src.unionByName(by_dst).dropDuplicates(["node_group", *KEY])

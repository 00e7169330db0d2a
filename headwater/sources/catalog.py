"""Catalog and cross-reference pulls: what columns each host table may have, and how rows are mapped.

A pull names its columns by candidates, the preferred one first, so hosts of different releases and
command output files with different labels give the same table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resolve import adaptive_projection, in_scope, not_harvested, trimmed, whole_number


@dataclass(frozen=True)
class Pull:
    """A table of ours: the host's table, and (name, candidates, type, required) of each column."""

    table: str
    source: str
    columns: tuple[tuple[str, tuple[str, ...], str, bool], ...]
    schema: str
    name: str
    alias: str | None = None


def _c(name: str, *candidates: str, kind: str = "string", required: bool = False):
    return name, candidates or (name,), kind, required


#: Column synonyms of the catalog views, preferred first.
CATALOG_PULLS = (
    Pull("raw_systables", "SYSTABLES", (_c("table_schema", required=True), _c("table_name", required=True), _c("system_name", "system_table_name"), _c("table_type"), _c("file_type"), _c("row_count", "number_rows", "card", kind="long"), _c("long_comment")), "table_schema", "table_name", "system_name"),
    Pull("raw_syscolumns", "SYSCOLUMNS", (_c("table_schema", required=True), _c("table_name", required=True), _c("system_name", "system_table_name"), _c("column_name", required=True), _c("system_column", "system_column_name"), _c("ordinal", "ordinal_position", kind="int"), _c("data_type"), _c("length", kind="int"), _c("numeric_scale", kind="int"), _c("is_nullable"), _c("column_heading")), "table_schema", "table_name", "system_name"),
    Pull("raw_sysviews", "SYSVIEWS", (_c("table_schema", required=True), _c("table_name", required=True), _c("system_name", "system_view_name", "system_table_name"), _c("view_definition")), "table_schema", "table_name", "system_name"),
    Pull("raw_sysviewdep", "SYSVIEWDEP", (_c("view_schema", required=True), _c("view_name", required=True), _c("object_schema", "object_schema", "table_schema", required=True), _c("object_name", "object_name", "table_name", required=True), _c("object_type")), "view_schema", "view_name"),
    Pull("raw_syspartitionstat", "SYSPARTITIONSTAT", (_c("table_schema", required=True), _c("table_name", required=True), _c("system_name", "system_table_name"), _c("partition_name", "table_partition", "partition_name", required=True), _c("number_rows", kind="long"), _c("source_type")), "table_schema", "table_name", "system_name"),
)
#: Column synonyms of the display commands' output files, preferred first.
OUTFILES = (
    Pull("raw_dsppgmref", "DSPPGMREF", (_c("program_lib", "whlib", required=True), _c("program_name", "whpnam", required=True), _c("object_lib", "whlnam", required=True), _c("object_name", "whfnam", required=True), _c("object_type", "whotyp", "whobjt", required=True), _c("usage_flag", "whfusg", required=True), _c("ref_count", "whncnt")), "program_lib", "program_name"),
    Pull("raw_dspdbr", "DSPDBR", (_c("dep_lib", "whreli", required=True), _c("dep_file", "whrefi", required=True), _c("based_lib", "whrli", "whlib", required=True), _c("based_file", "whrfi", "whfile", required=True), _c("dep_type", "whrtyp", "whtype")), "dep_lib", "dep_file"),
    Pull("raw_dspffd", "DSPFFD", (_c("file_lib", "whlib", required=True), _c("file_name", "whfile", required=True), _c("record_format", "whname"), _c("field_name", "whfldi", "whflde", required=True), _c("field_type", "whfldt"), _c("field_length", "whfldb"), _c("field_scale", "whfldp", "whfldd"), _c("field_text", "whftxt"), _c("field_ordinal", "whfldn", "whfobo")), "file_lib", "file_name"),
)
INTEGERS = {"ref_count", "field_length", "field_scale", "field_ordinal"}
PULLS = {p.table: p for p in (*CATALOG_PULLS, *OUTFILES)}


def conform(df: DataFrame, pull: Pull) -> DataFrame:
    """A host table as ours: columns found by name, text trimmed, counts as numbers or null."""
    out = adaptive_projection(df, list(pull.columns))
    return out.select(*[(whole_number(F.col(n)) if n in INTEGERS else trimmed(F.col(n)) if k == "string" else F.col(n)).alias(n) for n, _, k, _ in pull.columns])


def harvest(df: DataFrame, pull: Pull, pairs: DataFrame | None = None, have: DataFrame | None = None) -> DataFrame:
    """New rows of a pull: within the pairs (lib, name) if any are given, less what was harvested before."""
    rows = conform(df, pull)
    if pairs is not None:
        rows = in_scope(rows, pairs, pull.schema, pull.name, pull.alias)
    return rows if have is None else not_harvested(rows, have, pull.schema, pull.name)

"""File definitions: record formats, fields and what logical files are based on.

A definition is a run of entries: a line with a name or a name type opens one, and the lines after it
without either add keywords to it. Entries are numbered by a running count over a member's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .lines import MEMBER, by_member, cell, char, cut, joined, of_language, so_far


def _operands(keyword: str) -> Column:
    """The operands of a keyword's last use in an entry; null where it is not used."""
    found = F.regexp_extract_all(F.upper("text"), F.lit(rf"(?:^|[^A-Z0-9]){keyword}\s*\(([^)]*)\)"), F.lit(1))
    return F.when(F.size(found) > 0, F.filter(F.split(F.replace(F.element_at(found, -1), F.lit(","), F.lit(" ")), r"\s+"), lambda x: x != ""))


def parse_dds(lines: DataFrame) -> dict[str, DataFrame]:
    """files (library, file, dds_type, record_format, based_on, is_join) and fields of every member with definitions."""
    rows = of_language(lines, "dds").where((char(5) == "A") & (char(6) != "*"))
    rows = rows.select(*MEMBER, "seq", F.trim(char(16)).alias("type"), cell(18, 28).alias("name"), F.nullif(F.trim(char(37)), F.lit("")).alias("usage"), F.rtrim(cut(44)).alias("words"))
    opens = (F.col("name").isNotNull() | F.col("type").isin("R", "J", "K", "S", "O")).cast("int")
    rows = rows.withColumn("entry", F.sum(opens).over(so_far()))
    entries = rows.groupBy(*MEMBER, "entry").agg(
        F.min_by("type", "seq").alias("type"), F.min_by("name", "seq").alias("name"), F.min_by("usage", "seq").alias("usage"), joined("seq", "words", " ").alias("text")
    )
    kind = F.when(F.col("type") == "R", "record").when((F.col("type") == "") & F.col("name").isNotNull(), "field").otherwise("file")
    order = by_member("entry")
    entries = entries.withColumn("kind", kind).withColumn("record_format", F.coalesce(F.last(F.when(F.col("kind") == "record", F.coalesce("name", F.lit(""))), ignorenulls=True).over(so_far(order)), F.col("member")))
    entries = checkpoint(entries)
    bases = F.when(F.col("kind") != "field", F.concat(F.coalesce(_operands("PFILE"), F.array()), F.coalesce(_operands("JFILE"), F.array())))
    joins = (F.col("kind") != "field") & _operands("JFILE").isNotNull()
    logical = (F.col("kind") != "field") & (_operands("PFILE").isNotNull() | _operands("JFILE").isNotNull())
    whole = entries.groupBy(*MEMBER).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("entry", F.coalesce(bases, F.array().cast("array<string>")).alias("b")))), lambda x: x["b"])).alias("based_on"),
        F.max(joins).alias("is_join"),
        F.when(F.max(logical), "LF").otherwise("PF").alias("dds_type"),
    )
    formats = entries.where("kind IN ('record', 'field')").groupBy(*MEMBER, "record_format").agg(F.min("entry").alias("entry"))
    files = formats.join(whole, list(MEMBER)).select("library", F.col("member").alias("file"), "dds_type", "record_format", "based_on", "is_join")

    first = lambda keyword: F.get(_operands(keyword), F.lit(0))
    fields = entries.where("kind = 'field'").join(whole, list(MEMBER))
    is_lf = F.col("dds_type") == "LF"
    single = is_lf & ~F.col("is_join") & (F.size("based_on") == 1)
    renamed, ref_field, ref_file = first("RENAME"), first("REFFLD"), first("JREF")
    follows = single | (is_lf & F.col("is_join"))
    return {
        "parsed_dds_files": files,
        "parsed_dds_fields": fields.select(
            "library",
            F.col("member").alias("file"),
            "record_format",
            F.col("name").alias("field_name"),
            renamed.alias("renamed_from"),
            F.coalesce(ref_field, F.when(follows, F.coalesce(renamed, F.col("name")))).alias("ref_field"),
            F.coalesce(ref_file, F.when(single, F.get("based_on", F.lit(0)))).alias("ref_file"),
            F.coalesce(_operands("CONCAT"), F.array().cast("array<string>")).alias("concat_fields"),
            "usage",
        ),
    }

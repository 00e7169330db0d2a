"""Names to objects: library lists, canonical names, resuming and scoping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def catalog_objects(*tables: DataFrame) -> DataFrame:
    """Distinct (lib, name) under which any of the tables, each (lib, name, alias), knows an object."""
    found = None
    for t in tables:
        labels = t.select("lib", F.explode(F.array("name", "alias")).alias("name")).where("lib IS NOT NULL AND coalesce(trim(name), '') <> ''")
        found = labels if found is None else found.unionByName(labels)
    return found.select(F.upper(F.trim("lib")).alias("lib"), F.upper(F.trim("name")).alias("name")).distinct()


def first_in_library_list(names: DataFrame, objects: DataFrame, libraries: DataFrame, key: str = "name") -> DataFrame:
    """names with (found_lib, ambiguous): the object's first library in list order.

    libraries: (lib, place), a library list as configured. found_lib is null where no listed library has
    the object; ambiguous is true where more than one does. The lookup is aggregated to a row for each
    name before it is joined, so a name that many rows share is no larger than another.
    """
    listed = libraries.groupBy("lib").agg(F.min("place").alias("place"))
    hits = objects.join(listed, "lib").groupBy("name").agg(F.min_by("lib", "place").alias("found_lib"), (F.count_distinct("lib") > 1).alias("ambiguous"))
    found = hits.withColumnRenamed("name", "_name")
    return names.join(found, names[key] == F.col("_name"), "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False))).drop("_name")


def canonical_labels(systables: DataFrame) -> DataFrame:
    """(lib, label, canon) from (lib, name, system_name, ord): the last row that names a label wins."""
    rows = systables.select("lib", F.explode(F.array_distinct(F.array("name", "system_name"))).alias("label"), F.col("system_name").alias("canon"), "ord")
    return rows.where("label IS NOT NULL").groupBy("lib", "label").agg(F.max_by("canon", "ord").alias("canon"))


def canonical(names: DataFrame, labels: DataFrame, lib: str = "lib", name: str = "name", to: str = "canon") -> DataFrame:
    """names with the canonical name, or their own where the library has no such label."""
    known = labels.select(F.col("lib").alias("_lib"), F.col("label").alias("_label"), F.col("canon").alias("_canon"))
    joined = names.join(known, (names[lib] == F.col("_lib")) & (names[name] == F.col("_label")), "left")
    return joined.withColumn(to, F.coalesce("_canon", F.col(name))).drop("_lib", "_label", "_canon")


def in_scope(rows: DataFrame, pairs: DataFrame, schema: str, name: str, alias: str | None = None) -> DataFrame:
    """Rows whose (schema, name) or (schema, alias) is among the pairs (lib, name)."""
    by = pairs.select(F.upper("lib").alias("_lib"), F.upper("name").alias("_name")).distinct()
    hit = F.upper(F.col(name)) == F.col("_name")
    if alias is None:
        return rows.join(by, (F.upper(F.col(schema)) == F.col("_lib")) & hit, "left_semi")
    # two equalities instead of one condition with OR, which would leave no key to join on
    keyed = rows.withColumn("_row", F.struct(*rows.columns)).withColumn("_name", F.explode(F.array_distinct(F.array(F.upper(F.col(name)), F.upper(F.col(alias))))))
    hits = keyed.withColumn("_lib", F.upper(F.col(schema))).join(by, ["_lib", "_name"], "left_semi")
    return rows.join(hits.select("_row").distinct(), F.struct(*[rows[c] for c in rows.columns]).eqNullSafe(F.col("_row")), "left_semi")


def not_harvested(wanted: DataFrame, have: DataFrame, *keys: str) -> DataFrame:
    """The wanted rows whose keys no earlier harvest has."""
    return wanted.join(have.select(*keys).distinct(), list(keys), "left_anti")


def without_source(programs: DataFrame, members: DataFrame, program: str = "program", member: str = "member") -> DataFrame:
    """Programs that no source member is named after, without regard to case."""
    have = members.select(F.upper(F.trim(F.col(member))).alias("_member")).distinct()
    return programs.join(have, F.upper(F.trim(F.col(program))) == F.col("_member"), "left_anti")


def adaptive_projection(df: DataFrame, spec: list[tuple[str, tuple[str, ...], str, bool]]) -> DataFrame:
    """Columns by the first candidate that the table has: (name, candidates, type, required) each.

    A missing optional column is null; a missing required one is an error that names what was tried.
    """
    have = {c.lower(): c for c in df.columns}
    out = []
    for name, candidates, kind, required in spec:
        found = next((have[c.lower()] for c in (*candidates, name) if c.lower() in have), None)
        if found is None and required:
            raise ColumnShapeError(name, candidates, df.columns)
        out.append((F.col(f"`{found}`").cast(kind) if found else F.lit(None).cast(kind)).alias(name))
    return df.select(*out)


class ColumnShapeError(ValueError):
    def __init__(self, name: str, tried: tuple[str, ...], actual: list[str]):
        super().__init__(f"no column for {name}: tried {', '.join(tried) or name}; the table has {', '.join(actual)}")
        self.name, self.tried, self.actual = name, tried, actual


def trimmed(value: Column) -> Column:
    return F.trim(value.cast("string"))


def whole_number(value: Column) -> Column:
    """The text as an integer, or null."""
    return F.trim(value.cast("string")).try_cast("int")

"""The whole run over a set of tables: parse, build, analyse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis
from ..parsers.control import parse_control
from ..parsers.dds import parse_dds
from ..parsers.rpg import parse_rpg
from ..parsers.sql import parse_sql
from ..session import checkpoint, ship
from ..sources.config import Config
from ..sources.members import assemble
from .build import GraphBuilder


def parse(lines: DataFrame) -> dict[str, DataFrame]:
    """Every parsed table from the source lines."""
    ship(lines.sparkSession)
    out = parse_dds(lines) | parse_control(lines) | parse_rpg(lines)
    out |= parse_sql(assemble(lines), out.pop("rpg_sql_blocks"), out["parsed_cl_calls"])
    return out


def build(spark: SparkSession, tables: dict[str, DataFrame], config: Config, phase: int = 3) -> dict[str, DataFrame]:
    return {name: checkpoint(df) for name, df in GraphBuilder(spark, tables, config).build(phase).items()}


def seed_frames(spark: SparkSession, config: Config, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(output_id, node) of the configured outputs, and of the columns of their files."""
    rows = [(s.id, s.node, s.library, s.file) for s in config.seeds]
    seeds = spark.createDataFrame(rows, "output_id string, node string, lib string, file string")
    columns = seeds.join(fields, ["lib", "file"]).select("output_id", F.concat(F.lit("column:"), "lib", F.lit("/"), "file", F.lit("."), "field").alias("node"))
    return seeds.select("output_id", "node"), columns


def fields_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(lib, file, field): fields by file from the catalog and from field displays, by system name."""
    c = tables["raw_syscolumns"].select(F.col("table_schema").alias("lib"), F.explode(F.array_distinct(F.array_compact(F.array("table_name", "system_name")))).alias("file"), F.coalesce(F.nullif("system_column", F.lit("")), F.col("column_name")).alias("field"))
    d = tables["raw_dspffd"].select(F.col("file_lib").alias("lib"), F.col("file_name").alias("file"), F.col("field_name").alias("field"))
    return c.unionByName(d).select(*[F.upper(F.trim(x)).alias(x) for x in ("lib", "file", "field")]).distinct()


def analyse(spark: SparkSession, tables: dict[str, DataFrame], config: Config) -> dict[str, DataFrame]:
    """Lineage, commonality, complexity and candidates; gaps gain a row for each output that the graph lacks."""
    edges, nodes = tables["edges"], tables["nodes"].select(F.col("id").alias("node"))
    seeds, columns = seed_frames(spark, config, fields_of(tables))
    lineage = checkpoint(analysis.output_lineage(seeds, columns, edges))
    matrix = checkpoint(analysis.commonality_matrix(lineage))
    programs = tables["program_classification"].where("program_class = 'program_described_or_complex'").select(F.substring_index("program", "/", -1).alias("name"))
    scores = analysis.complexity(seeds, edges, programs, nodes)
    found = analysis.candidate_products(matrix)
    candidates = found.select("rank", "fanout", F.to_json(F.struct(*sorted(found.columns))).alias("payload"))
    missing = analysis.unknown_seeds(seeds, edges, nodes).select(F.lit("no_lineage").alias("kind"), F.col("node").alias("object_id"), F.concat(F.lit("output "), "output_id", F.lit(" is not in the graph")).alias("detail"), F.create_map(F.lit("output"), "output_id").alias("context"))
    gaps = tables["gaps"].where("kind <> 'no_lineage'").unionByName(missing)  # a second run adds nothing
    return {"output_lineage": lineage, "commonality_matrix": matrix, "complexity_scores": scores, "product_candidates": candidates, "gaps": gaps}


def run(spark: SparkSession, raw: dict[str, DataFrame], config: Config) -> dict[str, DataFrame]:
    tables = dict(raw)
    tables |= {name: checkpoint(df) for name, df in parse(raw["raw_source_members"]).items()}
    tables |= build(spark, tables, config)
    return tables | analyse(spark, tables, config)

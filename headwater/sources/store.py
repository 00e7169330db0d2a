"""The store: typed tables in four layers, each a Parquet folder below one root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_S = "array<string>"
#: Schemas by layer and table.
LAYERS: dict[str, dict[str, str]] = {
    "raw": {
        "raw_systables": "table_schema string, table_name string, system_name string, table_type string, file_type string, row_count long, long_comment string",
        "raw_syscolumns": "table_schema string, table_name string, system_name string, column_name string, system_column string, ordinal int, data_type string, length int, numeric_scale int, is_nullable string, column_heading string",
        "raw_sysviews": "table_schema string, table_name string, system_name string, view_definition string",
        "raw_sysviewdep": "view_schema string, view_name string, object_schema string, object_name string, object_type string",
        "raw_syspartitionstat": "table_schema string, table_name string, system_name string, partition_name string, number_rows long, source_type string",
        "raw_dsppgmref": "program_lib string, program_name string, object_lib string, object_name string, object_type string, usage_flag string, ref_count int",
        "raw_dspdbr": "dep_lib string, dep_file string, based_lib string, based_file string, dep_type string",
        "raw_dspffd": "file_lib string, file_name string, record_format string, field_name string, field_type string, field_length int, field_scale int, field_text string, field_ordinal int",
        "raw_source_members": "library string, srcfile string, member string, member_type string, seq int, line_text string",
        "host_profile": "key string, value string",
        "slice_objects": "kind string, library string, name string, round int, reason string, source_ref string",
    },
    "parsed": {
        "parsed_cl_statements": "program string, seq int, command string, raw_text string",
        "parsed_cl_overrides": "program string, seq int, file string, to_file string, to_library string, to_member string, scope string, resolved boolean, expr string",
        "parsed_cl_calls": f"program string, seq int, called_lib string, called_pgm string, via string, params {_S}, operands map<string,string>, resolved boolean, expr string",
        "parsed_dds_files": f"library string, file string, dds_type string, record_format string, based_on {_S}, is_join boolean",
        "parsed_dds_fields": f"library string, file string, record_format string, field_name string, renamed_from string, ref_field string, ref_file string, concat_fields {_S}, usage string",
        "parsed_rpg_files": "program string, file string, usage string, extname string, rename_rec string, declared_via string, program_described boolean",
        "parsed_rpg_io_ops": "program string, seq int, opcode string, file string, direction string",
        "parsed_rpg_ospec_fields": "program string, file string, field_name string, end_pos int",
        "parsed_rpg_ispec_fields": "program string, file string, field_name string, ext_name string, from_pos int, to_pos int",
        "parsed_rpg_moves": "program string, seq int, opcode string, source_field string, result_field string",
        "parsed_rpg_field_refs": "program string, field_name string",
        "parsed_sql_statements": f"program string, seq int, stmt_type string, tables_read {_S}, tables_written {_S}, column_lineage array<struct<target:string,sources:array<string>>>, columns_used {_S}, parse_error string, raw_sql string",
        "program_classification": f"program string, program_class string, reasons {_S}, needs_review boolean",
    },
    "graph": {
        "nodes": "id string, kind string, library string, name string, attrs map<string,string>",
        "edges": "src string, dst string, kind string, provenance string, confidence string, context map<string,string>",
        "gaps": "kind string, object_id string, detail string, context map<string,string>",
    },
    "analysis": {
        "output_lineage": "output_id string, source_file string, source_column string, path_len int, min_confidence string, relation string",
        "commonality_matrix": "output_id string, source_id string, present boolean",
        "complexity_scores": "output_id string, path_depth int, complex_pgms int, override_depth int, unresolved int, bucket string",
        "product_candidates": "rank int, fanout int, payload string",
    },
}
LAYER_OF = {t: layer for layer, tables in LAYERS.items() for t in tables}


class Store:
    """Named tables below a root. A table never written reads as empty; one written by an older version gets its new columns as nulls."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        if name not in LAYER_OF:
            raise ValueError(f"no table {name}")
        return f"{self.root}/{LAYER_OF[name]}/{name}"

    def schema(self, name: str) -> str:
        return LAYERS[LAYER_OF[name]][name]

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], self.schema(name))

    def _folder(self, name: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def read(self, name: str) -> DataFrame:
        files, folder = self._folder(name)
        if not files.exists(folder):
            return self.empty(name)
        found = self.spark.read.parquet(self.path(name))
        return self.empty(name).unionByName(found, allowMissingColumns=True)

    def write(self, name: str, df: DataFrame, mode: str = "overwrite") -> None:
        shaped = self.empty(name).unionByName(df, allowMissingColumns=True).select(*self.empty(name).columns)
        if mode == "overwrite":  # never over what the rows may still be read from
            files, folder = self._folder(name)
            fresh = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) + ".next")
            shaped.write.mode("overwrite").parquet(self.path(name) + ".next")
            files.delete(folder, True)
            files.rename(fresh, folder)
        else:
            shaped.write.mode(mode).parquet(self.path(name))

    def count(self, name: str) -> int:
        return self.read(name).count()

    def reset(self, layer: str) -> None:
        if layer not in LAYERS:
            raise ValueError(f"no layer {layer}")
        for name in LAYERS[layer]:
            files, folder = self._folder(name)
            files.delete(folder, True)

    def tables(self, *layers: str) -> dict[str, DataFrame]:
        return {t: self.read(t) for layer in layers for t in LAYERS[layer]}

    def views(self) -> None:
        """Every table as a temporary view, for queries in SQL."""
        for name in LAYER_OF:
            self.read(name).createOrReplaceTempView(name)

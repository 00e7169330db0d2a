"""Estate profiling: read-only aggregates over the host's catalog, and advice from their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seed_class(attribute: Column, sql_type: Column) -> Column:
    """What kind of object a configured output is; missing where neither is known."""
    return (
        F.when(attribute.isNull() & sql_type.isNull(), "missing")
        .when(F.upper(sql_type) == "TABLE", "ddl_table")
        .when(F.upper(sql_type) == "VIEW", "view")
        .when(F.upper(attribute).startswith("PF"), "dds_pf")
        .when(F.upper(attribute).startswith("LF"), "lf")
        .otherwise("unknown")
    )


def volumes(df: DataFrame, *by: str, size: str, rows: str | None = None) -> DataFrame:
    """(by, n, total_size, total_rows) for each group."""
    totals = [F.count("*").alias("n"), F.sum(size).alias("total_size")]
    return df.groupBy(*by).agg(*totals, *([F.sum(rows).alias("total_rows")] if rows else []))


def largest(df: DataFrame, size: str, key: str, limit: int = 10) -> DataFrame:
    return df.orderBy(F.desc(size), key).limit(limit)


def recommend(report: dict) -> list[str]:
    """Advice by fixed limits: columns, source lines and members, seeds, slow probes, programs."""
    advice = []
    if report.get("columns", 0) > 50_000:
        advice.append("scope the catalog pull to the slice: more than 50,000 columns")
    if report.get("source_lines", 0) > 1_000_000 or report.get("source_members", 0) > 5_000:
        advice.append("harvest source by target: more than 1,000,000 lines or 5,000 members")
    other = sorted(k for k, v in report.get("seed_classes", {}).items() if v != "ddl_table")
    if other:
        advice.append("check seeds that are not plain tables: " + ", ".join(other))
    slow = sorted(k for k, v in report.get("probe_seconds", {}).items() if v > 5)
    if slow:
        advice.append("run off-peak, these probes took over 5 s: " + ", ".join(slow))
    if report.get("programs", 0) > 2_000:
        advice.append("pull the cross-reference by object: more than 2,000 programs")
    return advice or ["the estate is modest: a full extract will do"]

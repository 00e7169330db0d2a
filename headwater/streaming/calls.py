"""The host-call log as a stream: it is appended to while an extraction runs, so it can be watched.

Rates are kept by tag in event-time windows; a call that is logged later than the watermark allows is
left out of its window, as the log is written in order but for clock differences between runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import error_signature
from ..sources.calllog import SCHEMA


def read_calls(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Log lines of all files in a folder, with ``at`` as event time."""
    reader = spark.readStream.schema(SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder).withColumn("at", F.to_timestamp("ts"))


def call_rates(calls: DataFrame, window: str = "1 minute", slide: str | None = None, late: str = "5 minutes") -> DataFrame:
    """(window_start, tag, n, total_ms, n_failed) by event-time window."""
    when = F.window("at", window, slide) if slide else F.window("at", window)
    grouped = calls.withWatermark("at", late).groupBy(when.alias("w"), "tag")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("ms"), 1).alias("total_ms"), F.count_if(~F.col("ok")).alias("n_failed")).select(F.col("w.start").alias("window_start"), "tag", "n", "total_ms", "n_failed")


def failures(calls: DataFrame) -> DataFrame:
    """(signature, n) of failed calls so far."""
    return calls.where("error IS NOT NULL").groupBy(error_signature(F.col("error")).alias("signature")).agg(F.count("*").alias("n"))


def sessions(calls: DataFrame, gap: str = "2 minutes", late: str = "5 minutes") -> DataFrame:
    """(run_start, run_end, n) of bursts of calls with no pause longer than the gap."""
    grouped = calls.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("run_start"), F.col("w.end").alias("run_end"), "n")

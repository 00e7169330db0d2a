"""The corpus pipeline: stages that filter, clean and pack ``documents``, each written and read again.

All stages but the last take and return the columns of ``documents``; other columns are not carried. Models
are fitted on the labelled rows of the source tables (never on the held-out fifth); decisions are made on
what the stage is given. A null text counts as empty in every decision and stays null; an empty table goes
through all stages as one; texts of any length are judged and packed whole; a repeated row is judged each
time, and near_dedup keeps one of the rows that are alike: that with the least id, then the least hash over
its columns. Rows without an id are kept by every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from headwater.llm import compression, packing, secrets, simhash, toxicity
from headwater.session import discard, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under a half."""
    model = toxicity.fit_labels(*_tables(spark, sf_dir))
    return toxicity.score(docs, model, "doc_id", "text", *COLUMNS[1:]).where("score < 0.5").select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores at its threshold or above."""
    model = compression.fit_labels(*_tables(spark, sf_dir))
    return compression.score(docs, model, "doc_id", "text", *COLUMNS[1:]).where(f"score >= {compression.THRESHOLD}").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose sets of 5-word shingles link at a similarity of 0.8: the one with the smallest id."""
    return simhash.keep_one(docs).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each secret in its text replaced by its kind."""
    return secrets.redact_secrets(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in sequences of 2,048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The models of the first stages are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        discard(before)  # the source tables are not of this run's writing and stay
    return docs

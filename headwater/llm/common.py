"""Pieces that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of text that one step of a Python operator holds decoded at a time, but for one longer text.
CHUNK_BYTES = 4_000_000

#: Code points that separate words in every contract: space, \t, \n, \v, \f and \r.
SPACES = " \t\n\x0b\x0c\r"

#: Bounds of a classifier's sample: bytes of its longest text, and bytes of text of each label.
SAMPLE_LONGEST, SAMPLE_BYTES = 1 << 20, 64 << 20


def slices(batches: Iterator[pa.RecordBatch], text_at: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose text is within the budget; a longer text is a run of its own.

    The cut is made from the lengths that the batch holds, before anything is decoded.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right")))
            yield batch.slice(start, end - start)
            start = end


def chunks(batches: Iterator[pa.RecordBatch], text_at: int = 1) -> Iterator[list[list]]:
    """Columns of the slices as Python lists; a null text reads as empty."""
    for part in slices(batches, text_at):
        columns = [c.to_pylist() for c in part.columns]
        columns[text_at] = [t or "" for t in columns[text_at]]
        yield columns


def map_texts(df: DataFrame, id_col: str, text_col: str, fn: Callable, schema: str, *extra: str) -> DataFrame:
    """``mapInArrow`` over id, text and the named extra columns only, so no other column can clash or be read."""
    ship(df.sparkSession)
    return df.select(id_col, text_col, *extra).mapInArrow(fn, schema)


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the rows that no model learns labels from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", longest: int = SAMPLE_LONGEST, budget: int = SAMPLE_BYTES
) -> list[tuple[str, int]]:
    """A bounded, deterministic sample of labelled texts for fitting.

    At most ``per_class`` rows and ``budget`` bytes of text of each label come to the driver, no text of over
    ``longest`` bytes among them. Rows are taken in the order of a hash of their id, never from the held-out
    fifth; a repeated id is one row, with the least of its texts, and a repeated label is its greatest. The
    sampled ids (at most ``2 * per_class`` of them) are the broadcast side. Order: by label, then hash.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_id"))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y")).withColumn("_o", F.xxhash64("_id"))
    picked = known.where("_y = 0").orderBy("_o", "_id").limit(per_class).union(known.where("_y = 1").orderBy("_o", "_id").limit(per_class))
    short = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(F.col("_t").isNotNull() & (F.octet_length("_t") <= longest))
    single = short.join(F.broadcast(picked), "_id").groupBy("_id", "_y", "_o").agg(F.min("_t").alias("_t"))
    upto = F.sum(F.octet_length("_t")).over(W.partitionBy("_y").orderBy("_o", "_id").rowsBetween(W.unboundedPreceding, 0))
    rows = single.withColumn("_upto", upto).where(F.col("_upto") <= budget).select("_y", "_o", "_t").collect()
    return [(r["_t"], r["_y"]) for r in sorted(rows, key=lambda r: (r["_y"], r["_o"], r["_t"]))]


def give_back() -> None:
    """Return freed memory to the system, where the C library can; it would otherwise stay with the driver after a fit."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def distinct_texts(texts: list[str], keys: int = 3, width: int = 5) -> list[str]:
    """A fitting sample without copies: a text goes if it shares a least shingle hash with an earlier one."""
    seen, kept = set(), []
    for text in texts:
        words = text.encode().lower().split()
        shingles = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
        least = [(k, min(xxhash.xxh64_intdigest(s, k) for s in shingles)) for k in range(keys)]
        if not any(x in seen for x in least):
            kept.append(text)
        seen.update(least)
    return kept

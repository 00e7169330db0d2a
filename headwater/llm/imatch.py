"""I-Match fingerprints: terms of a middling document frequency, hashed over randomised lexicon subsets.

1. Document frequencies of all terms over all texts, counted in each task and summed in the engine.
2. The lexicon keeps terms found in ``LEAST_SHARE`` to ``MOST_SHARE`` of the documents. It may be
   broadcast: frequencies sum to the distinct terms of all texts, so it holds at most the mean number of
   distinct terms in a text, divided by ``LEAST_SHARE``, however many texts there are.
3. A text's distinct lexicon terms are sorted, and those in each of ``SUBSETS`` random subsets of the
   lexicon, and in the whole of it, are hashed in that order: one part of the fingerprint each. Subsets are
   of several densities, so that long and short texts both have parts with only a few terms, which survive
   edits.
4. The likeness of two fingerprints is the share of equal parts among those that either text fills.

A text without a lexicon term is fingerprinted by all its terms, and one without any term by its letters,
so equal texts always agree. A null text counts as empty. Repeated rows each get their row. The next
document is the next row by id; equal ids are ordered by a hash of the text and then the text, null ids
stand first and are ordered so too, and the first row follows the last. A range of rows is one task's, with
as many ranges to an id as its share of the rows needs; a text of any length is one row. An empty table
gives an empty result. Extra columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import chunks, map_texts

TERM = re.compile(r"[^\W\d_]+")
LEAST_SHARE, MOST_SHARE = 0.001, 0.1
SUBSETS = 60
DENSITIES = (1 / 16, 1 / 32, 1 / 64, 1 / 128, 1 / 256, 1 / 512)
FLUSH_TERMS = 400_000


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.lower())


def document_frequencies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, df): the number of texts that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

        for _, texts in chunks(batches):
            for text in texts:
                counts.update(set(terms_of(text)))
            if len(counts) > FLUSH_TERMS:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return map_texts(df, id_col, text_col, run, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> list[str]:
    """The terms of the band, in order: at most (mean distinct terms of a text) / ``least`` of them."""
    total = df.count()
    found = document_frequencies(df, id_col, text_col)
    band = found.where(F.col("df").between(max(2, least * total), max(2, most * total)))
    return sorted(r["term"] for r in band.select("term").toLocalIterator())


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Matcher:
    """Fingerprints against one lexicon; the last subset is all of it."""

    def __init__(self, terms: list[str], subsets: int = SUBSETS):
        self.code = {t: xxhash.xxh64_intdigest(t) for t in terms}
        self.seeds = mix(np.arange(1, subsets + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        density = np.array([*(DENSITIES[k % len(DENSITIES)] for k in range(subsets)), 1.0])
        self.least = (density * 2.0**32).astype(np.uint64)

    def parts(self, terms: set[str], text: str) -> np.ndarray:
        """The fingerprint's parts, 0 where a subset holds none of the terms."""
        code, digest = self.code, xxhash.xxh64_intdigest
        codes = np.array([code[t] for t in sorted(t for t in terms if t in code)], np.uint64)
        if not len(codes):  # nothing in the band: all terms, or else the text itself, fill every part
            whole = digest(" ".join(sorted(terms)) if terms else "\0" + text)
            return mix(np.uint64(whole) ^ self.seeds) | np.uint64(1)
        inside = mix(codes[:, None] ^ self.seeds) >> np.uint64(32) < self.least
        _, at = np.nonzero(inside.T)  # subset by subset, its terms in order
        held, ends = codes[at].tobytes(), (8 * np.cumsum(inside.sum(axis=0))).tolist()
        return np.array([digest(held[s:e]) | 1 if e > s else 0 for s, e in zip([0, *ends], ends, strict=False)], np.uint64)

    def fingerprint(self, text: str) -> np.ndarray:
        return self.parts(set(terms_of(text)), text)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    either = (a != 0) | (b != 0)
    n = int(either.sum())
    return float(((a == b) & either).sum() / n) if n else float(np.array_equal(a, b))


def shown(parts: np.ndarray) -> str:
    """Eight hexadecimal digits for each part."""
    return (parts >> np.uint64(32)).astype(">u4").tobytes().hex()


def edited_terms(text: str, after: str) -> tuple[set[str], set[str], str]:
    """The terms of a text and of the same with its last quarter from the next one, and that edited text.

    The part that both share is split once; the cut is moved back to a word's start for that.
    """
    share = len(text) // 4
    cut = len(text) - share
    start = cut
    while start and TERM.fullmatch(text[start - 1]):
        start -= 1
    common = set(terms_of(text[:start]))
    tail, other = text[start:], text[start:cut] + after[:share]
    return common | set(terms_of(tail)), common | set(terms_of(other)), text[:start] + other


def count_upto(values: list[int], of: Column) -> Column:
    """How many of the sorted values are at most ``of``: among every so many of them, then among those between."""
    step = max(1, isqrt(len(values)))
    upto = lambda some: F.size(F.filter(some, lambda c: c <= of))
    array = lambda some: F.array(*(F.lit(v).cast("long") for v in some)) if some else F.array().cast("array<bigint>")
    blocks = upto(array(values[step - 1 :: step]))
    return blocks * step + upto(F.slice(array(values), blocks * step + 1, F.lit(step)))


def buckets(ids: DataFrame, parts: int) -> Column:
    """The range of a row (id, h), by id and then by h: about ``parts`` ranges, several for an id with a large share."""
    total, known = ids.agg(F.count("*"), F.count("id")).first()
    marks = Counter(int(c) for c in ids.approxQuantile("id", [i / parts for i in range(parts)], 0.1 / parts)[1:])
    shares = dict(marks)
    for c, n in marks.items():
        if n > 1:
            shares.setdefault(c + 1, 1)  # the ranges of this id hold no other
    cuts = sorted(shares)
    slices = [max(1, -(-(total - known) * parts // max(total, 1))), 1, *(shares[c] for c in cuts)]
    first = [sum(slices[:k]) for k in range(len(slices))]
    place = F.when(F.col("id").isNull(), 0).otherwise(1 + count_upto(cuts, F.col("id")))
    at = lambda values: F.get(F.array(*map(F.lit, values)), place).cast("long")
    return at(first) + F.shiftright((F.shiftright("h", 33) + (1 << 30)) * at(slices), 31)


def fingerprint_with_next(df: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text", subsets: int = SUBSETS) -> DataFrame:
    """Fingerprints of texts and of their edited forms, in the order of id.

    Rows are dealt into ranges of about equal size; the first row of each range is also sent to the range
    before it (that of the first to the last), so every row meets its successor in one pass over sorted rows.
    """
    spark = df.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    own = rows.withColumn("bucket", buckets(df.select(F.col(id_col).cast("long").alias("id")), parts))
    heads = {r["bucket"]: r["head"] for r in own.groupBy("bucket").agg(F.min(F.struct("id", "h")).alias("head")).collect()}  # a row for each range
    filled = sorted(heads)
    before = dict(zip(filled, [*filled[-1:], *filled[:-1]], strict=True))
    width = max(filled, default=0) + 1
    of = lambda values: F.get(F.array(*(F.lit(v).cast("long") for v in values)), F.col("bucket"))
    head_id, head_h = (of([heads[b][c] if b in heads else None for b in range(width)]) for c in ("id", "h"))
    ahead = own.where(F.col("id").eqNullSafe(head_id) & (F.col("h") == head_h)).withColumn("bucket", of([before.get(b) for b in range(width)]))
    ahead = ahead.groupBy("bucket").agg(F.min(F.struct("id", "h", "text")).alias("head")).select("bucket", F.lit(1).alias("ahead"), "head.*")
    dealt = own.select("bucket", F.lit(0).alias("ahead"), "id", "h", "text").union(ahead)
    ordered = dealt.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket", "ahead", F.asc_nulls_first("id"), "h", "text")
    held = spark.sparkContext.broadcast(terms)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def results(matcher: Matcher, given: Iterator[pa.RecordBatch]) -> Iterator[list]:
        waiting, last = None, None  # the row whose successor comes next; the one before it, with its parts
        for columns in chunks(given, 2):
            for ahead, doc, text in zip(*columns, strict=True):
                if waiting is not None:
                    terms_own, terms_edited, edited = edited_terms(waiting[1], text)
                    own_parts, edited_parts = matcher.parts(terms_own, waiting[1]), matcher.parts(terms_edited, edited)
                    if last is not None:
                        yield [*last[0], likeness(last[1], own_parts)]
                    digest = hashlib.sha256(edited.encode()).hexdigest()
                    last = [waiting[0], len(waiting[1]), digest, shown(own_parts), shown(edited_parts), likeness(own_parts, edited_parts)], own_parts
                    if ahead:
                        yield [*last[0], likeness(own_parts, matcher.fingerprint(text))]
                        last = None
                waiting = None if ahead else (doc, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = results(Matcher(held.value, subsets), batches)
        while made := list(islice(found, 512)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names)

    out = ordered.select("ahead", "id", "text").mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)


def op3_imatch(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return fingerprint_with_next(docs, lexicon(docs))

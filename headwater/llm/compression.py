"""Quality by compression: zstandard dictionaries of good and of bad text, and their calibrated difference.

The labelled texts of each kind fill a dictionary. A text is cut into blocks of equal size, so that the
dictionaries matter as much at the end of a long text as at its start, and every block is compressed with
both. The normalised difference of the summed sizes is what tells good from bad; a logistic curve over it,
and over how much text it was measured on, makes it a score. The curve is fitted on differences of texts
that were in neither dictionary: each of ``FOLDS`` parts of the sample is measured with dictionaries of the
others.

Fitting uses at most ``per_class`` labelled texts of each label (2,000 by default; at most 1 MB each and
64 MB in all) and nothing but their text. Dictionaries take pieces from anywhere in them, in a fixed random
order, up to ``DICTIONARY_BYTES``. Scoring reads every text whole in one pass; what is broadcast is the two
dictionaries. A null or empty text scores the share of good texts. With fewer than ``FOLDS`` distinct texts
of a label in the sample there is nothing to fit, and every text scores that share (0.5 with no labels at
all). Repeated rows each get their row, ties need no order, a text of any length is one row, a null id stays
null, an empty table gives an empty result, and extra columns are never read.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_texts, give_back, held_out, labelled_sample, map_texts, slices

BLOCK = PIECE = 1024
DICTIONARY_BYTES = 1 << 20
LEVEL = 12
FOLDS = 4
FULL_LENGTH = 1000  # bytes from which on a difference counts in full
PER_CLASS = 2000
THRESHOLD = 0.3


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float


def blocks(raw: bytes) -> list[bytes]:
    """Blocks of nearly equal size, BLOCK bytes at most."""
    n = -(-len(raw) // BLOCK)
    return [raw[len(raw) * i // n : len(raw) * (i + 1) // n] for i in range(n)]


@functools.lru_cache(maxsize=1)
def _compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    """The pair last asked for is kept; it takes some twenty times its dictionaries."""
    made = []
    for content in (good, bad):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_dict_id=False))
    return made


def difference(text: str, good: bytes, bad: bytes) -> tuple[float, int]:
    """The normalised difference of the compressed sizes, greater for good text, and the text's bytes."""
    raw = text.encode()
    parts = blocks(raw)
    by_good, by_bad = (sum(len(c.compress(p)) for p in parts) for c in _compressors(good, bad))
    return (by_bad - by_good) / (by_bad + by_good), len(raw)


def expand(measured: list[tuple[float, int]]) -> np.ndarray:
    """A constant, the difference, and how much text there is with the difference's share of that."""
    found = np.array(measured, float)
    d, share = found[:, 0] * 10, np.minimum(found[:, 1] / FULL_LENGTH, 1)
    return np.column_stack([np.ones(len(d)), d, d * share, share])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton's method with a ridge on all but the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[str], seed: int) -> bytes:
    """Raw dictionary content: pieces of the texts in a fixed random order, as many as fit."""
    pieces = [raw[s : s + PIECE] for raw in map(str.encode, texts) for s in range(0, len(raw), PIECE)]
    random.Random(seed).shuffle(pieces)
    out = bytearray()
    for piece in pieces:
        if len(out) + len(piece) <= DICTIONARY_BYTES:
            out += piece
    return bytes(out)


def fit(sample: list[tuple[str, int]], good_share: float | None = None) -> CompressionModel:
    """A model from (text, label) rows in a fixed order; ``good_share`` is the share of label 1 to calibrate for."""
    by = {y: distinct_texts([t for t, label in sample if label == y and t]) for y in (0, 1)}
    share = good_share if good_share is not None else (sum(y for _, y in sample) / len(sample) if sample else 0.5)
    if min(map(len, by.values())) < FOLDS:
        return CompressionModel(b"", b"", (), share)
    measured, labels = [], []
    for k in range(FOLDS):
        good, bad = (_dictionary([t for i, t in enumerate(by[y]) if i % FOLDS != k], y) for y in (1, 0))
        for y in (0, 1):
            own = by[y][k::FOLDS]
            measured += [difference(t, good, bad) for t in own]
            labels += [y] * len(own)
        _compressors.cache_clear()  # before the next pair is made, and before the driver goes on
    y = np.array(labels, float)
    weights = logistic(expand(measured), y, 0.1)
    odds = lambda p: np.log(max(p, 1e-3) / max(1 - p, 1e-3))
    weights[0] += odds(share) - odds(y.mean())  # the sample's classes are not as frequent as the corpus's
    return CompressionModel(_dictionary(by[1], 1), _dictionary(by[0], 0), tuple(map(float, weights)), share)


def score_texts(texts: list[str], model: CompressionModel) -> np.ndarray:
    out = np.full(len(texts), model.prior)
    full = [i for i, t in enumerate(texts) if t] if model.weights else []
    if full:
        x = expand([difference(texts[i], model.good, model.bad) for i in full])
        out[full] = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))
    return out


def fit_labels(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> CompressionModel:
    """Fit on the bounded sample; the share of each label is counted over all learnable labels."""
    counts = dict(labels.where(F.col(label).isin(0, 1) & ~held_out()).groupBy(F.col(label).cast("int")).count().collect())
    total = sum(counts.values())
    model = fit(labelled_sample(docs, labels, label, per_class), counts.get(1, 0) / total if total else 0.5)
    give_back()
    return model


def score(df: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """(id, the kept columns, score), one row for each input row."""
    held = df.sparkSession.sparkContext.broadcast(model)
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in (id_col, *keep)) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            kept = [batch.column(0), *(batch.column(2 + i) if c != text_col else batch.column(1) for i, c in enumerate(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score_texts(texts, held.value))], [id_col, *keep, "score"])

    return map_texts(df, id_col, text_col, run, schema, *keep)


def op7_compression_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit_labels(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

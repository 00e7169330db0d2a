"""Language-model scoring by cross-entropy difference.

Two bigram models of one order, one smoothing and one vocabulary: the target model counts texts of the
wanted kind (by default the documents labelled as of good quality), the background model counts all
texts. A text's score is its loss a token under the target model less that under the background model;
lower is more like the target.

P(w | v) = (c(v, w) + K * P(w)) / (c(v) + K) and P(w) = (c(w) + 1) / (N + V). A text with words is read as
a border, its words and a border again, and every symbol but the first is predicted, so the border is a
symbol of the vocabulary, each symbol has as many successors as occurrences, and the probabilities of
what follows any symbol sum to 1. A text's own counts are taken out of each model that holds them before
it is scored, so a labelled text gains nothing from its label.

Every word and every pair of all texts counts, however rare. Texts are dealt by a hash into as many chunks
as there is text for. A chunk counts its words and pairs and sends the sorted keys, 64-bit hashes of a word
or of two, to the ranges of keys; a range adds up what all chunks sent and sends the sums back in the order
that they came. No task or driver holds a model: a chunk holds its own keys, and a range what was sent to
it. A chunk sends a key once, so no word is a large group, and a row's chunk follows from its id and text,
so it is the same in every run of a task and copies under different ids are dealt apart.

A null or empty text, or one without words, has no tokens, and null losses and score. Without any target
text the target model is the smoothed uniform one. Repeated rows count again and each get their row; ties
need no order. A text of ``LONG`` code points or more is a chunk of its own, and is scored whole. A null id
stays null and is never a target. An empty table gives an empty result. Extra columns are never read.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, ship

STRENGTH = 2.0
#: Code points of text for each chunk and for each range of keys, and in a text that is a chunk alone.
CHUNK_CHARS, RANGE_CHARS, LONG = 2_000_000, 4_000_000, 1 << 18
BORDER = 0
WORDS, PAIRS, TARGET, TOTAL = 0, 1, 2, 3


def tokens_of(text: str) -> list[str]:
    return text.lower().split()


def target_ids(labels: DataFrame, label: str = "quality", value: int = 1, id_col: str = "doc_id") -> DataFrame:
    """The ids whose label has the value, each once."""
    return labels.where((F.col(label) == value) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()


class Encoded:
    """Texts' words by numbers of their own, from 1; number 0 is the border before and after a text."""

    def __init__(self, texts: list[str]):
        index = defaultdict(count(1).__next__)
        ids = [[index[w] for w in tokens_of(t)] for t in texts]
        self.lengths = np.array([len(i) for i in ids], np.int64)
        self.predicted = self.lengths + (self.lengths > 0)
        self.doc = np.repeat(np.arange(len(ids)), self.predicted)
        self.second = np.fromiter((w for i in ids if i for w in (*i, BORDER)), np.int64, int(self.predicted.sum()))
        first = np.concatenate([[BORDER], self.second])[:-1]
        self.keys = np.array([0, *(xxhash.xxh64_intdigest(w) for w in index)], np.uint64)
        self.kinds, self.place = np.unique(first << 32 | self.second, return_inverse=True)

    def pair_keys(self) -> np.ndarray:
        return self.keys[self.kinds >> 32] * np.uint64(0x9E3779B97F4A7C15) + self.keys[self.kinds & 0xFFFFFFFF] * np.uint64(0xC2B2AE3D27D4EB4F)

    def counts(self, wanted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, counts, counts in target texts) of the words and of the pairs."""
        weight = wanted.astype(float)[self.doc]
        out = []
        for keys, place in ((self.keys, self.second), (self.pair_keys(), self.place)):
            out.append((keys, np.bincount(place, minlength=len(keys)), np.bincount(place, weight, len(keys)).astype(np.int64)))
        return out

    def losses(self, words: np.ndarray, pairs: np.ndarray, own: np.ndarray, total: int, size: int) -> np.ndarray:
        """Each text's loss a token. words, pairs: counts by number; own: 1 where the text is in the counts, and is taken out."""
        wide, many = len(self.keys), len(self.kinds)
        kinds, times = np.unique(self.doc * many + self.place, return_counts=True)
        doc, pair = kinds // many, kinds % many
        held, held_times = np.unique(self.doc * wide + self.second, return_counts=True)
        first, second = self.kinds[pair] >> 32, self.kinds[pair] & 0xFFFFFFFF
        mine = lambda symbol: own[doc] * held_times[np.searchsorted(held, doc * wide + symbol)]
        single = (words[second] - mine(second) + 1) / (total - own[doc] * self.predicted[doc] + size)
        loss = -np.log((pairs[pair] - own[doc] * times + STRENGTH * single) / (words[first] - mine(first) + STRENGTH))
        return np.bincount(doc, loss * times, len(self.lengths)) / np.maximum(self.predicted, 1)


def by_bytes(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones and so on, so that small numbers compress to little."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_bytes(raw: bytes, kind: str, size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, size).T).view(kind).ravel()


def texts_of(texts: pa.Table, told: pa.Table) -> tuple[list[str], np.ndarray]:
    """A chunk's texts, and which of them are targets."""
    known = set(told.filter(pc.equal(told["kind"], TARGET))["part"].to_pylist())
    return [t or "" for t in texts["text"].to_pylist()], np.array([i in known for i in texts["id"].to_pylist()], bool)


def targets_by_chunk(chunked: DataFrame, targets: DataFrame) -> DataFrame:
    """(chunk, part, kind, size, sums): the target ids of each chunk, as its part; only ids are shuffled."""
    own = chunked.select("chunk", "id").join(targets, "id").distinct()
    return own.select("chunk", F.col("id").alias("part"), F.lit(TARGET).alias("kind"), F.lit(0).alias("size"), F.lit(None).cast("binary").alias("sums"))


def sent_counts(chunked: DataFrame, targets: DataFrame, ranges: int) -> DataFrame:
    """(part, chunk, kind, size, sent): each chunk's keys and counts of one range; kind WORDS or PAIRS."""
    names = ["part", "chunk", "kind", "size", "sent"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        texts, wanted = texts_of(left, right)
        made, rows = Encoded(texts), []
        for kind, (keys, n, target) in enumerate(made.counts(wanted) if len(made.second) else ()):
            order = np.argsort(keys)
            keys, n, target = keys[order], n[order], target[order]
            part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            cuts = [*np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                gaps = np.diff(keys[s:e], prepend=np.uint64(0))
                sent = by_bytes(gaps) + by_bytes(n[s:e].astype(np.uint32)) + by_bytes(target[s:e].astype(np.uint32))
                rows.append((int(part[s]), key[0].as_py(), kind, e - s, sent))
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    sides = chunked.groupBy("chunk").cogroup(targets.groupBy("chunk"))
    return sides.applyInArrow(run, "part long, chunk long, kind int, size int, sent binary")


def summed_counts(sent: DataFrame) -> DataFrame:
    """(chunk, part, kind, size, sums): the sums of the keys that a chunk sent, in the order that it sent them.

    A row without a chunk has the range's number of words and its sums of both counts instead.
    """
    names = ["chunk", "part", "kind", "size", "sums", "words", "n", "n_target"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 3]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part, rows = key[0].as_py(), []
        chunk, kind, size = (table[c].to_numpy() for c in ("chunk", "kind", "size"))
        for one in (WORDS, PAIRS):
            own = np.flatnonzero(kind == one).tolist()
            if not own:
                continue
            sizes = size[own]
            held = [table["sent"][k].as_py() for k in own]
            keys = np.concatenate([np.cumsum(from_bytes(r[: 8 * m], "<u8", m)) for r, m in zip(held, sizes, strict=True)])
            distinct, place = np.unique(keys, return_inverse=True)
            sums = []
            for at in (8, 12):
                weight = np.concatenate([from_bytes(r[at * m : (at + 4) * m], "<u4", m) for r, m in zip(held, sizes, strict=True)])
                sums.append(np.bincount(place, weight, len(distinct)).astype(np.int64))
            ends = np.cumsum(sizes)
            for k, s, e in zip(own, ends - sizes, ends, strict=True):
                rows.append((int(chunk[k]), part, one, int(e - s), b"".join(by_bytes(x[place[s:e]]) for x in sums), None, None, None))
            if one == WORDS:
                rows.append((None, part, one, 0, None, len(distinct), *(int(x.sum()) for x in sums)))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return sent.groupBy("part").applyInArrow(run, "chunk long, part long, kind int, size int, sums binary, words long, n long, n_target long")


def score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score), one row for each row; tokens are words, losses count the closing border too.

    targets: (id) of the texts that the target model counts, each once.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size, mark = F.coalesce(F.length("text"), F.lit(0)), F.xxhash64("id", "text")
    chars = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n_chunks, ranges = 1 + chars // CHUNK_CHARS, 1 + chars // RANGE_CHARS
    alone = -1 - F.pmod(mark, F.lit((1 << 62) - 1))
    chunked = rows.withColumn("chunk", F.when(size >= LONG, alone).otherwise(F.pmod(mark, F.lit(n_chunks))))
    told = checkpoint(targets_by_chunk(chunked, targets))
    known = summed_counts(sent_counts(chunked, told, ranges))
    # one row of totals, told to each chunk: what its sums come from is one plan, so the texts are dealt to chunks once
    total = known.where("chunk IS NULL").agg(F.concat(*(F.unhex(F.lpad(F.hex(F.coalesce(F.sum(c), F.lit(0))), 16, "0")) for c in ("words", "n", "n_target"))).alias("sums"))
    totals = chunked.select("chunk").distinct().select("chunk", F.lit(0).cast("long").alias("part"), F.lit(TOTAL).alias("kind"), F.lit(0).alias("size"), total.scalar().alias("sums"))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        texts, wanted = texts_of(left, right)
        made, losses = Encoded(texts), [np.zeros(len(texts))] * 2
        if len(made.second):
            right = right.sort_by([("kind", "ascending"), ("part", "ascending")])
            kind, sizes, held = right["kind"].to_numpy(), right["size"].to_numpy(), right["sums"].to_pylist()
            kinds, *sums = np.frombuffer(held[int(np.flatnonzero(kind == TOTAL)[0])], ">i8").astype(np.int64).tolist()
            every, target = [], []
            for one, keys in ((WORDS, made.keys), (PAIRS, made.pair_keys())):
                own = np.flatnonzero(kind == one).tolist()
                order = np.argsort(keys)
                for out, at in ((every, 0), (target, 8)):
                    counts = np.empty(len(keys), np.int64)
                    counts[order] = np.concatenate([from_bytes(held[k][at * sizes[k] : (at + 8) * sizes[k]], "<i8", sizes[k]) for k in own])
                    out.append(counts)
            losses = [made.losses(*c, o, total, kinds) for c, o, total in zip((target, every), (wanted.astype(int), np.ones(len(texts), int)), sums[::-1], strict=True)]
        empty = made.lengths == 0
        columns = [pa.array(x, mask=empty) for x in (*losses, losses[0] - losses[1])]
        return pa.table([left["id"], pa.array(made.lengths), *columns], names=[id_col, "n_tokens", "target_loss", "background_loss", "score"])

    every_told = told.unionByName(totals).unionByName(known.where("chunk IS NOT NULL").select("chunk", "part", "kind", "size", "sums"))
    sides = chunked.groupBy("chunk").cogroup(every_told.groupBy("chunk"))
    return sides.applyInArrow(run, f"`{id_col}` long, n_tokens long, target_loss double, background_loss double, score double")


def op6_cross_entropy_difference(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, target_ids(labels))

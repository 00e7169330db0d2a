"""Best-fit packing of token sequences, planned over the histogram of lengths.

1. Every text is encoded once, where it is read; what leaves the task is a row for each piece (id, place,
   length, checksum), never the tokens.
2. The lengths' histogram has at most ``capacity`` rows. Best-fit decreasing runs over its counts: all
   pieces of one length take slots in runs of equal sequences, so the plan's size depends on the number
   of lengths and not on the number of documents.
3. A piece's rank within its length is the number of that length in earlier tasks plus its place in its
   own task. Both come from the written pieces; no length is sorted or gathered in one task.
4. Pieces take the planned slots by rank within length.

A null or empty text is the single end token. A text longer than the capacity is cut from its end, so
every piece but the first is full. Repeated rows are packed each for itself, equal lengths take slots in
the order of task and row. Any number of long texts is fine: the largest state is one text's tokens. A
null id stays null. An empty table has no pieces. Extra columns are never read.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint, ship
from .common import chunks, map_texts

CAPACITY = 2048
END_ID = 0

#: The special token that the JSON form of the vocabulary recognises in raw text.
SPECIAL = {"<|endoftext|>": 50256}


@functools.cache
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary from its rank file, with the special token read as the JSON form reads it."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


SPECIAL_SPLIT = re.compile("|".join(map(re.escape, SPECIAL)))

#: Fixed value: the code points with the White_Space property.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 1 << 16
BLANKS = re.compile(f"[{WHITE_SPACE}]{{{LONG_RUN},}}")


def ordinary(coder: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text without special tokens; long blank runs, which the coder's pattern can't take, are cut out.

    By the rule of the vocabulary a blank run is one piece, but for its last character where a word follows.
    """
    if len(text) < LONG_RUN:
        return coder.encode_ordinary(text)
    ids, at = [], 0
    for m in BLANKS.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        ids += coder.encode_ordinary(text[at : m.start()])
        ids += coder._encode_single_piece(text[m.start() : end])
        at = end
    return ids + coder.encode_ordinary(text[at:])


def encode(coder: tiktoken.Encoding, text: str) -> list[int]:
    if "<|" not in text or not SPECIAL_SPLIT.search(text):
        return ordinary(coder, text)
    ids, at = [], 0
    for m in SPECIAL_SPLIT.finditer(text):
        ids += [*ordinary(coder, text[at : m.start()]), SPECIAL[m[0]]]
        at = m.end()
    return ids + ordinary(coder, text[at:])


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth): nth counts the pieces of one length in one task."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for ids, texts in chunks(batches):
            rows = []
            for doc, text in zip(ids, texts, strict=True):
                tokens = np.array([*encode(coder, text), END_ID], "<u4")
                cut = len(tokens) % capacity or capacity
                for piece, start in enumerate(range(cut - capacity if cut < capacity else 0, len(tokens), capacity)):
                    own = tokens[max(start, 0) : start + capacity]
                    seen[len(own)] += 1
                    rows.append((doc, piece, max(start, 0), len(own), zlib.crc32(own), part, seen[len(own)] - 1))
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return map_texts(df, id_col, text_col, run, "id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, ranks, first sequence, per sequence, offset).

    Ranks ``first .. first + ranks - 1`` of that length go to consecutive sequences, ``per sequence`` to
    each, side by side from ``offset`` on. The open sequences are kept as runs with equal room, so one
    step places a whole run's worth of pieces. Sequences are numbered from 0.
    """
    rows, total = [], 0
    room_of: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, sequences)
    rooms: list[int] = []

    def give(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in room_of:
                insort(rooms, room)
                room_of[room] = []
            room_of[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # no open sequence has room
                first, each, n, room = total, capacity // length, -(-left // (capacity // length)), capacity
                total += n
            else:
                room = rooms[at]
                first, n = room_of[room].pop()
                if not room_of[room]:
                    del room_of[room], rooms[at]
                each = room // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, full * each, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                give(room - each * length, first, full)
            rest = min(left, each) if full < n else 0
            if rest:  # the last pieces of this length share one sequence
                rows.append((length, rank, rest, first + full, each, capacity - room))
                rank, left, full = rank + rest, left - rest, full + 1
                give(room - rest * length, first + full - 1, 1)
            give(room, first + full, n - full)
    return rows


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece."""
    spark = df.sparkSession
    ship(spark)
    made = checkpoint(pieces(df, id_col, text_col, vocabulary, capacity))
    by_part = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = dict(by_part.groupBy("length").agg(F.sum("n")).collect())  # at most `capacity` rows
    slots = np.array(plan(counts, capacity), np.int64).reshape(-1, 6)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    lengths, firsts = slots[:, 0], slots[:, 1]
    begin = np.searchsorted(lengths, np.arange(capacity + 2))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch["length"].to_numpy()
            rank = batch["nth"].to_numpy() + batch["before"].to_numpy()
            slot = np.empty(len(length), np.int64)
            for size in np.unique(length):
                own = length == size
                s, e = begin[size], begin[size + 1]
                slot[own] = s + np.searchsorted(firsts[s:e], rank[own], side="right") - 1
            nth = rank - firsts[slot]
            sequence = slots[slot, 3] + nth // slots[slot, 4]
            offset = slots[slot, 5] + nth % slots[slot, 4] * length
            keep = [batch[c] for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = made.join(before, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", "nth", "before")
    out = placed.mapInArrow(take, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

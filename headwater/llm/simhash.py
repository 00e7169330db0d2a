"""SimHash fingerprints and near-duplicate groups by tiled exact comparison.

Distinct fingerprints are dealt into tiles by their population count: small counts share a tile, and a
count with more than one tile's worth is split by a hash. Two fingerprints within the radius have
population counts within the radius, so tile pairs further apart are skipped; each other one is numpy
exclusive-or and bit counts, block by block. Inside a pair, blocks ordered by the population count of the
first half are skipped the same way, and a fingerprint's last words are compared only where its first
ones leave room. A tile pair returns a least spanning forest of its links, fewer rows than it has
fingerprints, so a group of near copies never becomes all its pairs. Components are joined up in the engine.

The comparison is exact and therefore still quadratic in the number of *distinct* fingerprints, divided
by what the population counts exclude. Memory of a task is two tiles and one block, at any input size.

The query's fingerprints have 64 bits of all 3-word shingles, and link at 3 bits. ``keep_one``, for the
pipeline, takes 256 bits of the distinct 5-word shingles and confirms links by the sets themselves, at a
similarity of 0.8 or more: those of the forest first, and then, where some of them fail, every other pair
within the radius whose ends are still apart.

A null text counts as empty; an empty text (no words) has fingerprint zero and links like any other, and
a text of fewer words than a shingle is one shingle. Equal fingerprints are one group before any
comparison. A null id keeps its row and names no group: it takes the smallest id of its group, null where
the group has none, and its links count. Repeated rows keep their number. Very long texts are hashed in
pieces of bounded size. An empty table gives an empty result. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice
from math import acos, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, ship
from .common import chunks, map_texts, slices
from .components import connected_components

LANE = 64
SEED = 42
STEP = 1 << 15


def shingles(text: str, width: int) -> Iterable[bytes]:
    """Shingles of the words, repeats included; the whole sequence where there are fewer words; none for none."""
    words = text.encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII separators
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return map(b" ".join, zip(*(islice(words, i, None) for i in range(width)), strict=False))


def fingerprint(text: str, width: int = 3, lanes: int = 1, repeats: bool = True) -> bytes:
    """The SimHash of 64 bits a lane, big-endian; repeats: a shingle counts as often as it occurs."""
    grams = iter(shingles(text, width) if repeats else set(shingles(text, width)))
    digest, count, ones = xxhash.xxh64_intdigest, 0, np.zeros((lanes, LANE), np.int64)
    while part := list(islice(grams, STEP)):
        count += len(part)
        for lane in range(lanes):
            hashes = np.fromiter((digest(g, SEED + lane) for g in part), ">u8", len(part))
            ones[lane] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > count).tobytes()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, lanes: int = 1, repeats: bool = True, *keep: str) -> DataFrame:
    """(id, fp binary, the kept columns), one row for each input row."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(["id long", "fp binary", *(f"`{c}` {fields[c]}" for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, *kept in chunks(batches):
            made = pa.array([fingerprint(t, width, lanes, repeats) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), made, *map(pa.array, kept)], ["id", "fp", *keep])

    return map_texts(df, id_col, text_col, run, schema, *keep)


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the sets of i[k] and j[k] in place, root[x] being the least of x's set; the places k that joined two sets."""
    left, joined = np.arange(len(i)), []
    while True:
        a, b = root[i[left]], root[j[left]]
        apart = a != b
        left, a, b = left[apart], a[apart], b[apart]
        if not len(left):
            return np.concatenate([np.zeros(0, np.int64), *joined])
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((low, high))
        ends, at = np.unique(high[order], return_index=True)  # each root but the least hooks to one lower root
        chosen = order[at]
        root[ends] = low[chosen]
        joined.append(left[chosen])
        while True:
            nearer = root[root]
            if np.array_equal(nearer, root):
                break
            root[:] = nearer


def forest(size: int, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places of the links that make a spanning forest, the nearest pairs first."""
    root, taken = np.arange(size), np.zeros(len(i), bool)
    for bits in np.unique(apart):
        own = np.flatnonzero(apart == bits)
        taken[own[unite(root, i[own], j[own])]] = True
    return np.flatnonzero(taken)


def bits_of(prints: np.ndarray) -> np.ndarray:
    """Set bits of each fingerprint of (rows, lanes)."""
    return np.bitwise_count(prints).sum(axis=1, dtype=np.int64)


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int, block: int = 512, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): a least spanning forest of the links of two tiles, (rows, lanes) each; within left where right is None.

    i and j count left's rows and then right's. Links beyond ``most`` are reduced to their forest as they come.
    """
    every = left if right is None else np.concatenate([left, right])
    lanes = every.shape[1]
    high = bits_of(every[:, : lanes // 2] if lanes > 1 else every >> np.uint64(LANE // 2))
    first = np.argsort(high[: len(left)], kind="stable")
    second = first if right is None else np.argsort(high[len(left) :], kind="stable") + len(left)
    columns = np.ascontiguousarray(every.T)
    # lanes to compare at once: as many as leave unrelated pairs beyond the radius
    early = next((k for k in range(1, lanes) if 32 * k - 12 * k**0.5 > radius), lanes)
    kind = np.uint8 if early < 4 else np.uint16
    apart, bits, total = np.empty((block, block), np.uint64), np.empty((block, block), np.uint8), np.empty((block, block), kind)
    found, waiting = [np.zeros(0, np.int64)] * 3, []

    def reduce() -> list[np.ndarray]:
        i, j, d = (np.concatenate([f, *w]) for f, w in zip(found, zip(*waiting, strict=True), strict=True)) if waiting else found
        kept = forest(len(every), i, j, d)
        waiting.clear()
        return [i[kept], j[kept], d[kept]]

    for s in range(0, len(first), block):
        a = first[s : s + block]
        for t in range(s if right is None else 0, len(second), block):
            b = second[t : t + block]
            if high[b[0]] - high[a[-1]] > radius:
                break
            if high[a[0]] - high[b[-1]] > radius:
                continue
            own = np.s_[: len(a), : len(b)]
            for lane in range(early):
                np.bitwise_xor(columns[lane][a][:, None], columns[lane][b][None, :], out=apart[own])
                if lane:
                    np.bitwise_count(apart[own], out=bits[own])
                    total[own] += bits[own]
                else:
                    np.bitwise_count(apart[own], out=total[own])
            i, j = np.divmod(np.flatnonzero(total[own] <= radius), len(b))
            i, j = a[i], b[j]
            d = bits_of(every[i] ^ every[j])
            near = (d <= radius) & ((i < j) if right is None and s == t else True)
            if near.any():
                waiting.append((i[near], j[near], d[near]))
                if sum(len(w[0]) for w in waiting) > most:
                    found = reduce()
    i, j, _ = reduce()
    return i, j


def tiles(sizes: dict[int, int], bits: int, tile: int) -> list[tuple[int, int, int]]:
    """(first tile, number of tiles, group) of each population count: neighbours share a tile while they fit into one."""
    out, number, group, room = [], 0, -1, 0
    for p in range(bits + 1):
        n = sizes.get(p, 0)
        if n > tile:
            group, room = group + 1, 0
            out.append((number, -(-n // tile), group))
            number += -(-n // tile)
        else:
            if n > room or group < 0 or (out and out[-1][1] > 1):
                group, room = group + 1, tile
                number += 1
            room -= n
            out.append((number - 1, 1, group))
    return out


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each run of equal numbers in the key columns."""
    held, key = [], None
    for batch in batches:
        values = np.stack([batch[k].to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            if held and key != values[:, s].tolist():
                yield pa.Table.from_batches(held)
                held = []
            key = values[:, s].tolist()
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def near_links(nodes: DataFrame, radius: int = 3, tile: int = 65_536, lanes: int = 1) -> DataFrame:
    """(u, v): links between distinct fingerprints, a least spanning forest of every tile pair's.

    ``nodes``: (fp), each once. ``tile`` is the aimed number of fingerprints in a tile.
    """
    spark = nodes.sparkSession
    ship(spark)
    bits = LANE * lanes
    words = [F.conv(F.substring(F.hex("fp"), 16 * k + 1, 16), 16, -10).cast("long") for k in range(lanes)]
    nodes = nodes.select("fp", sum(map(F.bit_count, words), F.lit(0)).cast("int").alias("pop"))
    sizes = dict(nodes.groupBy("pop").count().collect())  # at most bits + 1 rows
    placed = tiles(sizes, bits, tile)
    low_of = {}  # the least and the greatest population count of a tile's group
    for p, (_, _, group) in enumerate(placed):
        low_of.setdefault(group, [p, p])[1] = p
    first = [n for n, _, _ in placed]
    spans = []  # of each population count: the tiles within reach of any count of its group
    for _, _, group in placed:
        least, most = low_of[group]
        a, b = max(least - radius, 0), min(most + radius, bits)
        spans.append((first[a], first[b] + placed[b][1] - 1))
    at = lambda values: F.get(F.array(*map(F.lit, values)), F.col("pop")).cast("long")
    own = nodes.withColumn("tile", at(first) + F.pmod(F.xxhash64("fp"), at([n for _, n, _ in placed])))
    dealt = own.withColumn("other", F.explode(F.sequence(at([a for a, _ in spans]), at([b for _, b in spans]))))
    dealt = dealt.select(F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), (F.col("tile") > F.col("other")).alias("second"), "fp")
    # pairs go round the partitions in turn: a's number times the widest reach, plus b's distance from it
    reach = max(b - a + 1 for a, b in spans)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartitionById(parts, F.pmod(F.col("a") * reach + F.col("b") - F.col("a"), F.lit(parts)).cast("int"))
    dealt = dealt.sortWithinPartitions("a", "b", "second", "fp")

    def compare(table: pa.Table) -> pa.RecordBatch:
        held_fps = table["fp"].to_pylist()
        prints = np.frombuffer(b"".join(held_fps), ">u8").astype(np.uint64).reshape(-1, lanes)
        cut = len(table) - int(table["second"].to_numpy().sum())
        same = table["a"][0] == table["b"][0]
        i, j = tile_links(prints[:cut], None if same else prints[cut:], radius)
        return pa.RecordBatch.from_arrays([pa.array([held_fps[k] for k in ends.tolist()], pa.binary()) for ends in (i, j)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(compare, runs(batches, "a", "b"))

    return dealt.mapInArrow(run, "u binary, v binary")


def grouped(nodes: DataFrame, links: DataFrame, value: str) -> DataFrame:
    """(fp, least): the least value of each fingerprint's group. nodes: (fp, value), each fp once; links: (u, v)."""
    found = connected_components(links).withColumnRenamed("node", "fp")
    rooted = checkpoint(nodes.join(found, "fp", "left").select("fp", value, F.coalesce("component", "fp").alias("root")))
    return rooted.join(rooted.groupBy("root").agg(F.min(value).alias("least")), "root").select("fp", "least")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, tile: int = 65_536, lanes: int = 1, repeats: bool = True) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at most ``radius`` bits."""
    prints = checkpoint(fingerprints(df, id_col, text_col, width, lanes, repeats))
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("node")))
    classes = grouped(nodes, near_links(nodes, radius, tile, lanes), "node").select("fp", F.col("least").alias("component"))
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component")


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def radius_of(similarity: float, bits: int, slack: float = 3.0) -> int:
    """The differing bits that two sets of this similarity are expected to have, and ``slack`` standard deviations.

    Sets of equal size and similarity s have the cosine 2s / (1 + s), and a bit differs with the angle's share of pi.
    """
    share = acos(2 * similarity / (1 + similarity)) / pi
    return round(bits * share + slack * (bits * share * (1 - share)) ** 0.5)


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(fp, grams): the sorted 64-bit hashes of a text's distinct shingles, one row for each fingerprint. texts: (fp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for part in slices(batches):
            made = [np.unique(np.fromiter((digest(g, SEED) for g in shingles(t or "", width)), np.uint64)).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], ["fp", "grams"])

    return texts.mapInArrow(run, "fp binary, grams binary").groupBy("fp").agg(F.min("grams").alias("grams"))


def similar(a: pa.BinaryScalar, b: pa.BinaryScalar, similarity: float) -> bool:
    """Whether two sets of hashes have at least that Jaccard similarity; two empty ones have."""
    x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def similar_enough(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (u, v) whose sets have at least that similarity. sets: (fp, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            true = [similar(a, b, similarity) for a, b in zip(part.column("a"), part.column("b"), strict=True)]
            yield part.select(["u", "v"]).filter(pa.array(true, pa.bool_()))

    left, right = sets.select(F.col("fp").alias("u"), F.col("grams").alias("a")), sets.select(F.col("fp").alias("v"), F.col("grams").alias("b"))
    return links.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary")


def links_between(links: DataFrame, sure: DataFrame, sets: DataFrame, radius: int, similarity: float, lanes: int, block: int) -> DataFrame:
    """(u, v): what else joins the classes that the ``sure`` ones of the links make: similar pairs within the radius, as a forest of each block pair.

    All pairs within the radius lie inside components of the links, so only components of several classes are
    left, and of their pairs those between classes, one end of which is outside the component's largest class.
    Members are dealt into blocks, and so are those outside; every block of the first meets every one of the second.
    """
    spark = links.sparkSession
    whole, own = connected_components(links), connected_components(sure).withColumnRenamed("component", "own")
    members = checkpoint(whole.join(own, "node", "left").select(F.col("node").alias("fp"), "component", F.coalesce("own", "node").alias("own")))
    sizes = members.groupBy("component", "own").agg(F.count("*").alias("n")).groupBy("component").agg(F.sum("n").alias("n"), F.max(F.struct("n", "own")).alias("most"))
    split = sizes.where("n > most.n AND n > 2")  # the only link of two has been tried
    count = lambda n: F.ceil(n / block).cast("long")
    at = lambda n: F.pmod(F.xxhash64("fp"), n)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    held = members.join(split, "component").select(F.xxhash64("component").alias("c"), "fp", "own", (F.col("own") != F.col("most.own")).alias("minor"), count(F.col("n")).alias("p"), count(F.col("n") - F.col("most.n")).alias("q"))
    held = checkpoint(held)
    first = held.select("c", at(F.col("p")).alias("a"), upto(F.col("q")).alias("b"), F.lit(False).alias("second"), "fp", "own", "minor")
    second = held.where("minor").select("c", upto(F.col("p")).alias("a"), at(F.col("q")).alias("b"), F.lit(True).alias("second"), "fp", "own", "minor")
    dealt = first.union(second).join(sets, "fp")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "c", "a", "b").sortWithinPartitions("c", "a", "b", "second", "fp")

    def compare(table: pa.Table) -> pa.RecordBatch:
        fps, grams = table["fp"].to_pylist(), table["grams"]
        prints = np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(-1, lanes)
        minor, cut = table["minor"].to_pylist(), len(table) - sum(table["second"].to_pylist())
        codes: dict[bytes, int] = {}
        classes = np.array([codes.setdefault(x, len(codes)) for x in table["own"].to_pylist()])
        root, found = list(range(len(codes))), []

        def end(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        apart = np.bitwise_count(prints[:cut, None] ^ prints[None, cut:]).sum(axis=2, dtype=np.int64)
        i, j = np.nonzero((apart <= radius) & (classes[:cut, None] != classes[None, cut:]))
        order = np.argsort(apart[i, j], kind="stable")
        for x, y in zip(i[order].tolist(), (j[order] + cut).tolist(), strict=True):
            if minor[x] and fps[x] > fps[y]:
                continue  # this pair's other order is tried too
            a, b = end(classes[x]), end(classes[y])
            if a != b and similar(grams[x], grams[y], similarity):
                root[b] = a
                found.append((fps[x], fps[y]))
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(compare, runs(batches, "c", "a", "b"))

    return dealt.mapInArrow(run, "u binary, v binary")


def sent_whole(side: DataFrame, most: int = 100_000) -> DataFrame:
    """The side of a join, marked to be sent to every task where it has few rows, so that the other side's texts stay in place."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, lanes: int = 4, tile: int = 65_536, block: int = 256) -> DataFrame:
    """The columns of ``docs``: of each group the row with the smallest id, once; rows without an id stay.

    Two texts are linked if their sets of distinct shingles have the similarity and their fingerprints differ by at
    most ``radius_of``. A least spanning forest of all pairs within the radius is tried first, so a group of near
    copies has only as many links as texts. Where some of a component's links fail, all its pairs within the radius
    between the classes made so far are tried (``links_between``): no pair within the radius is left out.

    Groups are of fingerprints, not of ids, so an id with two texts that are no near copies keeps both. Of equal
    ids in one group the row whose hash over all columns is least stays, so the choice is the same in every run.
    """
    marked = docs.where(F.col(id_col).isNotNull()).withColumn("_mark", F.xxhash64(*(x for c in docs.columns for x in (F.col(c).isNull(), F.col(c)))))
    prints = checkpoint(fingerprints(marked, id_col, text_col, width, lanes, False, "_mark"))
    nodes = checkpoint(prints.groupBy("fp").agg(F.min(F.struct("id", "_mark")).alias("row")))
    radius = radius_of(similarity, LANE * lanes)
    links = checkpoint(near_links(nodes, radius, tile, lanes).distinct())
    linked = checkpoint(nodes.join(links.select(F.explode(F.array("u", "v")).alias("fp")).distinct(), "fp", "left_semi").select("fp", "row.*"))
    own = marked.select(F.col(id_col).cast("long").alias("id"), "_mark", F.col(text_col).alias("text")).join(sent_whole(linked), ["id", "_mark"])
    sets = checkpoint(shingle_sets(own.select("fp", "text"), width))
    sure = checkpoint(similar_enough(links, sets, similarity))
    more = checkpoint(links_between(links, sure, sets, radius, similarity, lanes, block))
    groups = grouped(nodes, sure.union(more), "row")
    kept = groups.select("least.*").distinct().withColumn("_kept", F.lit(True))
    rows = prints.groupBy("id", "_mark").agg(F.count("*").alias("_n")).join(kept, ["id", "_mark"], "left")
    odd = checkpoint(rows.where("_kept IS NULL OR _n > 1").withColumnRenamed("id", id_col))  # those that go, or come more than once
    one = marked.join(sent_whole(odd.drop("_kept", "_n")), [id_col, "_mark"], "left_anti")
    again = marked.join(sent_whole(odd.where("_kept").drop("_kept", "_n")), [id_col, "_mark"], "left_semi").dropDuplicates([id_col, "_mark"])
    return one.unionByName(again).drop("_mark").unionByName(docs.where(F.col(id_col).isNull()))

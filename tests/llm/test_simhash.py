"""Fingerprints bit by bit, and components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from headwater.llm import components, simhash


def plain(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Smallest id reachable, over all pairs."""
    ids = sorted(i for i in prints if i is not None)
    home = {i: i for i in ids}

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = find(a), find(b)
                home[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@settings(max_examples=150, deadline=None)
@given(st.text("aAbBéZ \t\n\x0b\x0c\r\x1c\x85\xa0", max_size=40))
def test_fingerprint(text):
    assert int.from_bytes(simhash.fingerprint(text)) == plain(text)


def test_query_equals_brute_force(spark, sf_dir):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: plain(t or "") for i, t in rows.items()}
    want = classes(prints)
    found = simhash.op5_simhash_near_dedup(spark, sf_dir).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in found} == {i: (prints[i], want[i]) for i in rows}


def near_prints(seed):
    """Chains and clouds of fingerprints a few bits apart, among others far away."""
    rng = random.Random(seed)
    prints, n = {}, 0
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 40])):
            prints[n], n = p, n + 1
            for _ in range(rng.randint(0, 4)):
                p ^= 1 << rng.randrange(64)
    return prints


@pytest.mark.parametrize("tile", [4, 16, 8192])
def test_links_in_small_tiles_keep_every_class(spark, tile):
    prints = near_prints(tile)
    seen = {}
    for i, p in prints.items():
        seen.setdefault(p.to_bytes(8), i)
    links = simhash.near_links(spark.createDataFrame([(p,) for p in seen], "fp binary"), 3, tile)
    found = links.collect()
    assert len(found) <= 40 * len(seen) and all((int.from_bytes(u) ^ int.from_bytes(v)).bit_count() <= 3 for u, v in found)
    ends = {bytes(r["node"]): bytes(r["component"]) for r in components.connected_components(links).collect()}
    want = classes(prints)
    classes_of = lambda key: {frozenset(p for p in seen if key(p) == k) for k in map(key, seen)}
    assert classes_of(lambda p: ends.get(p, p)) == classes_of(lambda p: want[seen[p]])


def test_tiles_hold_every_count_once():
    for sizes in ({}, {0: 1}, {3: 100, 4: 2, 5: 3, 64: 9}, {k: 5 for k in range(65)}):
        placed = simhash.tiles(sizes, 64, 8)
        taken = [n for first, many, _ in placed for n in range(first, first + many)]
        assert len(placed) == 65 and sorted(set(taken)) == list(range(max(taken) + 1))
        assert all(-(-sizes.get(p, 0) // 8) <= many for p, (_, many, _) in enumerate(placed))


@pytest.mark.parametrize("most", [1, 50, 10**6])
def test_links_are_a_least_spanning_forest(most):
    rng = np.random.default_rng(most)
    base = rng.integers(0, 2**63, (4, 4)).astype(np.uint64)
    rows = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, (15, 4)).astype(np.uint64)) * rng.integers(0, 2, (15, 4)).astype(np.uint64) for b in base])
    for left, right in ((rows, None), (rows[:25], rows[25:])):
        i, j = simhash.tile_links(left, right, 5, block=8, most=most)
        apart = lambda x, y: int(np.bitwise_count(rows[x] ^ rows[y]).sum())
        pairs = sorted((apart(x, y), x, y) for x in range(60) for y in range(x) if apart(x, y) <= 5 and (right is None or (x >= 25) != (y >= 25)))
        home, weight = list(range(60)), []
        for d, x, y in pairs:
            a, b = home[x], home[y]
            if a != b:
                home = [min(a, b) if h in (a, b) else h for h in home]
                weight.append(d)
        assert sorted(apart(x, y) for x, y in zip(i, j, strict=True)) == weight


def test_links_of_equal_values():
    same = np.full((3000, 1), 7, np.uint64)
    i, j = simhash.tile_links(same, None, 0, block=256)
    assert len(i) == 2999 and set(i) | set(j) == set(range(3000))


def test_a_row_without_an_id_still_links(spark, monkeypatch):
    made = {"a": 0, "b": 7, "c": 63}
    monkeypatch.setattr(simhash, "fingerprints", lambda df, *_: spark.createDataFrame([(r["doc_id"], made[r["text"]].to_bytes(8)) for r in df.collect()], "id long, fp binary"))
    for bridge in (None, 3):
        docs = spark.createDataFrame([(1, "a"), (bridge, "b"), (2, "c")], "doc_id long, text string")
        assert {(r["doc_id"], r["component"]) for r in simhash.near_duplicates(docs).collect()} == {(1, 1), (bridge, 1), (2, 1)}


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).union(spark.createDataFrame([(500, 501), (501, 500), (7, 7), (None, 3)], "u long, v long"))
    found = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components.connected_components(edges.where("u < 0")).isEmpty()


def test_rounds_of_components_pile_up_no_estimate(spark):
    rng = random.Random(3)
    edges = spark.createDataFrame([(rng.randrange(k), k) for k in range(1, 400)], "u long, v long")
    found = components.connected_components(edges)
    assert {r["component"] for r in found.collect()} == {0}
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 300


def test_awkward_rows(awkward, nothing):
    found = simhash.near_duplicates(awkward).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == 11 and by[1]["fp"] == by[2]["fp"] == by[3]["fp"] == bytes(8) and by[3]["component"] == 1 and by[6]["component"] == 5
    assert by[None]["component"] is None
    assert simhash.near_duplicates(nothing).isEmpty()


def test_keep_one(awkward, nothing):
    kept = [r["doc_id"] for r in simhash.keep_one(awkward).collect()]
    assert sorted(i for i in kept if i) == [1, 4, 5, 7, 8, 9] and kept.count(None) == 1
    assert simhash.keep_one(nothing).isEmpty()


def similar_classes(texts, width=5, similarity=0.8):
    """Smallest id reachable over all pairs of texts whose sets of shingles are that similar."""
    sets = {i: set(simhash.shingles(t, width)) for i, t in texts.items()}
    home = {i: i for i in texts}
    for x in sorted(texts):
        for y in sorted(texts):
            if x < y and (sets[x] == sets[y] or len(sets[x] & sets[y]) >= similarity * len(sets[x] | sets[y])):
                a, b = sorted((home[x], home[y]))
                home = {i: a if h == b else h for i, h in home.items()}
    return home


def test_keep_one_equals_all_pairs_by_shingles(spark):
    rng, texts = random.Random(5), {}
    for base in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(6):
            own = list(words)
            for _ in range(rng.choice([0, 1, 2, 5, 9])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            texts[len(texts)] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    home = similar_classes(texts)
    assert len(set(home.values())) < len(texts)
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == set(home.values())


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 1, 2, "n"), (2, "a b c d e f g", 3, 4, None)], "doc_id long, text string, fp int, id int, root string")
    assert [tuple(r) for r in simhash.keep_one(docs).collect()] == [(1, "a b c d e f g", 1, 2, "n")]
    assert {r["component"] for r in simhash.near_duplicates(docs).collect()} == {1}

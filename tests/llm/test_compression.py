"""Held-out accuracy, blocks, and awkward inputs."""

import zlib

import numpy as np
import pytest
import zstandard
from conftest_words import documents

from headwater.llm import compression as C


def test_held_out_accuracy():
    model = C.fit(documents(400, 1, [], shout=True))
    rows = documents(300, 2, [], shout=True)
    scores = C.score_texts([t for t, _ in rows], model)
    assert np.mean((scores >= 0.5) == [y for _, y in rows]) >= 0.97


def test_blocks_cover_the_text():
    for n in (1, 1023, 1024, 1025, 50_001):
        raw = bytes(range(256)) * (n // 256 + 1)
        parts = C.blocks(raw[:n])
        assert b"".join(parts) == raw[:n] and max(map(len, parts)) <= C.BLOCK


def test_logistic_recovers_a_line():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(4000), rng.normal(size=4000)])
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 1])))).astype(float)
    assert np.allclose(C.logistic(x, y, 1e-3), [0.5, 2], atol=0.25)


def test_without_both_labels_the_share_is_the_score():
    assert C.score_texts(["a", ""], C.fit([("x", 1)])).tolist() == [1.0, 1.0] and C.fit([]).prior == 0.5


def test_awkward_rows(awkward, nothing):
    model = C.fit(documents(100, 1, [], shout=True))
    found = C.score(awkward.withColumnRenamed("source", "score"), model).collect()
    assert len(found) == 11 and all(0 <= r["score"] <= 1 for r in found)
    kept = C.score(awkward, model, "doc_id", "text", "text", "lang", "n_chars")
    assert kept.columns == ["doc_id", "text", "lang", "n_chars", "score"] and {r["text"] for r in kept.collect()} == {r["text"] for r in awkward.collect()}
    assert C.score(nothing, model).isEmpty()


def test_the_difference_by_hand():
    good, bad = b"the quick brown fox jumps over the lazy dog " * 9, b"@@ buy now!! 100% free $$ click here ## " * 9
    text = "the quick brown fox jumps over the dog " * 60
    sizes = []
    for content in (good, bad):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw, n = text.encode(), -(-len(text) // C.BLOCK)
        sizes.append(sum(len(zstandard.ZstdCompressor(level=C.LEVEL, dict_data=held, write_content_size=False, write_dict_id=False).compress(raw[len(raw) * i // n : len(raw) * (i + 1) // n])) for i in range(n)))
    d, size = C.difference(text, good, bad)
    assert size == len(text) and abs(d - (sizes[1] - sizes[0]) / sum(sizes)) < 0.02 and d > 0 > C.difference("click here, buy 100% free $$ now!! ## " * 20, good, bad)[0]


def test_a_dictionary_takes_from_everywhere(monkeypatch):
    monkeypatch.setattr(C, "DICTIONARY_BYTES", 64_000)
    texts = [f"{k:07d} " * 4000 for k in range(40)]
    held = C._dictionary(texts, 1).decode()
    assert len({w for w in held.split() if len(w) == 7}) > 25 and 63_000 < len(held) <= 64_000


def area(scores, labels):
    """The chance that a good text scores above a bad one."""
    good, bad = scores[labels == 1], scores[labels == 0]
    return np.mean([(good > b).mean() + (good == b).mean() / 2 for b in bad])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_on_its_held_out_fifth(spark, sf):
    d = f"/root/testdata/{sf}"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = {r["doc_id"]: r for r in C.op7_compression_quality(spark, d).collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= C.THRESHOLD) for r in rows.values())
    held = [(r["text"], r["quality"], rows[r["doc_id"]]) for r in docs.join(labels, "doc_id").where("quality IN (0, 1)").collect() if r["text"] and rows[r["doc_id"]]["held_out"]]
    y = np.array([label for _, label, _ in held])
    model = C.fit_labels(docs, labels)
    alone = np.array([C.difference(t, model.good, model.bad)[0] for t, _, _ in held])
    assert area(alone, y) >= 0.9 and area(np.array([r["score"] for *_, r in held]), y) >= 0.95
    assert np.mean([r["predicted"] == label for _, label, r in held]) >= 0.95 and not [t for t, label, r in held if label and not r["predicted"]][1:]


def test_a_fit_holds_one_pair_of_compressors_and_leaves_none(monkeypatch):
    held, difference = [], C.difference
    monkeypatch.setattr(C, "difference", lambda *a: [difference(*a), held.append(C._compressors.cache_info().currsize)][0])
    C._compressors.cache_clear()
    C.fit([(" ".join(f"{'word' if k % 2 else '$$buy'}{k}x{i}" for i in range(50)), k % 2) for k in range(40)])
    assert set(held) == {1} and C._compressors.cache_info().currsize == 0

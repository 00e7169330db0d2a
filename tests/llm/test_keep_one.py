"""One row of each group of near copies, where ids repeat."""

import pytest

from headwater.llm import simhash


def test_an_id_with_two_texts_keeps_both(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (1, a), (2, a), (3, b), (None, a), (None, None), (4, "c d e"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (None, a), (None, None), (4, "c d e"), (5, None)], key=str)


@pytest.mark.parametrize("block", [3, 256])
def test_a_link_behind_many_nearer_candidates_that_fail(spark, monkeypatch, block):
    words = [f"w{i}" for i in range(60)]
    texts = {1: " ".join(words), 2: " ".join([*words[:-1], "x"])} | {k: " ".join(f"d{k}.{i}" for i in range(60)) for k in range(3, 33)}
    made = {1: 0, 2: (1 << 40) - 1} | {k: ((1 << 20) - 1) | 1 << (40 + k) for k in range(3, 33)}  # all others lie between the first two
    prints = {texts[k]: bits.to_bytes(32) for k, bits in made.items()}
    monkeypatch.setattr(simhash, "fingerprints", lambda df, *_: spark.createDataFrame([(r["doc_id"], prints[r["text"]], r["_mark"]) for r in df.collect()], "id long, fp binary, _mark long"))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs, block=block).collect()) == [1, *range(3, 33)]

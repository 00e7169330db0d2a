"""Both models against probabilities worked out with plain dictionaries, which must sum to 1."""

import math
from collections import Counter

import numpy as np
import pytest

from headwater.llm import lm

EDGE = object()


def symbols(text):
    words = (text or "").lower().split()
    return [EDGE, *words, EDGE] if words else []


class Plain:
    """P(w | v) over a table of texts, by its definition."""

    def __init__(self, texts, vocabulary):
        self.vocabulary = vocabulary
        self.pairs = Counter(p for t in texts for p in zip(symbols(t), symbols(t)[1:], strict=False))
        self.after, self.before = Counter(), Counter()
        for (v, w), n in self.pairs.items():
            self.before[v] += n
            self.after[w] += n
        self.total = sum(self.after.values())

    def chance(self, v, w):
        single = (self.after[w] + 1) / (self.total + len(self.vocabulary))
        return (self.pairs[v, w] + lm.STRENGTH * single) / (self.before[v] + lm.STRENGTH)


def brute(rows):
    """(id, text, in target): tokens and losses by id, each text scored by models of the other texts."""
    vocabulary = {s for _, t, _ in rows for s in symbols(t)}
    out = {}
    for k, (i, text, _) in enumerate(rows):
        own = symbols(text)
        losses = []
        for kind in (1, 0):
            model = Plain([t for j, (_, t, marked) in enumerate(rows) if j != k and (marked or not kind)], vocabulary)
            for v in vocabulary:
                assert abs(sum(model.chance(v, w) for w in vocabulary) - 1) < 1e-9
            losses.append(-sum(math.log(model.chance(v, w)) for v, w in zip(own, own[1:], strict=False)) / max(1, len(own) - 1))
        out[i] = (max(0, len(own) - 2), *losses)
    return out


ROWS = ["the rare cat sat on the mat", "the rare cat sat twice", "the dog", None, "", "the rare cat sat on the mat", "x x x a b", "a b", "a b", "a b"]


def holds(found, want):
    assert found.keys() == want.keys()
    for i, (n, target, background) in want.items():
        assert found[i]["n_tokens"] == n
        if n:
            assert found[i]["target_loss"] == pytest.approx(target, abs=1e-9) and found[i]["background_loss"] == pytest.approx(background, abs=1e-9)
            assert found[i]["score"] == pytest.approx(target - background, abs=1e-9) and found[i]["target_loss"] > 0 < found[i]["background_loss"]
        else:
            assert found[i]["score"] is None


@pytest.mark.parametrize(("chunk_chars", "range_chars", "long"), [(10, 5, 1000), (8_000_000, 8_000_000, 20), (60, 20, 25)])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, chunk_chars, range_chars, long):
    for name, value in (("CHUNK_CHARS", chunk_chars), ("RANGE_CHARS", range_chars), ("LONG", long)):
        monkeypatch.setattr(lm, name, value)
    marked = {0, 1, 3, 5, 8}
    spark.createDataFrame(list(enumerate(ROWS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in marked], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r["doc_id"]: r for r in lm.op6_cross_entropy_difference(spark, str(tmp_path)).collect()}
    holds(found, brute([(i, t, i in marked) for i, t in enumerate(ROWS)]))


def test_without_a_target(spark):
    rows = [(i, t, False) for i, t in enumerate(ROWS)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    none = spark.createDataFrame([], "id long")
    holds({r["doc_id"]: r for r in lm.score(docs, none).collect()}, brute(rows))


def test_bytes_come_back():
    for kind in ("<u8", "<u4", "<i8"):
        values = np.arange(7).astype(kind) ** 5
        assert lm.from_bytes(lm.by_bytes(values), kind, 7).tolist() == values.tolist()


def test_query_prefers_good_text(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    rows = lm.op6_cross_entropy_difference(spark, d).join(labels, "doc_id").where("n_tokens >= 50").groupBy("quality").avg("score").collect()
    mean = {r["quality"]: r["avg(score)"] for r in rows}
    assert mean[1] < mean[0]


def test_awkward_and_empty(spark, awkward, nothing):
    labels = spark.createDataFrame([(5, 1), (5, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    targets = lm.target_ids(labels)
    assert [r["id"] for r in targets.collect()] == [5]
    clash = awkward.selectExpr("*", "true AS target", "n_chars AS chunk", "lang AS part", "source AS id")
    found = lm.score(clash, targets).collect()
    assert len(found) == 11 and all(math.isfinite(r["score"]) for r in found if r["n_tokens"]) and sum(r["doc_id"] is None for r in found) == 1
    assert lm.score(nothing, targets).isEmpty()

"""Gradients by differences, held-out accuracy, and awkward inputs."""

import zlib

import numpy as np
import pytest
from conftest_words import documents

from headwater.llm import toxicity as T


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in T.new_parameters().items()}
    values, ids = rng.normal(size=(20, T.FEATURES)), rng.integers(0, 20, (4, T.WINDOW))
    ids[0, 20:], ids[1] = -1, -1
    target = np.array([1.0, 0, 1, 0])
    value = lambda: T.gradients(p, values.T, ids, target)
    _, g = value()
    for k in p:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p[k].shape)
            held = p[k][at]
            p[k][at] = held + 1e-5
            above = value()[0]
            p[k][at] = held - 1e-5
            below = value()[0]
            p[k][at] = held
            assert abs((above - below) / 2e-5 - g[k][at]) < 1e-6


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        windows = T.windows_of(list(range(n)))
        assert set(windows[windows >= 0].ravel()) == set(range(n)) and windows.shape[1] == T.WINDOW


@pytest.fixture(scope="module")
def model():
    return T.fit(documents(400, 1, "grumbok vexil snarfle".split()))


def test_held_out_accuracy(model):
    rows = documents(300, 2, "grumbok vexil snarfle".split())
    scores = T.score_texts([t for t, _ in rows], model, T.Tokens())
    assert np.mean((scores >= 0.5) == [y for _, y in rows]) >= 0.97


def test_one_word_late_in_a_long_text_is_found(model):
    clean = " ".join(t for t, y in documents(300, 3, []) if not y)
    a, b = T.score_texts([clean, clean + " grumbok " + clean[:300]], model, T.Tokens())
    assert a < 0.5 <= b


def test_a_full_word_table_starts_anew(model):
    rows = [t for t, _ in documents(60, 4, ["grumbok"])]
    small = T.Tokens(most=50)
    one_by_one = np.concatenate([T.score_texts([t], model, small) for t in rows])
    assert np.allclose(one_by_one, T.score_texts(rows, model, T.Tokens()), atol=1e-5)


def test_awkward_rows(spark, awkward, nothing, model):
    found = T.score(awkward.withColumnRenamed("lang", "score"), model).collect()
    assert len(found) == 11 and all(0 <= r["score"] <= 1 for r in found)
    assert T.score(nothing, model).isEmpty()
    assert T.score_texts(["", "x"], T.fit([("a", 1)]), T.Tokens()).tolist() == [1.0, 1.0] and T.fit([]).prior == 0.0


def plain_logit(p, values, words):
    """One window, gate by gate in plain loops."""
    h, states = T.HIDDEN, []
    sig = lambda x: 1 / (1 + np.exp(-x))
    for d in (0, 1):
        state, seen = np.zeros(h), {}
        for t in range(len(words)) if d == 0 else reversed(range(len(words))):
            x = (p["W"] @ values[words[t]] + p["b"][:, 0])[3 * h * d : 3 * h * (d + 1)]
            y = p["U"][d] @ state
            r, z = sig(x[:h] + y[:h]), sig(x[h : 2 * h] + y[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(x[2 * h :] + r * y[2 * h :])
            seen[t] = state
        states.append([seen[t] for t in range(len(words))])
    both = np.array([np.concatenate(s) for s in zip(*states, strict=True)])
    weight = np.exp(np.array([p["v"] @ np.tanh(p["A"] @ s + p["a"][:, 0]) for s in both]))
    return p["u"] @ (weight[:, None] * both).sum(axis=0) / weight.sum() + p["c"][0]


def test_the_network_equals_plain_loops():
    rng = np.random.default_rng(2)
    p = {k: rng.normal(0, 0.6, v.shape) for k, v in T.new_parameters().items()}
    values = rng.normal(size=(30, T.FEATURES))
    for n in (1, 5, T.WINDOW):
        words = rng.integers(0, 30, n)
        ids = np.full((1, T.WINDOW), -1)
        ids[0, :n] = words
        assert abs(T.run_network(p, p["W"] @ values.T + p["b"], ids)[0] - plain_logit(p, values, words)) < 1e-9


def test_every_piece_of_a_long_word_counts():
    word = "abcdefghijklmnopqrstuvwxyz" * 3
    assert set(T.pieces_of(word)[2:]) == {f"^{word}$"[i : i + 4] for i in range(1, len(word) - 1)}
    one = T.Vocabulary({}, {T.pieces_of(word)[-1]: 5.0}).inputs([word, "abc"])
    assert one[0, 4] == 5.0 and one[0, 5] > 0 == one[1, 4]


def test_a_word_of_a_million_letters(model):
    assert all(0 <= s <= 1 for s in T.score_texts(["x" * 1_000_000, "a " + "y" * 300_000], model, T.Tokens(most_chars=1000)))


def test_clashing_columns(awkward, model):
    clash = awkward.selectExpr("*", "lang AS id", "1 AS score", "0 AS _y")
    assert T.score(clash, model, "doc_id", "text", "lang").columns == ["doc_id", "lang", "score"]


@pytest.mark.parametrize(("sf", "recall"), [("sf0.01", 0.8), ("sf0.1", 0.9)])
def test_query_on_its_held_out_fifth(spark, sf, recall):
    d = f"/root/testdata/{sf}"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = {r["doc_id"]: r for r in T.op2_toxicity(spark, d).collect()}
    assert len(rows) == docs.count()
    for r in rows.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
    held = [(r["toxic"], rows[r["doc_id"]]["predicted"]) for r in labels.where("toxic IN (0, 1)").collect() if r["doc_id"] in rows and rows[r["doc_id"]]["held_out"]]
    assert np.mean([p for y, p in held if y]) >= recall and np.mean([p for y, p in held if not y]) <= 0.04


def test_words_held_by_a_task_are_few():
    held = T.Tokens()
    assert held.most * held.table.itemsize * len(held.table) <= 20 << 20


def test_a_fit_holds_the_input_sums_of_one_batch(model, monkeypatch):
    rows = documents(120, 9, ["grumbok"])
    sample = T.read_sample([(rows, model.vocabulary)])
    whole = T.run_network(model.parameters, model.gates(sample.values), sample.windows)
    monkeypatch.setattr(T, "BATCH_WINDOWS", 2)
    asked, gates = [], T.ToxicityModel.gates
    monkeypatch.setattr(T.ToxicityModel, "gates", lambda self, values: asked.append(len(values)) or gates(self, values))
    assert np.allclose(sample.logits(model), whole, atol=1e-5)
    assert len(sample.values) > 2 * T.WINDOW + 1 >= max(asked)


def test_a_fit_makes_one_folds_vocabulary_at_a_time(monkeypatch):
    events, vocabulary, inputs = [], T.Counts.vocabulary, T.Vocabulary.inputs
    monkeypatch.setattr(T.Counts, "vocabulary", lambda *a: events.append("made") or vocabulary(*a))
    monkeypatch.setattr(T.Vocabulary, "inputs", lambda *a: events.append("used") or inputs(*a))
    T.fit(documents(60, 5, ["grumbok"]), steps=5)
    assert events == ["made", "used"] * T.FOLDS + ["made"]

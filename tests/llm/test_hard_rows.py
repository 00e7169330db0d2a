"""Every operator and every stage over one table of rows that are hard to read, beside columns with clashing names."""

import corpus_pipeline as pipeline
import pytest
from conftest_words import documents

from headwater.llm import bpe, chat, compression, fertility, imatch, lm, packing, secrets, simhash, toxicity

HARD = [
    (1, "a" + " " * 1_000_000 + "b"),
    (2, "x" * 300_000),
    (3, "one line of words " * 15_000),
    (4, "the first text of an id"),
    (4, "and another text of the same id, which is no copy of it"),
    (None, "a text without an id"),
    (None, None),
    (5, None),
    (6, ""),
    (6, ""),
    (7, "\n" * 70_000),
    (8, "password = " + "Z" * 50_000 + " AKIA" + "B" * 20_000),
]
CLASH = "id int, fp string, score string, part int, bucket int, key string, target int, h string, label int, n_words string"


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, "en", "s", len(t or ""), *([None] * 10)) for i, t in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)


@pytest.fixture(scope="module")
def models():
    sample = documents(80, 1, ["grumbok"])
    return toxicity.fit(sample, steps=20), compression.fit(sample)


def test_every_operator_gives_each_row_its_row(spark, hard, models):
    toxic, quality = models
    found = {
        "toxicity": toxicity.score(hard, toxic),
        "imatch": imatch.fingerprint_with_next(hard, ["words", "text"]),
        "bpe": bpe.encoding_digests(hard),
        "simhash": simhash.near_duplicates(hard),
        "lm": lm.score(hard, spark.createDataFrame([(3,), (4,)], "id long")),
        "compression": compression.score(hard, quality),
        "secrets": secrets.digest(secrets.scan_secrets(hard)),
        "fertility": fertility.judge(fertility.measure(hard)),
    }
    want = sorted(str(i) for i, _ in HARD)
    for name, df in found.items():
        assert sorted(str(r["doc_id"]) for r in df.select("doc_id").collect()) == want, name
    pieces = packing.pack(hard).collect()
    assert sorted(str(r["doc_id"]) for r in pieces if r["piece"] == 0) == want and all(0 < r["length"] <= packing.CAPACITY for r in pieces)


def test_every_stage_takes_them(spark, hard, models, monkeypatch):
    monkeypatch.setattr(toxicity, "fit_labels", lambda *_: models[0])
    monkeypatch.setattr(compression, "fit_labels", lambda *_: models[1])
    kept = simhash.keep_one(hard)
    assert kept.columns == hard.columns
    texts = sorted(str((r["doc_id"], (r["text"] or "")[:9])) for r in kept.collect())
    # of the texts without words, one; both texts of id 4; every row without an id
    assert len(texts) == len(HARD) - 3 and sum("(4," in t for t in texts) == 2 and sum("None" in t for t in texts) == 2
    for _, stage in pipeline.STAGES[:-1]:
        assert set(stage(spark, hard, "/root/testdata/sf0.001").columns) == set(pipeline.COLUMNS)
    docs = pipeline.redact_secrets(spark, hard, "").collect()
    assert len(docs) == len(HARD) and {r["text"] for r in docs if r["doc_id"] == 8} == {"[assign] [access]"}


def test_chat_of_hard_turns(spark):
    rows = [(1, 1, "user", " " * 1_000_000), (1, 2, "user", "x" * 300_000), (2, 1, "user", " " * 1_000_000), (3, None, None, None), (3, None, None, None), (None, 1, "user", "x")]
    turns = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "conv_id long, turn int, role string, text string, conv string, place int, h1 int")
    assert sorted((r["conv_id"], r["n_turns"]) for r in chat.collapse_and_render(turns).collect()) == [(1, 2), (3, 1)]

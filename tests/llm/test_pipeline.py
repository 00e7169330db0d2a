"""Each stage on its own input, and the run as the stages in turn."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from test_simhash import similar_classes

from headwater.llm import compression, secrets, toxicity


def test_stages_are_what_they_say(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    steps = {}
    now = docs
    for name, stage in pipeline.STAGES:
        now = pipeline.written(stage(spark, now, d))
        steps[name] = now
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "secrets", "packing"]
    assert all(set(steps[n].columns) == set(docs.columns) for n in ("toxicity", "quality", "near_dedup", "secrets"))

    rows = texts(docs)
    tox = toxicity.fit_labels(docs, labels)
    scores = toxicity.score_texts(list(map(lambda t: t or "", rows.values())), tox, toxicity.Tokens())
    sure = {i for i, s in zip(rows, scores, strict=True) if abs(s - 0.5) > 1e-4}
    assert sure & texts(steps["toxicity"]).keys() == {i for i, s in zip(rows, scores, strict=True) if s < 0.5} & sure

    rows = texts(steps["toxicity"])
    model = compression.fit_labels(docs, labels)
    kept = {i for i, s in zip(rows, compression.score_texts(list(rows.values()), model), strict=True) if s >= compression.THRESHOLD}
    assert texts(steps["quality"]).keys() == kept

    rows = texts(steps["quality"])
    kept, home = texts(steps["near_dedup"]).keys(), similar_classes({i: t or "" for i, t in rows.items()})
    assert kept == set(home.values())

    rows, automaton = texts(steps["near_dedup"]), secrets._automaton()
    assert texts(steps["secrets"]) == {i: secrets.redact(t, secrets.find_secrets(t, automaton)) for i, t in rows.items()}
    assert steps["secrets"].where(F.length("text") != F.col("n_chars")).isEmpty()

    assert {r["doc_id"] for r in steps["packing"].select("doc_id").collect()} == rows.keys()


def test_empty_documents(spark, nothing):
    d = "/root/testdata/sf0.001"
    now = nothing
    for _, stage in pipeline.STAGES:
        now = pipeline.written(stage(spark, now, d))
    assert now.isEmpty()

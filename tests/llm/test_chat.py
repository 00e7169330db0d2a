"""Snapshot collapse against a plain comparison of turn lists, and its SQL."""

import random

import duckdb
import pytest

from headwater.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    by = {}
    for c, *rest in {r for r in rows if r[0] is not None}:
        by.setdefault(c, []).append(tuple(rest))
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1] or ""))
    bare = {c: tuple((r, t) for _, r, t in turns) for c, turns in by.items()}
    first = {}
    for c in sorted(bare):
        first.setdefault(bare[c], c)
    prefixes = {v[:k] for v in bare.values() for k in range(1, len(v))}
    shown = lambda v: "".join(f"<|{r or ''}|>\n{t or ''}\n<|end|>\n" for r, t in v)
    return {(c, len(v), shown(v)) for v, c in first.items() if v not in prefixes}


def log(seed):
    rng = random.Random(seed)
    base = [[(rng.choice(["user", "assistant"]), rng.choice(["hi", "", "yes", "go on", "a\nb"]) + str(rng.randrange(3))) for _ in range(rng.randint(1, 6))] for _ in range(12)]
    rows = []
    for c in range(60):
        turns = rng.choice(base)
        rows += [(c, i, *t) for i, t in enumerate(turns[: rng.randint(1, len(turns))])]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force_and_sql(spark, seed):
    rows = log(seed)
    found = {tuple(r) for r in chat.collapse_and_render(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == brute(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert set(con.sql(chat.ORACLE_SQL).fetchall()) == found


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (2, 0, "user", "a"), (3, 0, "user", None), (4, 0, "user", ""), (None, 0, "user", "lost"), (5, None, "user", "a")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", n_turns string, chat int")
    found = {r["conv_id"]: (r["n_turns"], r["chat"]) for r in chat.collapse_and_render(df).collect()}
    assert set(found) == {1, 3, 4}  # 2 and 5 are snapshots of 1; a null text is no empty one
    assert found[1] == (2, "<|user|>\na\n<|end|>\n<||>\n\n<|end|>\n")


def test_empty_table(spark):
    assert chat.collapse_and_render(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_plan_is_native(spark):
    plan = chat.collapse_and_render(spark.createDataFrame(log(0), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))

"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

A log holds a conversation again each time it grows. A running hash over the first k turns, for each k,
names every prefix; a conversation is dropped if its whole hash is a shorter prefix of another, and of
equal conversations the one with the smallest id stays. What remains is rendered.

The rolling hash of a prefix is the exclusive-or of two 64-bit hashes of (place, role, text) over its
turns: 128 bits, a running aggregate that needs no array of turns, and one that any split of a
conversation could be combined from. Prefixes are distinct before they meet whole conversations, and the
meeting is an anti-join, so a first turn or a conversation that a third of the log shares is one row.

Turns are taken in the order of (turn, role, text); a turn without a number comes first, exact repeats
of a row count as one turn. A null role or text hashes as itself, not as empty, and renders as empty.
Rows with a null conversation id belong to no conversation and are left out. An empty table gives an
empty result. Extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def prefixes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, n_turns, h1, h2): the hash of each conversation's first ``place`` turns."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    coded = rows.where("conv IS NOT NULL").select(
        "conv",
        "turn",
        F.coalesce("role", F.lit("")).alias("r"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("t"),  # orders turns that share a number without carrying their text
        (F.when(F.col("role").isNull(), 1).otherwise(0) + F.when(F.col("text").isNull(), 2).otherwise(0)).alias("gone"),
    )
    coded = coded.distinct()
    order = W.partitionBy("conv").orderBy("turn", "r", "t", "gone")
    placed = coded.withColumn("place", F.row_number().over(order))
    for name, seed in (("x1", 1), ("x2", 2)):
        placed = placed.withColumn(name, F.xxhash64(F.lit(seed), "place", "r", "t", "gone"))
    running = order.rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("conv")
    return placed.select("conv", "place", F.count("*").over(whole).alias("n_turns"), F.bit_xor("x1").over(running).alias("h1"), F.bit_xor("x2").over(running).alias("h2"))


def maximal(turns: DataFrame, **columns: str) -> DataFrame:
    """(conv, n_turns): conversations that are no prefix of a longer one, the smallest id of equal ones."""
    found = prefixes(turns, **columns)
    whole = found.where("place = n_turns").groupBy("h1", "h2", "n_turns").agg(F.min("conv").alias("conv"))
    inner = found.where("place < n_turns").select("h1", "h2", F.col("place").cast("long").alias("n_turns")).distinct()
    return whole.join(inner, ["h1", "h2", "n_turns"], "left_anti").select("conv", "n_turns")


def render(turns: DataFrame, kept: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, n_turns, chat): the kept conversations' turns as one text each."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    own = rows.join(kept, "conv").groupBy("conv").agg(
        F.first("n_turns").alias("n_turns"),
        F.array_sort(F.collect_set(F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("r"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("t"), "role", "text"))).alias("turns"),
    )
    return own.select("conv", "n_turns", F.array_join(F.transform("turns", lambda t: rendered_turn(t["role"], t["text"])), "").alias("chat"))


def collapse_and_render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    columns = {"conv_col": conv_col, "turn_col": turn_col, "role_col": role_col, "text_col": text_col}
    return render(turns, maximal(turns, **columns), **columns).withColumnRenamed("conv", conv_col)


def op1_chat_snapshots(spark, sf_dir: str) -> DataFrame:
    return collapse_and_render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The same by whole texts: a conversation's rendering, with each turn closed, is a prefix of a longer one's.
ORACLE_SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, '')), role IS NULL, text IS NULL) AS place,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS shown,
         md5(coalesce('r' || role, 'null') || '/' || coalesce('t' || text, 'null')) AS code
  FROM turns),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(shown, '' ORDER BY place) AS chat, string_agg(code, '' ORDER BY place) AS codes
  FROM placed GROUP BY conv_id),
single AS (SELECT codes, min(conv_id) AS conv_id FROM whole GROUP BY codes),
inner_prefix AS (
  SELECT DISTINCT substr(w.codes, 1, 32 * k.k) AS codes
  FROM (SELECT codes, n_turns FROM whole) w, LATERAL (SELECT unnest(generate_series(1, w.n_turns - 1)) AS k) k)
SELECT w.conv_id, w.n_turns, w.chat
FROM whole w JOIN single s ON s.conv_id = w.conv_id
WHERE w.codes NOT IN (SELECT codes FROM inner_prefix)
"""

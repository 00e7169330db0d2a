"""Every query with SQL beside it: the same rows from the engine and from DuckDB over the same tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from headwater import queries
from headwater.queries import ORACLE_SQL, QUERIES
from headwater.session import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def values(frame):
    shown = lambda v: "null" if v is None or v is pd.NA or v != v else repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(shown(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert values(ours) == values(theirs)


def test_entry_lists_the_catalogue():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


def test_relations_are_of_whole_tables(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    assert queries._references(spark, sf_dir).count() == lines.count()
    ties = queries._graph(spark, sf_dir).where("src LIKE 'S%' AND dst LIKE 'P%'").count()
    assert ties == lines.select("l_suppkey", "l_partkey").distinct().count()
    seeds = {r["seed"] for r in QUERIES["move_chain"](spark, sf_dir).select("seed").collect()}
    assert seeds == {r["o_orderkey"] for r in table(spark, sf_dir, "orders").collect() if r["o_orderkey"] > 8}


def test_statements_of_one_file_go_to_several_tasks(spark, sf_dir):
    made = QUERIES["strip_dialect"](spark, sf_dir)
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1

"""Connected components over an edge table, by contraction in the engine.

Each round hooks every node to its smallest neighbour, follows the pointers to their ends by doubling,
and replaces the edges by those between different ends. Only local minima are left after a round, so
stars and chains are gone after one. Minima and distinct edges are pre-aggregated before every shuffle,
and a hub is only ever a join key, which the engine can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for each node with an edge to another; component is the smallest node reachable.

    Nodes are of any ordered type. Null ends and loops are ignored; repeated edges count once. An empty
    table gives an empty result.
    """
    links = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    links = checkpoint(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = None
    while not links.isEmpty():
        both = links.union(links.select("v", "u"))
        hook = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("to"))
        jump = checkpoint(hook)
        while True:  # every pointer's end has edges too, so it has a pointer
            on = jump.select(F.col("node").alias("to"), F.col("to").alias("far"))
            step = checkpoint(jump.join(on, "to").select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
            jump = step.select("node", "to")
            if step.where("moved").isEmpty():
                break
        left, right = jump.select(F.col("node").alias("u"), F.col("to").alias("pu")), jump.select(F.col("node").alias("v"), F.col("to").alias("pv"))
        moved = links.join(left, "u").join(right, "v").where("pu <> pv")
        links = checkpoint(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        if labels is None:
            labels = jump.select("node", F.col("to").alias("component"))
        else:
            step = jump.select(F.col("node").alias("component"), "to")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = checkpoint(labels)
    return labels if labels is not None else links.select(F.col("u").alias("node"), F.col("v").alias("component"))

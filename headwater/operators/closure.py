"""Reachability: the iterative operator that every lineage question goes through.

A state is (seed, node) with its least depth and best strength. Each round joins the frontier to the
flow edges, keeps the best strength of each new state before anything is shuffled twice, drops states
that an earlier round reached at least as strongly, and goes on from the rest. Depth grows by round, so
an earlier state is never deeper; a state returns only for greater strength. Strengths are few
(confidence) or bounded by the edges' own values, so the loop ends on cyclic graphs.

A round writes its new states to the shared checkpoint folder and nothing else; they are added up once at
the end. The plan stays a few rounds long, and a lost executor costs one round. The flow edges are dealt by
source once and read so by every round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

MAX_DEPTH = 64
MERGE = 12


def lineage_flow(edges: DataFrame) -> DataFrame:
    """(src, dst, rank) in the direction of provenance: from what is made to what it is made from."""
    from ..functions.confidence import rank_of

    back = edges.where("kind = 'writes'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), rank_of("confidence").alias("rank"))
    forth = edges.where("kind = 'derives_from' OR (kind = 'reads' AND src LIKE 'program:%')").select("src", "dst", rank_of("confidence").alias("rank"))
    return back.unionByName(forth)


def closure(seeds: DataFrame, flow: DataFrame, max_depth: int = MAX_DEPTH, stop: DataFrame | None = None, keep_seed: bool = False) -> DataFrame:
    """(seed, node, depth, rank) for each node reachable from each seed.

    seeds: (seed, node). flow: (src, dst, rank). depth is the least number of edges, rank the greatest
    over all paths of a path's least rank; the two may come from different paths. stop: nodes (node) at
    which a path ends. The seed's own node is left out unless keep_seed.
    """
    best = checkpoint(flow.where("src <> dst").repartition("src").groupBy("src", "dst").agg(F.max("rank").cast("long").alias("step")))
    start = seeds.select("seed", "node").distinct().withColumn("rank", F.lit(1 << 62).cast("long")).withColumn("depth", F.lit(0))
    ends = None if stop is None else stop.select("node").distinct()
    fresh = frontier = checkpoint(start)
    rounds = [fresh]
    for depth in range(1, max_depth + 1):
        if frontier.isEmpty():
            break
        reached = frontier.join(best, frontier["node"] == best["src"]).groupBy("seed", F.col("dst").alias("node")).agg(F.max(F.least("rank", "step")).alias("rank"))
        known = reduce(DataFrame.union, [r.select(F.col("seed").alias("_seed"), F.col("node").alias("_node"), F.col("rank").alias("_rank")) for r in rounds])
        fresh = checkpoint(reached.join(known, F.expr("_seed = seed AND _node = node AND _rank >= rank"), "left_anti").withColumn("depth", F.lit(depth)))
        rounds.append(fresh)
        if len(rounds) > MERGE:  # keeps the plan of a deep graph short
            rounds = [checkpoint(states(rounds))]
        frontier = fresh if ends is None else fresh.join(ends, "node", "left_anti")
    seen = states(rounds)
    if not keep_seed:
        seen = seen.join(start.select("seed", "node"), ["seed", "node"], "left_anti")
    return seen.select("seed", "node", "depth", "rank")


def states(rounds: list[DataFrame]) -> DataFrame:
    every = reduce(DataFrame.unionByName, rounds)
    return every.groupBy("seed", "node").agg(F.min("depth").alias("depth"), F.max("rank").alias("rank"))


def base_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (node) that derive from nothing and that nothing writes."""
    derived = edges.where("kind = 'derives_from'").select(F.col("src").alias("node"))
    written = edges.where("kind = 'writes'").select(F.col("dst").alias("node"))
    return nodes.join(derived.unionByName(written).distinct(), "node", "left_anti")


def sinks(seeds: DataFrame, flow: DataFrame) -> DataFrame:
    """(seed, node): reachable nodes that go no further; a seed without edges is its own."""
    reached = closure(seeds, flow, keep_seed=True)
    return reached.join(flow.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("seed", "node")


def transitive_callers(targets: DataFrame, calls: DataFrame) -> DataFrame:
    """(seed, node, depth): programs from which a target is called, directly or not. calls: (src, dst)."""
    flow = calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("rank"))
    return closure(targets, flow).select("seed", "node", "depth")


def contract(flow: DataFrame, kept: DataFrame) -> DataFrame:
    """(src, dst, rank) between kept nodes (node), over any path through others; rank is the best path's least."""
    own = kept.select("node").distinct()
    found = closure(own.select(F.col("node").alias("seed"), "node"), flow, stop=own)
    return found.join(own, "node", "left_semi").select(F.col("seed").alias("src"), F.col("node").alias("dst"), "rank")


def follow_last(relations: DataFrame, starts: DataFrame, hops: int = 4) -> DataFrame:
    """(node, base): each start's end after up to ``hops`` pointers; relations: (src, dst, ord), the last one of a src counts."""
    pointer = relations.groupBy("src").agg(F.max_by("dst", "ord").alias("dst"))
    out = starts.select("node", F.col("node").alias("base"))
    for _ in range(hops):
        step = pointer.select(F.col("src").alias("base"), F.col("dst").alias("_next"))
        out = out.join(step, "base", "left").select("node", F.coalesce("_next", "base").alias("base"))
    return out

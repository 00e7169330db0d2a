"""Operators on small relations: closure against a plain walk, overrides, clusters, traces."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from headwater.operators import analysis, closure
from headwater.plans import overrides, trace


def walk(edges, seed, max_depth=64):
    """Every (depth, least rank) state by breadth: least depth, greatest rank."""
    best, frontier = {}, {seed: 1 << 62}
    seen = {(seed, 1 << 62)}
    for depth in range(1, max_depth + 1):
        nxt = {}
        for node, rank in frontier.items():
            for a, b, r in edges:
                if a == node:
                    nxt[b] = max(nxt.get(b, -1), min(rank, r))
        frontier = {}
        for node, rank in nxt.items():
            d, old = best.get(node, (depth, -1))
            if rank > old and (node, rank) not in seen:
                best[node], frontier[node] = (d, rank), rank
                seen.add((node, rank))
    best.pop(seed, None)
    return best


@pytest.mark.parametrize(("n", "merge"), [(0, 12), (1, 2)])
def test_closure_equals_a_walk(spark, monkeypatch, n, merge):
    monkeypatch.setattr(closure, "MERGE", merge)
    rng = random.Random(n)
    edges = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", rng.randrange(4)) for _ in range(34)]
    flow = spark.createDataFrame(edges, "src string, dst string, rank int")
    seeds = spark.createDataFrame([("a", "n0"), ("b", "n5")], "seed string, node string")
    found = {(r["seed"], r["node"]): (r["depth"], r["rank"]) for r in closure.closure(seeds, flow).collect()}
    loops = [e for e in edges if e[0] != e[1]]
    assert found == {(s, k): v for s, root in (("a", "n0"), ("b", "n5")) for k, v in walk(loops, root).items()}


def test_closure_of_nothing(spark):
    flow = spark.createDataFrame([], "src string, dst string, rank int")
    seeds = spark.createDataFrame([("a", "n0")], "seed string, node string")
    assert closure.closure(seeds, flow).isEmpty()
    assert [tuple(r) for r in closure.sinks(seeds, flow).collect()] == [("a", "n0")]


def test_dense_mesh_is_quick(spark):
    edges = [(f"{i}.{a}", f"{i + 1}.{b}", 2) for i in range(6) for a in range(6) for b in range(6)]
    found = closure.closure(spark.createDataFrame([("s", "0.0")], "seed string, node string"), spark.createDataFrame(edges, "src string, dst string, rank int"))
    assert found.count() == 36


def test_override_scopes():
    set_, drop, call = (lambda f, v, job=False: ("override", (f, job, v))), (lambda f: ("delete", f)), (lambda p: ("call", p))
    events = {
        "L/A": [set_("a", "X"), set_("J", "X", True), call("L/B"), call("END"), drop("*ALL"), drop("J"), call("END")],
        "L/B": [set_("A", "Y"), call("C"), drop("A"), call("C"), drop("J"), drop(None), call("C")],
    }
    seen = [(callee, active) for callee, active, _ in overrides.observed_calls(events, "L/A")]
    outer = {"A": "X", "J": "X"}
    assert seen == [("L/B", outer), ("C", {"A": "Y", "J": "X"}), ("C", outer), ("C", outer), ("END", outer), ("END", {"J": "X"})]


def test_observed_calls_end_on_recursion():
    events = {"L/A": [("override", ("F", False, 1)), ("call", "B"), ("delete", "F"), ("call", "B")], "L/B": [("call", "L/A"), ("call", "C")]}
    seen = [(callee, sorted(active)) for callee, active, _ in overrides.observed_calls(events, "L/A")]
    assert seen == [("B", ["F"]), ("L/A", ["F"]), ("C", ["F"]), ("B", []), ("L/A", []), ("C", [])]


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.sets(st.integers(0, 5).map(str), max_size=4), max_size=6))
def test_clusters_hold_each_output_once(sources):
    home = analysis.cluster_outputs(sources)
    assert home.keys() == sources.keys() and all(home[first] == first for first in home.values())


def test_candidates_rank_clusters_before_single_sources(spark):
    sources = {"A": {"1", "2"}, "B": {"1", "2", "3"}, "C": {"3", "9"}, "D": {"3", "8", "7"}}
    matrix = spark.createDataFrame([(o, s) for o, have in sources.items() for s in have] + [("D", "column:x")], "output_id string, source_id string")
    found = analysis.candidate_products(matrix).orderBy("rank").collect()
    assert [tuple(r) for r in found] == [(1, "cluster", ["A", "B"], 2, ["1", "2"], ["1", "2", "3"]), (2, "single_source", ["B", "C", "D"], 3, ["3"], ["3"])]
    assert [r["outputs"] for r in analysis.candidate_products(matrix.where("output_id = 'C'")).collect()] == [["C"]]
    assert analysis.candidate_products(matrix.where("false")).isEmpty() and analysis.jaccard(set(), set()) == 0.0


def steps(*edges):
    """(src, dst, confidence) as what is above each column."""
    made, above = {s for s, *_ in edges}, {}
    for src, dst, confidence in edges:
        above.setdefault(f"column:L/{src}", []).append(trace.Step(f"column:L/{dst}", "dds", confidence, {"mechanism": "m"}, dst in made))
    return above


def test_drawing_stubs_and_fan_in():
    above = steps(*[("A.X", f"B.{i:02d}", "parsed") for i in range(45)], ("B.00", "A.X", "parsed"))
    lines = list(trace.drawing(above, "column:L/A.X"))
    assert len(lines) == 43 and "(+5 more upstream edges)" in lines[-1] and "A.X" in lines[2] and "(cycle/limit)" in lines[2]
    assert sum("(base)" in x for x in lines) == 39


def test_relays_are_passed_over():
    def past(*edges, relays=("L/R", "L/S")):
        return [(s.node[9:], s.confidence, s.context.get("collapsed_via"), s.context.get("paths_merged")) for s in trace.past_relays(steps(*edges), "column:L/O.C", set(relays))]

    assert past(("O.C", "R.C", "inferred"), ("R.C", "B.C", "parsed")) == [("B.C", "inferred", "L/R.C", None)]
    assert past(("O.C", "R.C", "inferred"), ("R.C", "S.C", "inferred"), ("S.C", "B.C", "parsed")) == [("B.C", "inferred", "L/R.C, L/S.C", None)]
    assert past(("O.C", "R.C", "inferred")) == [("R.C", "inferred", None, None)]
    assert past(("O.C", "A.C", "parsed"), ("O.C", "R.C", "inferred"), ("R.C", "A.C", "parsed"), ("R.C", "O.C", "inferred")) == [("A.C", "parsed", None, 2)]


def test_a_dense_mesh_is_drawn_once_a_node():
    above = steps(*[(f"T{d}.F{i}", f"T{d + 1}.F{j}", "parsed") for d in range(20) for i in range(6) for j in range(6)])
    begun = time.monotonic()
    lines = list(trace.drawing(above, "column:L/T0.F0", {f"L/T{d}" for d in range(1, 20, 2)}))
    assert time.monotonic() - begun < 2 and {x.split()[0] for x in lines if "(base)" in x} == {f"column:L/T20.F{i}" for i in range(6)}


def test_split_table():
    assert trace.split_table("a.b") == ("A", "B") and trace.split_table(" a / b.c ") == ("A", "B.C")
    with pytest.raises(ValueError):
        trace.split_table("b")

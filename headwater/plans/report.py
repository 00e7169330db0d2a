"""Reports: exported tables, the cone of each output as JSON, a summary page and a diagram of each output."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.confidence import NAMES
from ..operators import analysis
from ..operators.closure import closure, contract, lineage_flow
from ..operators.edges import evidence_counts, merge_parallel, within
from ..sources.config import Config, Seed

EXPORTED = ("output_lineage", "commonality_matrix", "complexity_scores", "gaps", "nodes", "edges")
MOST_NODES, MOST_EDGES = 150, 600


def export_tables(tables: dict[str, DataFrame], folder: str, form: str = "csv") -> list[str]:
    """Write the result tables; maps become JSON text in CSV."""
    if form not in ("csv", "parquet"):
        raise ValueError(f"{form} is neither csv nor parquet")
    out = []
    for name in EXPORTED:
        df = tables[name]
        if form == "csv":
            df = df.select(*[F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in df.dtypes])
            df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        out.append(f"{folder}/{name}")
    return out


def cone(spark: SparkSession, edges: DataFrame, seed: Seed) -> DataFrame:
    """(node, depth, rank) of an output and all that is upstream of it."""
    seeds = spark.createDataFrame([(seed.id, seed.node)], "seed string, node string")
    return closure(seeds, lineage_flow(edges), keep_seed=True).select("node", "depth", "rank")


def export_cones(spark: SparkSession, tables: dict[str, DataFrame], config: Config, folder: str) -> None:
    """For each output its nodes and edges as JSON lines, written by the engine."""
    for seed in config.seeds:
        near = cone(spark, tables["edges"], seed)
        near.select("node", "depth").orderBy("node").coalesce(1).write.mode("overwrite").json(f"{folder}/{seed.id}/nodes")
        within(tables["edges"], near).orderBy("src", "dst", "kind", "provenance").coalesce(1).write.mode("overwrite").json(f"{folder}/{seed.id}/edges")


def coverage(spark: SparkSession, tables: dict[str, DataFrame], config: Config) -> dict:
    """Status by output, and the summary that becomes coverage.json."""
    outputs = spark.createDataFrame([(s.id,) for s in config.seeds], "output_id string")
    status = analysis.coverage_status(outputs, tables["output_lineage"], tables["gaps"].select("object_id"))
    rows = {r["output_id"]: r["status"] for r in status.collect()}
    total = analysis.coverage_summary(status).first()
    gaps = {r["kind"]: r["count"] for r in tables["gaps"].groupBy("kind").count().collect()}
    return {"outputs": rows, "summary": total.asDict(), "gaps_by_kind": gaps}


def physical_flow(tables: dict[str, DataFrame], flow: DataFrame, seed: Seed) -> DataFrame:
    """(src, dst, rank, evidence): the output's graph over tables alone, from what is made to what it is made from.

    Logical files, views and programs are contracted. Where column evidence exists for an output's feeders,
    feeders without any are left out.
    """
    types = tables["raw_systables"].where("upper(trim(coalesce(table_type, ''))) IN ('T', 'P')").select(F.concat(F.lit("file:"), F.upper(F.trim("table_schema")), F.lit("/"), F.upper(F.trim(F.coalesce(F.nullif("system_name", F.lit("")), F.col("table_name"))))).alias("node"))
    kept = types.union(tables["edges"].sparkSession.createDataFrame([(seed.node,)], "node string")).distinct()
    found = contract(flow, kept).where("src <> dst")
    file_of = lambda c: F.concat(F.lit("file:"), F.regexp_replace(F.regexp_replace(c, "^column:", ""), r"\.[^.]*$", ""))
    columns = tables["edges"].where("kind = 'derives_from' AND src LIKE 'column:%' AND dst LIKE 'column:%'").select(file_of("src").alias("down"), file_of("dst").alias("up"), "src", "dst").distinct()
    counts = evidence_counts(columns).select(F.col("down").alias("e_src"), F.col("up").alias("e_dst"), F.col("n").alias("evidence"))
    # evidence through files that are contracted: the widest path's narrowest count
    through = closure(kept.select(F.col("node").alias("seed"), "node"), counts.select(F.col("e_src").alias("src"), F.col("e_dst").alias("dst"), F.col("evidence").alias("rank")), stop=kept)
    through = through.select(F.col("seed").alias("src"), F.col("node").alias("dst"), F.col("rank").alias("evidence"))
    rows = found.join(through, ["src", "dst"], "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)))
    some = rows.groupBy("src").agg(F.max("evidence").alias("_best"))
    return rows.join(some, "src").where("evidence > 0 OR _best = 0").drop("_best")


def pruned(near: DataFrame, edges: DataFrame, seed: Seed) -> tuple[list[dict], list[dict], dict]:
    """Nodes and edges of a cone that a page can show, and what was left out: calls, call-only programs, the deepest layers."""
    data = merge_parallel(within(edges, near).where("kind <> 'calls'"))
    files = near.where("node NOT LIKE 'column:%'")
    data = data.where("src NOT LIKE 'column:%' AND dst NOT LIKE 'column:%'")
    touched = data.select("src").union(data.select("dst")).distinct().withColumnRenamed("src", "node")
    kept = files.join(touched, "node", "left_semi").union(files.where(F.col("node") == seed.node)).distinct()
    by_depth = {r["depth"]: r["count"] for r in kept.groupBy("depth").count().collect()}
    deep = data.join(kept.select(F.col("node").alias("src"), F.col("depth").alias("a")), "src").join(kept.select(F.col("node").alias("dst"), F.col("depth").alias("b")), "dst").withColumn("depth", F.greatest("a", "b"))
    edges_by_depth = {r["depth"]: r["count"] for r in deep.groupBy("depth").count().collect()}
    cap = max(by_depth, default=0)
    within_cap = lambda counts, cap: sum(n for d, n in counts.items() if d <= cap)
    while cap > 1 and (within_cap(by_depth, cap) > MOST_NODES or within_cap(edges_by_depth, cap) > MOST_EDGES):
        cap -= 1
    nodes = [r.asDict() for r in kept.where(F.col("depth") <= cap).orderBy("depth", "node").collect()]
    rows = [r.asDict() for r in deep.where(F.col("depth") <= cap).select("src", "dst", "kind", "n", "provenance", "confidence").orderBy("src", "dst", "kind").collect()]
    total = sum(by_depth.values())
    return nodes, rows, {"total_nodes": total, "depth_cap": cap, "max_depth": max(by_depth, default=0), "nodes_beyond_cut": total - len(nodes)}


def layout(nodes: list[dict], edges: list[dict], passes: int = 3) -> dict[str, tuple[int, int]]:
    """(layer, place) of each node: deepest first, each layer ordered by the mean place of its neighbours."""
    deepest = max((n["depth"] for n in nodes), default=0)
    layers: dict[int, list[str]] = {}
    for n in nodes:
        layers.setdefault(deepest - n["depth"], []).append(n["node"])
    near: dict[str, set[str]] = {n["node"]: set() for n in nodes}
    for e in edges:
        if e["src"] in near and e["dst"] in near:
            near[e["src"]].add(e["dst"])
            near[e["dst"]].add(e["src"])
    place = {n: i for names in layers.values() for i, n in enumerate(sorted(names))}
    for _ in range(passes):
        for layer in sorted(layers):
            mean = lambda n: (sum(place[m] for m in near[n]) / len(near[n]) if near[n] else place[n], n)
            layers[layer].sort(key=mean)
            place.update({n: i for i, n in enumerate(layers[layer])})
    return {n: (layer, place[n]) for layer, names in layers.items() for n in names}


STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #bbb;padding:3px 8px;text-align:left}svg{border:1px solid #bbb}svg text{font:11px sans-serif}.kpi{display:inline-block;margin-right:2em}.kpi b{font-size:1.6em;display:block}"
SCRIPT = """const svg=document.querySelector('svg');if(svg){let v=svg.viewBox.baseVal,d=null;
svg.addEventListener('wheel',e=>{e.preventDefault();const k=e.deltaY>0?1.15:1/1.15;v.x+=v.width*(1-k)/2;v.y+=v.height*(1-k)/2;v.width*=k;v.height*=k});
svg.addEventListener('mousedown',e=>d=[e.clientX,e.clientY,v.x,v.y]);window.addEventListener('mouseup',()=>d=null);
window.addEventListener('mousemove',e=>{if(!d)return;const s=v.width/svg.clientWidth;v.x=d[2]-(e.clientX-d[0])*s;v.y=d[3]-(e.clientY-d[1])*s});
svg.querySelectorAll('[data-node]').forEach(n=>{n.addEventListener('mouseenter',()=>svg.querySelectorAll('[data-ends]').forEach(p=>p.style.opacity=p.dataset.ends.split(' ').includes(n.dataset.node)?1:.15));
n.addEventListener('mouseleave',()=>svg.querySelectorAll('[data-ends]').forEach(p=>p.style.opacity=1));
n.addEventListener('click',()=>{const t=document.getElementById('about');if(t)t.textContent=n.dataset.node})})}"""
COLOURS = {"confirmed": "#2b6cb0", "parsed": "#2f855a", "inferred": "#b7791f", "unresolved": "#c53030"}


def _page(title: str, *parts: str) -> str:
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>{''.join(parts)}<script>{SCRIPT}</script></body></html>"


def _table(head: tuple[str, ...], rows: list[tuple]) -> str:
    cells = lambda tag, row: "<tr>" + "".join(f"<{tag}>{html.escape(str('' if x is None else x))}</{tag}>" for x in row) + "</tr>"
    return f"<table>{cells('th', head)}{''.join(cells('td', r) for r in rows)}</table>" if rows else "<p>none</p>"


def diagram(nodes: list[dict], edges: list[dict], seed: Seed) -> str:
    at = layout(nodes, edges)
    x = lambda n: 20 + at[n][0] * 260
    y = lambda n: 30 + at[n][1] * 44
    lines = []
    for e in edges:
        if e["src"] in at and e["dst"] in at:
            a, b = (e["src"], e["dst"]) if e["kind"] == "writes" else (e["dst"], e["src"])  # drawn the way data flows
            x1, y1, x2, y2 = x(a) + 190, y(a) + 14, x(b), y(b) + 14
            lines.append(f"<path data-ends='{html.escape(a)} {html.escape(b)}' d='M{x1},{y1} C{x1 + 40},{y1} {x2 - 40},{y2} {x2},{y2}' fill='none' stroke='{COLOURS.get(e['confidence'], '#718096')}' stroke-dasharray='{'' if e['confidence'] in ('confirmed', 'parsed') else '4'}'><title>{html.escape(e['kind'])} x{e['n']} ({html.escape(e['provenance'])}, {html.escape(e['confidence'])})</title></path>")
    boxes = [
        f"<g data-node='{html.escape(n['node'])}'><rect x='{x(n['node'])}' y='{y(n['node'])}' width='190' height='28' rx='{4 if n['node'].startswith('file:') else 14}' fill='{'#fefcbf' if n['node'] == seed.node else '#edf2f7'}' stroke='#4a5568'/><text x='{x(n['node']) + 8}' y='{y(n['node']) + 18}'>{html.escape(n['node'].partition(':')[2])}</text></g>"
        for n in nodes
    ]
    width = 240 + 260 * max((p[0] for p in at.values()), default=0)
    height = 90 + 44 * max((p[1] for p in at.values()), default=0)
    return f"<svg width='100%' height='{min(height, 800)}' viewBox='0 0 {width} {height}'>{''.join(lines)}{''.join(boxes)}</svg><p id='about'></p>"


def output_page(spark: SparkSession, tables: dict[str, DataFrame], seed: Seed, traces: str = "") -> str:
    near = cone(spark, tables["edges"], seed).persist()
    nodes, edges, left_out = pruned(near, tables["edges"], seed)
    feeders = [(r["src"], r["dst"], NAMES.get(min(r["rank"], 3), ""), r["evidence"]) for r in physical_flow(tables, lineage_flow(within(tables["edges"], near)), seed).orderBy("src", "dst").limit(MOST_EDGES).collect()]
    near.unpersist()
    note = f"<p>{left_out['nodes_beyond_cut']} nodes beyond layer {left_out['depth_cap']} are not drawn.</p>" if left_out["nodes_beyond_cut"] else ""
    return _page(f"{seed.id}: {seed.node}", diagram(nodes, edges, seed), note, "<h2>Tables</h2>", _table(("made", "from", "confidence", "columns"), feeders), "<h2>Columns</h2>", f"<pre>{html.escape(traces)}</pre>" if traces else "")


def summary_page(spark: SparkSession, tables: dict[str, DataFrame], config: Config) -> str:
    found = coverage(spark, tables, config)
    total = found["summary"]
    kpis = "".join(f"<span class='kpi'><b>{total[k]}</b>{html.escape(t)}</span>" for k, t in (("n_outputs", "outputs"), ("n_resolved", "resolved"), ("n_partial", "partial"), ("n_unresolved", "unresolved"), ("resolved_pct", "% resolved")))
    used = tables["output_lineage"].where("source_column IS NOT NULL").groupBy("output_id").agg(F.count_distinct("source_file", "source_column").alias("n"))
    columns = {r["output_id"]: r["n"] for r in used.collect()}
    scores = [(r["output_id"], found["outputs"].get(r["output_id"]), columns.get(r["output_id"], 0), r["path_depth"], r["complex_pgms"], r["override_depth"], r["unresolved"], r["bucket"]) for r in tables["complexity_scores"].orderBy("output_id").collect()]
    candidates = [(c["rank"], c["kind"], c["fanout"], ", ".join(c["outputs"]), ", ".join(c["shared_sources"])) for c in (json.loads(r["payload"]) for r in tables["product_candidates"].orderBy("rank").collect())]
    shared = [(r["source_id"], r["n_outputs"]) for r in analysis.top_shared(tables["commonality_matrix"]).collect()]
    classes = [(r["program_class"], r["count"]) for r in tables["program_classification"].groupBy("program_class").count().orderBy(F.desc("count"), "program_class").collect()]
    gaps = sorted(found["gaps_by_kind"].items(), key=lambda kv: (-kv[1], kv[0]))
    return _page("Lineage summary", kpis, "<h2>Outputs</h2>", _table(("output", "coverage", "columns", "depth", "complex programs", "overrides", "unresolved", "effort"), scores), "<h2>Candidates</h2>", _table(("rank", "kind", "outputs", "which", "shared sources"), candidates), "<h2>Most shared sources</h2>", _table(("source", "outputs"), shared), "<h2>Programs</h2>", _table(("class", "programs"), classes), "<h2>Gaps</h2>", _table(("kind", "rows"), gaps))


def write_reports(spark: SparkSession, tables: dict[str, DataFrame], config: Config, folder: str, form: str = "csv") -> None:
    from .trace import trace_table

    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    export_tables(tables, f"{folder}/tables", form)
    export_cones(spark, tables, config, f"{folder}/cones")
    (out / "coverage.json").write_text(json.dumps(coverage(spark, tables, config), sort_keys=True, indent=1), encoding="utf-8")
    (out / "summary.html").write_text(summary_page(spark, tables, config), encoding="utf-8")
    for seed in config.seeds:
        (out / f"{seed.id}.html").write_text(output_page(spark, tables, seed, trace_table(spark, tables, f"{seed.library}/{seed.file}")), encoding="utf-8")



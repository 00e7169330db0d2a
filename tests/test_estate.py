"""The whole run over the small estate, held against the answers worked out by hand."""

import json

import estate
import pytest
from pyspark.sql import functions as F

from headwater.plans import pipeline, report, trace
from headwater.sources.store import LAYERS, Store


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    for name, df in pipeline.run(spark, estate.raw_tables(spark), estate.CONFIG).items():
        if any(name in t for t in LAYERS.values()):
            store.write(name, df)
    return store.tables(*LAYERS)


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


LINEAGE = {
    ("BILLS", "derives", "SITE", None, 3, "confirmed"),
    ("BILLS", "derives", "READOLD", None, 2, "parsed"),
    ("BILLS", "derives", "SITE", "STREET", 2, "parsed"),
    ("BILLS", "derives", "SITE", "SITEID", 2, "parsed"),
    ("BILLS", "derives", "READOLD", "VOLUME", 1, "parsed"),
    ("BILLS", "used", "READOLD", "MTRID", 2, "parsed"),
    *{("BILLS", "used", "READOLD", c, 2, "inferred") for c in ("RDATE", "VOLUME")},
    ("USAGE", "derives", "METER", None, 2, "confirmed"),
    ("USAGE", "derives", "READING", None, 2, "confirmed"),
    *{("USAGE", "derives", "READING", c, 1, "parsed") for c in ("MTRID", "VOLUME")},
    ("USAGE", "derives", "METER", "FACTOR", 1, "parsed"),
    *{("USAGE", "used", "READING", c, 2, "parsed") for c in ("MTRID", "VOLUME")},
    *{("USAGE", "used", "METER", c, 2, "parsed") for c in ("MTRID", "FACTOR", "INSTALL")},
    ("DAILY", "derives", "READING", None, 2, "confirmed"),
    *{("DAILY", "derives", "READING", c, 1, "parsed") for c in ("RDATE", "VOLUME")},
    *{("DAILY", "used", "READING", c, 2, "inferred") for c in ("MTRID", "RDATE", "VOLUME")},
}


def test_output_lineage(tables):
    found = rows(tables["output_lineage"], "output_id", "relation", F.regexp_replace("source_file", "^file:HYDLIB/", ""), "source_column", "path_len", "min_confidence")
    assert found == LINEAGE


def test_complexity_and_coverage(spark, tables):
    found = {r["output_id"]: r for r in tables["complexity_scores"].collect()}
    assert {k: (r["path_depth"], r["complex_pgms"], r["bucket"]) for k, r in found.items()} == {
        "BILLS": (3, 0, "moderate"),
        "USAGE": (2, 0, "replicate_as_view"),
        "DAILY": (2, 0, "replicate_as_view"),
        "PLANNED": (0, 0, "full_reengineering"),
    }
    assert found["BILLS"]["override_depth"] > 0 and found["DAILY"]["override_depth"] == 0 and all(r["unresolved"] == 0 for r in found.values())
    status = report.coverage(spark, tables, estate.CONFIG)
    assert status["outputs"]["PLANNED"] == "unresolved" and status["summary"]["n_outputs"] == 4


def test_candidates(tables):
    found = [json.loads(r["payload"]) for r in tables["product_candidates"].orderBy("rank").collect()]
    assert [(c["rank"], c["kind"], c["outputs"], c["fanout"], c["shared_sources"]) for c in found] == [(1, "cluster", ["DAILY", "USAGE"], 2, ["file:HYDLIB/READING"])]


def test_an_override_reaches_programs_that_called_ones_call(tables):
    reads = lambda program: rows(tables["edges"].where(f"src = 'program:HYDLIB/{program}' AND kind = 'reads' AND dst LIKE 'file:%'"), "dst", "provenance")
    assert ("file:HYDLIB/READOLD", "source_cl") in reads("BILLRUN") and not any(d == "file:HYDLIB/READING" for d, _ in reads("BILLRUN"))
    for program in ("USEXT", "SUMRUN"):
        assert ("file:HYDLIB/READING", "xref") in reads(program) and not any(d == "file:HYDLIB/READOLD" for d, _ in reads(program))


def test_every_edge_has_provenance_and_confidence(tables):
    assert tables["edges"].where("provenance IS NULL OR confidence IS NULL OR kind IS NULL").isEmpty()
    assert tables["edges"].count() == tables["edges"].select("src", "dst", "kind", "provenance", "confidence").distinct().count()


def test_gaps(tables):
    found = rows(tables["gaps"], "kind", "object_id")
    assert {("missing_source", "program:HYDLIB/LOSTPGM"), ("no_lineage", "file:HYDLIB/NOTYET"), ("unresolved_dynamic_name", "program:HYDLIB/VARCL")} <= found


def test_analysing_again_repeats_no_gap(spark, tables):
    again = pipeline.analyse(spark, tables, estate.CONFIG)
    assert again["gaps"].where("kind = 'no_lineage'").count() == 1


def test_trace_passes_over_logical_files(spark, tables):
    text = trace.trace_table(spark, tables, "hydlib/bill")
    assert "STREETNM  → 1 base column, min confidence parsed" in text and "collapsed_via=HYDLIB/SITELF.STREETNM" in text
    raw = trace.trace_table(spark, tables, "HYDLIB.BILL", raw=True)
    assert "column:HYDLIB/SITELF.STREETNM" in raw and "collapsed_via" not in raw
    usage = trace.trace_table(spark, tables, "HYDLIB/USAGEX")
    assert "VOL  → 2 base columns" in usage and "STAMP  → no resolved lineage" in usage


def test_a_view_over_a_join_of_columns(tables):
    found = rows(tables["edges"].where("src = 'column:HYDLIB/ZONEV.PLACE'"), "dst", "kind")
    assert found == {("column:HYDLIB/SITE.STREET", "derives_from"), ("column:HYDLIB/SITE.POSTCD", "derives_from")}


def test_diagnose_names_the_writer(spark, tables):
    text = "\n".join(trace.diagnose(spark, tables, "HYDLIB/USAGEX"))
    assert "<- writes: program:HYDLIB/USEXT" in text and "HYDLIB/USEXT: sql_pure" in text and "missing_source: 1" in text


def test_physical_flow_has_tables_only(spark, tables):
    from headwater.operators.closure import lineage_flow

    found = rows(report.physical_flow(tables, lineage_flow(tables["edges"]), estate.CONFIG.seeds[0]), "src", "dst")
    assert ("file:HYDLIB/BILL", "file:HYDLIB/READOLD") in found and ("file:HYDLIB/BILL", "file:HYDLIB/SITE") in found
    assert not any("SITELF" in s + d or "program" in s + d for s, d in found)


def test_reports(spark, tables, tmp_path):
    report.write_reports(spark, tables, estate.CONFIG, str(tmp_path))
    summary = (tmp_path / "summary.html").read_text()
    page = (tmp_path / "BILLS.html").read_text()
    assert "USAGE" in summary and "replicate_as_view" in summary and "<svg" in page and "HYDLIB/READOLD" in page
    assert json.loads((tmp_path / "coverage.json").read_text())["summary"]["n_outputs"] == 4
    assert spark.read.option("header", True).csv(str(tmp_path / "tables" / "edges")).count() == tables["edges"].count()
    assert not spark.read.json(str(tmp_path / "cones" / "USAGE" / "edges")).isEmpty()


def test_partial_override_keeps_both_files(spark):
    members = dict(estate.MEMBERS)
    members["CLSRC", "STEPCL", "CLLE"] = ["PGM", "CALL PGM(SUMRUN)", "OVRDBF FILE(READING) TOFILE(HYDLIB/METER)", "CALL PGM(SUMRUN)", "ENDPGM"]
    members["CLSRC", "NIGHTCL", "CLP"] = ["PGM", "ENDPGM"]
    del members["CLSRC", "VARCL", "CLP"]
    raw = estate.raw_tables(spark, estate.raw_rows(members))
    graph = pipeline.build(spark, raw | pipeline.parse(raw["raw_source_members"]), estate.CONFIG)
    reads = rows(graph["edges"].where("src = 'program:HYDLIB/SUMRUN' AND kind = 'reads' AND dst LIKE 'file:%'"), "dst")
    assert {("file:HYDLIB/METER",), ("file:HYDLIB/READING",)} <= reads


def test_move_chain_and_untraced_fields(spark):
    e = estate
    members = {
        ("RPGSRC", "BUF", "RPG"): [
            e.f_spec("INBUF", "I", "F"), e.f_spec("OUTBUF", "O", "F"),
            e.i_spec("INBUF"), e.i_spec("", "INFLD", "1", "5"),
            e.c_spec("", "MOVE", "INFLD", "WORK1"), e.c_spec("", "MOVEL", "WORK1", "OUTA"), e.c_spec("", "Z-ADD", "0", "OUTB"), e.c_spec("", "MOVE", "UDATE", "OUTC"), e.c_spec("", "MOVE", "NOWHERE", "OUTD"),
            e.o_spec("OUTBUF"), e.o_spec("", "OUTA", "5"), e.o_spec("", "OUTB", "10"), e.o_spec("", "OUTC", "16"), e.o_spec("", "OUTD", "20"), e.o_spec("", "OUTE", "25"), e.o_spec("", "PAGE", "30"),
        ],
    }
    fields = {"INBUF": ["RECORD"], "OUTBUF": ["OUTA", "OUTB", "OUTC", "OUTD", "OUTE"]}
    refs = [("BUF", "INBUF", "*FILE", "1"), ("BUF", "OUTBUF", "*FILE", "2")]
    raw = e.raw_tables(spark, e.raw_rows(members, refs, fields) | {"raw_dspdbr": [], "raw_sysviews": [], "raw_sysviewdep": []})
    parsed = pipeline.parse(raw["raw_source_members"])
    assert rows(parsed["program_classification"], "program_class", "needs_review") == {("program_described_or_complex", True)}
    graph = pipeline.build(spark, raw | parsed, e.CONFIG)
    made = rows(graph["edges"].where("provenance = 'source_rpg' AND kind = 'derives_from'"), "src", "dst", "confidence", F.col("context")["via"], F.col("context")["mechanism"])
    assert made == {("column:HYDLIB/OUTBUF.OUTA", "column:HYDLIB/INBUF.INFLD", "parsed", "WORK1", "cspec_move_chain")}
    why = rows(graph["gaps"].where("kind = 'rpg_untraced_output_field'"), F.substring_index("object_id", ".", -1), F.col("context")["reason"])
    assert why == {("OUTB", "constant"), ("OUTC", "runtime_value"), ("OUTD", "work_variables"), ("OUTE", "unowned")}

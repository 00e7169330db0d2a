"""Sessions, extraction, the store, configuration, logs, the stream and the command line."""

import json

import estate
import pytest

from headwater import cli
from headwater.progress import Progress, shown_duration
from headwater.sources import calllog, catalog, config, extract, host, members, profiler
from headwater.sources.store import LAYERS, Store


def responses():
    """What a host would answer about the estate, by tag; catalog labels differ from ours and are taken by place or synonym."""
    raw = estate.raw_rows()
    label = {"raw_systables": ["TABLE_SCHEMA", "TABLE_NAME", "SYSTEM_TABLE_NAME", "TABLE_TYPE", "FILE_TYPE", "CARD", "LONG_COMMENT"], "raw_dspdbr": ["WHRELI", "WHREFI", "WHRLI", "WHRFI", "WHTYPE"], "raw_sysviewdep": ["VIEW_SCHEMA", "VIEW_NAME", "TABLE_SCHEMA", "TABLE_NAME", "OBJECT_TYPE"]}
    columns = lambda t: label.get(t) or [c.split()[0].upper() for c in LAYERS["raw"][t].split(", ")]
    out = {f"catalog.{t.removeprefix('raw_')}": {"columns": columns(t), "rows": raw.get(t, [])} for t in ("raw_systables", "raw_syscolumns", "raw_sysviews", "raw_sysviewdep", "raw_syspartitionstat")}
    out |= {f"xref.{t.removeprefix('raw_')}": {"columns": columns(t), "rows": raw[t]} for t in ("raw_dsppgmref", "raw_dspdbr", "raw_dspffd")}
    for srcfile in ("CLSRC", "RPGSRC", "DDSSRC"):
        own = {(m, t): lines for (s, m, t), lines in estate.MEMBERS.items() if s == srcfile}
        out[f"source.members.HYDLIB.{srcfile}"] = {"columns": ["MEMBER", "MEMBER_TYPE"], "rows": list(own)}
        out |= {f"source.text.HYDLIB.{srcfile}.{m}": {"columns": ["SRCSEQ", "SRCDTA"], "rows": [[i, x] for i, x in enumerate(lines, 1)]} for (m, _), lines in own.items()}
    out["probe.env"] = {"columns": ["OS_VERSION", "OS_RELEASE"], "rows": [[7, 4]]}
    out["probe.ifs_read"] = {"columns": ["N"], "rows": [[1]]}
    return out


def test_probe_degrades_step_by_step():
    found = host.probe(host.RecordedSession(responses()))
    assert found.label == "V7R4" and found.has_ifs_read and found.columns == {}
    assert host.HostProfile.of_rows(found.rows()) == found
    assert host.probe(host.RecordedSession({})).label == "unknown"


def test_recorded_session_serves_files(tmp_path):
    host.RecordedSession.record({"a": {"columns": ["X"], "rows": [[1]]}}, tmp_path)
    session = host.open_session(None, {"kind": "recorded", "folder": str(tmp_path)})
    assert session.with_tag("a").query("SELECT 1").rows == [(1,)]
    with pytest.raises(host.HostError):
        session.query("SELECT 2")
    assert host.source_of(session, "L", "P") is None and host.sources_in_bulk(session, "L") is None


def test_jdbc_retries_and_gives_up(spark):
    waits = []
    session = host.JdbcSession(spark, "jdbc:none:x", "u", "p", "no.such.Driver", sleep=waits.append)
    with pytest.raises(host.HostError):
        session.query("SELECT 1")
    assert waits == [2, 4, 8, 16]
    with pytest.raises(host.HostError, match="scratch"):
        extract.Extractor(spark, session, estate.CONFIG, None)


def test_full_and_targeted_extraction_agree(spark, tmp_path):
    found = {}
    for how in ("full", "targeted"):
        store = Store(spark, str(tmp_path / how))
        extractor = extract.Extractor(spark, host.RecordedSession(responses()), estate.CONFIG, store)
        getattr(extractor, how)() if how == "full" else extractor.targeted(rounds=2)
        found[how] = {tuple(r) for r in store.read("raw_systables").select("table_name").collect()}
        assert store.read("raw_source_members").where("member = 'BILLRUN'").count() == 6
        if how == "full":
            assert store.count("raw_dsppgmref") == 15 and store.count("raw_syscolumns") == 27
            assert members.has_text(store.read("raw_source_members"))
        else:
            kinds = {(r["kind"], r["name"]) for r in store.read("slice_objects").collect()}
            assert {("file", "SITE"), ("file", "READOLD"), ("program", "BILLRUN"), ("program", "NIGHTCL"), ("program", "STEPCL")} <= kinds
    assert found["targeted"] < found["full"]


def test_dead_library_is_asked_once(spark, tmp_path):
    bad = {"command:DSPPGMREF PGM(HYDLIB/*ALL) OUTPUT(*OUTFILE) OUTFILE(QTEMP/DSPPGMREF)": RuntimeError("CPF9810 library not found")}
    session = host.RecordedSession(responses() | bad)
    extractor = extract.Extractor(spark, session, estate.CONFIG, Store(spark, str(tmp_path)))
    extractor.outfiles()
    assert extractor.notes.dead == {"HYDLIB"} and len(session.commands) == 1


def test_pull_text_and_shape_errors(spark):
    pull = catalog.PULLS["raw_syspartitionstat"]
    text = extract.select_text(pull, {"TABLE_SCHEMA", "TABLE_NAME", "TABLE_PARTITION", "SYSTEM_TABLE_NAME"}, "A = 1")
    assert "TABLE_PARTITION AS PARTITION_NAME" in text and "CAST(NULL AS VARCHAR(1)) AS NUMBER_ROWS" in text and text.endswith("WHERE A = 1")
    with pytest.raises(ValueError, match="partition_name"):
        extract.select_text(pull, {"TABLE_SCHEMA", "TABLE_NAME"})
    rows = spark.createDataFrame([(" L ", "P ", "L", "F", "*FILE", "1", "x7")], "WHLIB string, whpnam string, WHLNAM string, WHFNAM string, WHOBJT string, WHFUSG string, WHNCNT string")
    assert tuple(catalog.conform(rows, catalog.PULLS["raw_dsppgmref"]).first()) == ("L", "P", "L", "F", "*FILE", "1", None)
    assert extract.pair_predicates("S", "N", [("A", "X'Y"), ("A", "B"), ("C", "D")], "M", chunk=2) == ["(S = 'A' AND (N IN ('B', 'X''Y') OR M IN ('B', 'X''Y')))", "(S = 'C' AND (N IN ('D') OR M IN ('D')))"]


@pytest.mark.parametrize(("way", "known", "commands"), [("auto", None, 0), ("ifs", None, 0), ("alias", None, 4), ("auto", False, 4), ("auto", True, 0)])
def test_each_member_is_named_in_the_text_sent(spark, way, known, commands):
    tag = "source.text.HYDLIB.S."
    session = host.RecordedSession({tag + m: {"columns": ["N", "T"], "rows": [[1, f"text of {m}"]]} for m in ("ONE", "TWO")})
    profile = None if known is None else host.HostProfile("7", "4", has_ifs_read=known)
    settings = config.from_dict({"libraries": ["HYDLIB"], "seeds": [{"id": "x", "library": "L", "file": "F"}], "scratch": "WORK", "source_strategy": way})
    reader = extract.Extractor(spark, session, settings, None, profile).reader()
    assert [reader.read("HYDLIB", "S", m) for m in ("ONE", "TWO")] == [["text of ONE"], ["text of TWO"]]
    sent = [sql for _, sql, _ in session.queries]
    assert len(session.commands) == commands and len(sent) == 2
    if commands:
        assert session.commands[:2] == ["RUNSQL SQL('CREATE OR REPLACE ALIAS WORK.HWMEMBER FOR HYDLIB.S (ONE)') COMMIT(*NONE)", "RUNSQL SQL('DROP ALIAS WORK.HWMEMBER') COMMIT(*NONE)"]
        assert "(TWO)" in session.commands[2] and sent == ["SELECT SRCSEQ, SRCDTA FROM WORK.HWMEMBER ORDER BY SRCSEQ"] * 2
    else:
        assert "PATH_NAME => '/QSYS.LIB/HYDLIB.LIB/S.FILE/ONE.MBR'" in sent[0] and "/TWO.MBR'" in sent[1]


def test_member_reader_gives_up_on_paths():
    asked = []

    def by_path(*where):
        asked.append(where)
        return []

    reader = members.MemberReader(by_path, lambda *w: ["x"], patience=2)
    assert [reader.read("L", "F", m) for m in "ABC"] == [["x"]] * 3 and len(asked) == 2 and reader.mode == "alias"

    def broken(*where):
        raise OSError("no alias")

    reader = members.MemberReader(by_path, broken)
    assert reader.read("L", "F", "A") == [] and reader.stats.failed == 1 and "no lines; no alias" in reader.stats.errors[0]


def test_store_layers_and_late_columns(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("output_lineage", spark.createDataFrame([("o", "f")], "output_id string, source_file string"))
    row = store.read("output_lineage").first()
    assert row["relation"] is None and row["source_file"] == "f"
    store.write("output_lineage", store.read("output_lineage"))
    store.write("output_lineage", store.read("output_lineage"), "append")
    assert store.count("output_lineage") == 2
    store.reset("analysis")
    assert store.count("output_lineage") == 0
    with pytest.raises(ValueError):
        store.reset("nothing")
    with pytest.raises(ValueError):
        store.read("nothing")


def test_config_checks():
    seed = {"id": "a", "library": "L", "file": "F"}
    good = config.from_dict({"libraries": ["l"], "seeds": [seed], "source_strategy": "IFS"})
    assert good.search_list == ("L",) and good.options["source_strategy"] == "ifs" and good.seeds[0].node == "file:L/F"
    for bad in ({"seeds": [seed]}, {"libraries": ["L"]}, {"libraries": ["L"], "seeds": [seed, seed]}, {"libraries": ["L"], "seeds": [{"id": "a"}]}, {"libraries": ["L"], "seeds": [seed], "extract_mode": "x"}):
        with pytest.raises(config.ConfigError):
            config.from_dict(bad)


def test_advice():
    assert len(profiler.recommend({"columns": 50_001, "source_members": 5_001, "seed_classes": {"lf": 1}, "probe_seconds": {"a": 6}, "programs": 2_001})) == 5
    assert profiler.recommend({"columns": 10})[0].startswith("the estate is modest")


def test_call_log_and_stream(spark, tmp_path):
    from headwater.streaming import calls

    log = calllog.CallLog(tmp_path / "log" / "a.jsonl", clock=lambda: 1_700_000_000.25)
    session = calllog.LoggedSession(host.RecordedSession({"t": {"columns": ["X"], "rows": []}}), log)
    session.query("S" * 500, tag="t")
    with pytest.raises(host.HostError):
        session.query("S", tag="missing")
    found = calllog.read_log(spark, str(tmp_path / "log"))
    assert {(r["tag"], r["n"], r["n_failed"]) for r in calllog.bottlenecks(found).collect()} == {("t", 1, 0), ("missing", 1, 1)}
    assert len(found.where("tag = 't'").first()["text"]) == 400
    stream = calls.call_rates(calls.read_calls(spark, str(tmp_path / "log")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("rates").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["tag"], r["n"]) for r in spark.sql("SELECT * FROM rates").collect()} == {("t", 1), ("missing", 1)}
    failed = calls.failures(calls.read_calls(spark, str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("failures").start()
    failed.processAllAvailable()
    failed.stop()
    assert spark.sql("SELECT sum(n) AS n FROM failures").first()["n"] == 1


def test_a_logged_session_pulls_and_is_known_by_its_own_kind(spark, tmp_path):
    log = calllog.CallLog(tmp_path / "a.jsonl")
    session = calllog.LoggedSession(host.RecordedSession(responses()), log)
    extractor = extract.Extractor(spark, session, estate.CONFIG, Store(spark, str(tmp_path / "store")))
    extractor.catalog()
    assert extractor.notes.failed == [] and extractor.store.count("raw_syscolumns") == sum(map(len, estate.FIELDS.values()))
    assert {r["tag"] for r in calllog.read_log(spark, str(tmp_path / "a.jsonl")).where("ok").collect()} >= {"catalog.systables", "catalog.syscolumns"}
    with pytest.raises(host.HostError, match="scratch"):
        extract.Extractor(spark, calllog.LoggedSession(object.__new__(host.JdbcSession), log), estate.CONFIG, extractor.store)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "config.yaml").write_text("libraries: [HYDLIB]\nsource_files: [CLSRC, RPGSRC, DDSSRC]\nseeds:\n  - {id: USAGE, library: HYDLIB, file: USAGEX}\n")
    host.RecordedSession.record(responses(), tmp_path / "host")
    (tmp_path / "session.json").write_text(json.dumps({"kind": "recorded", "folder": str(tmp_path / "host")}))
    base = ["--quiet", "--config", str(tmp_path / "config.yaml"), "--store", str(tmp_path / "store")]
    run = lambda *a: cli.main([*base, *a], spark)
    assert run("probe", "--session", str(tmp_path / "session.json")) == 0
    assert run("profile", "--session", str(tmp_path / "session.json"), "--out", str(tmp_path / "profile.json")) == 0
    assert "advice" in json.loads((tmp_path / "profile.json").read_text())
    assert run("run", "--session", str(tmp_path / "session.json"), "--out", str(tmp_path / "report")) == 0
    assert (tmp_path / "report" / "USAGE.html").exists()
    capsys.readouterr()
    assert run("query", "SELECT output_id, count(*) AS n FROM output_lineage GROUP BY 1", "--csv") == 0
    assert capsys.readouterr().out.splitlines() == ["output_id,n", "USAGE,10"]
    assert run("query", "DROP TABLE edges") == 1 and run("query", "SELECT nothing FROM nowhere") == 1
    capsys.readouterr()
    assert run("trace-columns", "--table", "HYDLIB/USAGEX") == 0 and "VOL  → 2 base columns" in capsys.readouterr().out
    assert run("diagnose", "--table", "HYDLIB/USAGEX") == 0 and "known names: USAGEX" in capsys.readouterr().out
    assert run("sql-errors") == 0
    assert run("query", "SELECT count(*) AS n FROM call_log", "--logs", str(tmp_path / "store" / "logs" / "calls.jsonl")) == 0


def test_progress_lines():
    import io

    out, now = io.StringIO(), [0.0]
    say = Progress(out, clock=lambda: now[0])
    say.phase("extract")
    say.start("x")
    for i in range(1, 6):
        now[0] += 0.4
        say.tick("x", i, 5)
    say.done("x", "5 rows")
    say.close()
    text = out.getvalue()
    assert text.count("x: ") < 6 and "x: 5/5" in text and "x done in 00:02: 5 rows" in text
    assert shown_duration(3725) == "1:02:05"

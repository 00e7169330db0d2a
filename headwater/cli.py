"""Command line: extract, profile, probe, parse, build, analyze, trace-columns, report, diagnose, query, sql-errors, run."""

from __future__ import annotations

import argparse
import csv
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from .plans import pipeline, report, trace
from .progress import Progress, Silent
from .session import local_session
from .sources import calllog, profiler
from .sources.config import load
from .sources.extract import Extractor
from .sources.host import open_session, probe
from .sources.store import LAYERS, Store


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="headwater", description=__doc__)
    top.add_argument("--config", default="config.yaml")
    top.add_argument("--store", default="store")
    top.add_argument("--quiet", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("extract", "run"):
        p = sub.add_parser(name)
        p.add_argument("--session", required=True, help="JSON file that says how to reach the host")
        p.add_argument("--targeted", action="store_true")
    for name in ("probe", "profile"):
        p = sub.add_parser(name)
        p.add_argument("--session", required=True)
        p.add_argument("--out")
    sub.add_parser("parse")
    sub.add_parser("build").add_argument("--phase", type=int, default=3, choices=(1, 2, 3))
    sub.add_parser("analyze")
    p = sub.add_parser("trace-columns")
    p.add_argument("--table", required=True)
    p.add_argument("--out")
    p.add_argument("--raw", action="store_true")
    for name in ("report", "run"):
        p = sub.choices.get(name) or sub.add_parser(name)
        p.add_argument("--out", default="report")
        p.add_argument("--fmt", default="csv", choices=("csv", "parquet"))
    p = sub.add_parser("diagnose")
    p.add_argument("--table", required=True)
    p.add_argument("--limit", type=int, default=12)
    p = sub.add_parser("query")
    p.add_argument("sql")
    p.add_argument("--csv", action="store_true")
    p.add_argument("--logs", help="call logs to read as the view call_log")
    p = sub.add_parser("sql-errors")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--samples", type=int, default=3)
    p.add_argument("--out")
    return top


def _show(columns: list[str], rows: list[tuple], as_csv: bool) -> None:
    if as_csv:
        writer = csv.writer(sys.stdout)
        writer.writerow(columns)
        writer.writerows(rows)
        return
    cells = [columns, *[["" if v is None else str(v)[:80] for v in r] for r in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    for r in cells:
        print("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip())


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _arguments().parse_args(argv)
    say = Silent() if args.quiet else Progress()
    spark = spark or local_session("*")
    store = Store(spark, args.store)
    if args.command == "query":
        store.views()
        if args.logs:
            calllog.read_log(spark, *args.logs.split(",")).createOrReplaceTempView("call_log")
        try:
            if not args.sql.lstrip().lower().startswith(("select", "with", "show", "describe", "values", "from")):
                raise ValueError("the store is read only: a query is asked for")
            found = spark.sql(args.sql)
            _show(found.columns, [tuple(r) for r in found.toLocalIterator()], args.csv)
        except Exception as error:
            print(str(error).splitlines()[0], file=sys.stderr)
            return 1
        return 0
    config = load(args.config)
    if args.command in ("extract", "run", "probe", "profile"):
        settings = json.loads(Path(args.session).read_text(encoding="utf-8"))
        log = calllog.CallLog(Path(args.store) / "logs" / "calls.jsonl")
        session = calllog.LoggedSession(open_session(spark, settings), log)
        profile = probe(session)
        if args.command == "probe":
            print(f"{profile.label}: {len(profile.columns)} catalog views, members by path: {profile.has_ifs_read}")
            return 0
        if args.command == "profile":
            found = profile_host(session, config)
            text = json.dumps(found, sort_keys=True, indent=1)
            Path(args.out).write_text(text, encoding="utf-8") if args.out else print(text)
            return 0
        say.phase("extract")
        store.reset("raw")
        store.write("host_profile", spark.createDataFrame(profile.rows(), LAYERS["raw"]["host_profile"]))
        extractor = Extractor(spark, session, config, store, profile)
        notes = extractor.targeted() if args.targeted else extractor.full()
        for table, n in sorted(notes.rows.items()):
            say.note(f"{table}: {n}")
        for text in notes.failed:
            say.note(f"failed: {text}")
    if args.command in ("parse", "run"):
        say.phase("parse")
        store.reset("parsed")
        for name, df in pipeline.parse(store.read("raw_source_members")).items():
            if name in LAYERS["parsed"]:
                store.write(name, df)
                say.note(f"{name}: {store.count(name)}")
    if args.command in ("build", "run"):
        say.phase("build")
        for name, df in pipeline.build(spark, store.tables("raw", "parsed"), config, getattr(args, "phase", 3)).items():
            store.write(name, df)
            say.note(f"{name}: {store.count(name)}")
    if args.command in ("analyze", "run"):
        say.phase("analyze")
        for name, df in pipeline.analyse(spark, store.tables("raw", "parsed", "graph"), config).items():
            store.write(name, df)
            say.note(f"{name}: {store.count(name)}")
    if args.command in ("report", "run"):
        say.phase("report")
        report.write_reports(spark, store.tables(*LAYERS), config, args.out, args.fmt)
    if args.command == "trace-columns":
        text = trace.trace_table(spark, store.tables("raw", "graph"), args.table, args.raw)
        Path(args.out).write_text(text, encoding="utf-8") if args.out else print(text, end="")
    if args.command == "diagnose":
        print("\n".join(trace.diagnose(spark, store.tables(*LAYERS), args.table, args.limit)))
    if args.command == "sql-errors":
        failed = store.read("parsed_sql_statements").where("parse_error IS NOT NULL").select(F.concat_ws("#", "program", "seq").alias("id"), F.col("parse_error").alias("message"))
        rows = [tuple(r) for r in calllog.signature_samples(failed, args.samples, args.limit).collect()]
        if args.out:
            Path(args.out).write_text("\n".join(json.dumps({"signature": s, "n": n, "samples": x}) for s, n, x in rows), encoding="utf-8")
        else:
            _show(["signature", "n", "samples"], rows, False)
    return 0


def profile_host(session, config) -> dict:
    """Read-only aggregates over the host, each timed; one that fails is a note and not the end."""
    import time

    libraries = ", ".join(f"'{x}'" for x in config.libraries)
    asked = {
        "objects": f"SELECT OBJATTRIBUTE, COUNT(*) AS N FROM TABLE(QSYS2.OBJECT_STATISTICS('*ALL', '*ALL')) WHERE OBJLIB IN ({libraries}) GROUP BY OBJATTRIBUTE",
        "columns": f"SELECT COUNT(*) AS N FROM QSYS2.SYSCOLUMNS WHERE TABLE_SCHEMA IN ({libraries})",
        "tables": f"SELECT COUNT(*) AS N FROM QSYS2.SYSTABLES WHERE TABLE_SCHEMA IN ({libraries})",
        "source": f"SELECT TABLE_NAME, COUNT(*) AS MEMBERS, SUM(NUMBER_ROWS) AS N_LINES, SUM(DATA_SIZE) AS SIZE FROM QSYS2.SYSPARTITIONSTAT WHERE TABLE_SCHEMA IN ({libraries}) AND SOURCE_TYPE IS NOT NULL GROUP BY TABLE_NAME",
        "largest": f"SELECT TABLE_NAME, TABLE_PARTITION, NUMBER_ROWS FROM QSYS2.SYSPARTITIONSTAT WHERE TABLE_SCHEMA IN ({libraries}) AND SOURCE_TYPE IS NOT NULL ORDER BY NUMBER_ROWS DESC, TABLE_PARTITION FETCH FIRST 10 ROWS ONLY",
    }
    out: dict = {"probe_seconds": {}, "errors": {}, "seed_classes": {}}
    results = {}
    for tag, sql in asked.items():
        began = time.perf_counter()
        try:
            results[tag] = session.query(sql, tag=f"profile.{tag}").dicts()
        except Exception as error:
            out["errors"][tag] = str(error).splitlines()[0]
        out["probe_seconds"][tag] = round(time.perf_counter() - began, 2)
    number = lambda rows, key: sum(int(r.get(key) or 0) for r in rows)
    out["objects"] = {str(r.get("objattribute") or "").strip(): int(r.get("n") or 0) for r in results.get("objects", [])}
    out["columns"], out["tables"] = number(results.get("columns", []), "n"), number(results.get("tables", []), "n")
    out["source_members"], out["source_lines"] = number(results.get("source", []), "members"), number(results.get("source", []), "n_lines")
    out["largest_members"] = results.get("largest", [])
    out["programs"] = sum(n for k, n in out["objects"].items() if k in ("CLP", "CLLE", "RPG", "RPGLE", "SQLRPG", "SQLRPGLE", "CBL", "CBLLE"))
    for seed in config.seeds:
        try:
            rows = session.query(f"SELECT OBJATTRIBUTE, SQL_OBJECT_TYPE FROM TABLE(QSYS2.OBJECT_STATISTICS('{seed.library}', 'FILE', '{seed.file}'))", tag=f"profile.seed.{seed.id}").dicts()
            attribute, kind = ((rows[0].get("objattribute") or "").strip(), (rows[0].get("sql_object_type") or "").strip()) if rows else (None, None)
            plain = "missing" if not rows else "ddl_table" if kind.upper() == "TABLE" else "view" if kind.upper() == "VIEW" else "dds_pf" if attribute.upper().startswith("PF") else "lf" if attribute.upper().startswith("LF") else "unknown"
        except Exception as error:
            out["errors"][f"seed.{seed.id}"] = str(error).splitlines()[0]
            continue
        out["seed_classes"][plain] = out["seed_classes"].get(plain, 0) + 1
    out["advice"] = profiler.recommend(out)
    return out


if __name__ == "__main__":
    sys.exit(main())

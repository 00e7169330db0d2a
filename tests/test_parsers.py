"""Parsers on literal text."""

import estate as e
import pytest
from pyspark.sql import functions as F

from headwater.parsers.control import parse_control
from headwater.parsers.dds import parse_dds
from headwater.parsers.rpg import parse_rpg
from headwater.parsers.sql import analyze, parse_sql, plain_text
from headwater.sources.members import assemble
from headwater.sources.store import LAYERS


def lines_of(spark, *members):
    rows = [("LIB", "SRC", name, kind, i, text) for name, kind, lines in members for i, text in enumerate(lines, 1)]
    return spark.createDataFrame(rows, LAYERS["raw"]["raw_source_members"])


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# --- SQL, without a session -----------------------------------------------------


def test_select_columns_and_aliases():
    a = analyze("SELECT o.ordno, c.name AS who, o.amt * 2 doubled, COUNT(*) FROM lib.orders o JOIN cust AS c ON o.cust = c.id WHERE c.region = 'N'")
    assert a.stmt_type == "SELECT" and a.tables_read == ["LIB/ORDERS", "CUST"]
    assert a.column_lineage == [("ORDNO", ["LIB/ORDERS.ORDNO"]), ("WHO", ["CUST.NAME"]), ("DOUBLED", ["LIB/ORDERS.AMT"]), ("COUNT(*)", [])]
    assert a.columns_used == ["CUST.ID", "CUST.NAME", "CUST.REGION", "LIB/ORDERS.AMT", "LIB/ORDERS.CUST", "LIB/ORDERS.ORDNO"]


@pytest.mark.parametrize(
    ("sql", "kind", "reads", "writes", "lineage"),
    [
        ("INSERT INTO A.T (X, Y) SELECT P, Q FROM S", "INSERT", ["S"], ["A/T"], [("A/T.X", ["S.P"]), ("A/T.Y", ["S.Q"])]),
        ("INSERT INTO T (X) SELECT P, Q FROM S", "INSERT", ["S"], ["T"], [("T.P", ["S.P"]), ("T.Q", ["S.Q"])]),
        ("INSERT INTO T (X, Y) VALUES(?, ?)", "INSERT", [], ["T"], [("T.X", []), ("T.Y", [])]),
        ("UPDATE T SET A = B + 1, C = (SELECT MAX(Z) FROM U) WHERE K = 1", "UPDATE", ["U"], ["T"], [("T.A", ["U.B"]), ("T.C", ["U.Z"])]),
        ("UPDATE T SET A = B", "UPDATE", [], ["T"], [("T.A", ["T.B"])]),
        ("DELETE FROM T WHERE K IN (SELECT K FROM U)", "DELETE", [], ["T"], []),
        ("MERGE INTO T USING (SELECT K, V FROM S) X ON T.K = X.K WHEN MATCHED THEN UPDATE SET T.V = S.V WHEN NOT MATCHED THEN INSERT (K) VALUES (X.K)", "MERGE", ["S"], ["T"], [("T.V", ["S.V"])]),
        ("CREATE VIEW V AS SELECT A, B C FROM S", "CREATE_VIEW", ["S"], ["V"], [("V.A", ["S.A"]), ("V.C", ["S.B"])]),
        ("CREATE TABLE T AS (SELECT A FROM S) WITH DATA", "CREATE_TABLE", ["S"], ["T"], [("T.A", ["S.A"])]),
        ("CREATE TABLE T (A CHAR(3) NOT NULL DEFAULT 'x')", "CREATE_TABLE", [], ["T"], []),
        ("WITH Q AS (SELECT A FROM S) SELECT A FROM Q", "SELECT", ["S"], [], [("A", ["S.A"])]),
        ("SELECT A FROM S UNION SELECT B FROM R", "UNION", ["S", "R"], [], []),
        ("SELECT * FROM S", "SELECT", ["S"], [], [("*", ["S.*"])]),
        ("SELECT TRIM(LEADING '0' FROM A) AS X FROM S FETCH FIRST 1 ROW ONLY", "SELECT", ["S"], [], [("X", ["S.A"])]),
        ("SELECT STRIP(A, TRAILING, ' ') X, STRIP(B) Y, TRIM(L '0' FROM C) Z, TRIM(LEADING) W FROM S", "SELECT", ["S"], [], [("X", ["S.A"]), ("Y", ["S.B"]), ("Z", ["S.C"]), ("W", ["S.LEADING"])]),
        ("SELECT CURRENT TIMESTAMP, A CONCAT B, DIGITS(A) CONCAT 'x' AS D, CURRENT DATE DT, EXTRACT(YEAR FROM E) F FROM S", "SELECT", ["S"], [], [("CURRENT TIMESTAMP", []), ("A CONCAT B", ["S.A", "S.B"]), ("D", ["S.A"]), ("DT", []), ("F", ["S.E"])]),
        ("UPDATE L / T SET A = CURRENT SERVER, B = USER WITH NC", "UPDATE", [], ["L/T"], [("L/T.A", []), ("L/T.B", [])]),
        ('SELECT "o"."Amt" FROM "Lib"/"Ord" AS "o" FOR READ ONLY OPTIMIZE FOR 10 ROWS', "SELECT", ["LIB/ORD"], [], [("AMT", ["LIB/ORD.AMT"])]),
        ("INSERT INTO LIB / T (X) SELECT A FROM LIB /S WITH UR SKIP LOCKED DATA", "INSERT", ["LIB/S"], ["LIB/T"], [("LIB/T.X", ["LIB/S.A"])]),
        ("CREATE VIEW V FOR COLUMN X AS SELECT A FROM S RCDFMT VR", "CREATE_VIEW", ["S"], ["V"], [("V.A", ["S.A"])]),
    ],
)
def test_statements(sql, kind, reads, writes, lineage):
    a = analyze(sql)
    assert (a.stmt_type, a.tables_read, a.tables_written, a.parse_error) == (kind, reads, writes, None)
    assert a.column_lineage == lineage


def test_dialect_goes_by_tokens():
    assert plain_text("select a from lib / t with ur") == "select a from lib.t"
    assert plain_text("CREATE TABLE L/T (A CHAR ( 3 ) CCSID 37 WITH DEFAULT 'x', B INT WITH DEFAULT, C INT WITH DEFAULT -1)") == "CREATE TABLE L.T ( A CHAR ( 3 ) DEFAULT 'x' , B INT , C INT DEFAULT - 1 )"
    assert plain_text("SELECT A/B, 'WITH UR' FROM T") == "SELECT A / B , 'WITH UR' FROM T"


def test_noise_dynamic_cursor_and_errors():
    assert analyze("  ").stmt_type == "EMPTY" and analyze("LABEL ON TABLE T IS 'x'").stmt_type == "NOISE" and analyze("DECLARE C1 CURSOR FOR S1").stmt_type in ("NOISE", "PARSE_ERROR", "CURSOR_SELECT")
    assert analyze("EXECUTE IMMEDIATE :S").stmt_type == "DYNAMIC"
    cursor = analyze("DECLARE C1 SCROLL CURSOR WITH HOLD FOR SELECT A FROM S")
    assert cursor.stmt_type == "CURSOR_SELECT" and cursor.tables_read == ["S"]
    failed = analyze("SELEC A FROM S")
    assert failed.stmt_type == "PARSE_ERROR" and failed.parse_error
    partial = analyze("CREATE TABLE L/T AS (SELECT A FROM S) IN !SPACE")
    assert partial.stmt_type == "CREATE_TABLE" and partial.tables_written == ["L/T"] and partial.tables_read == ["S"] and partial.parse_error
    assert analyze("SELECT A FROM (SELECT B FROM S").stmt_type == "PARSE_ERROR"


# --- definitions -------------------------------------------------------------------


def test_join_logical_file(spark):
    member = ["* note", e.a_spec("R", "JREC", "JFILE(PFA PFB)"), e.a_spec("J", "", "JOIN(1 2) JFLD(K K)"), e.a_spec("", "FA", "JREF(1)"), e.a_spec("", "FB", "RENAME(OLDB) JREF(PFB)"), e.a_spec("", "FC", "CONCAT(X"), e.at((5, "A"), (44, "Y)"))]
    found = parse_dds(lines_of(spark, ("JLF", "LF", member), ("NOTDDS", "PF", ["nothing here"])))
    assert rows(found["parsed_dds_files"], "file", "dds_type", "record_format", "based_on", "is_join") == [("JLF", "LF", "JREC", ["PFA", "PFB"], True)]
    assert rows(found["parsed_dds_fields"], "field_name", "renamed_from", "ref_field", "ref_file", "concat_fields") == [("FA", None, "FA", "1", []), ("FB", "OLDB", "OLDB", "PFB", []), ("FC", None, "FC", None, ["X", "Y"])]


# --- control programs -----------------------------------------------------------------


def test_control_statements(spark):
    member = [
        "TAG:  CALL PGM(&LIB/NOPE)   /* runtime */", "DCL VAR(&PGM) VALUE('RPT9')", "CALL &PGM PARM('A B' &X 3)", "CHGVAR VAR(&PGM) VALUE(&OTHER)", "CALL PGM(&PGM)", "SBMJOB CMD(CALL PGM(QGPL/NIGHT)) JOB(X)",
        "OVRDBF ORDERS TOFILE(*LIBL/HIST) MBR(M1) OVRSCOPE(*JOB)", "CPYF FROMFILE(A/B) TOFILE(&OUT) FMTOPT(*MAP *DROP)", "RUNSQLSTM SRCFILE(LIB/QSQL) -", "SRCMBR(MK)", "CRTDUPOBJ OBJ(A) FROMLIB(L) NEWOBJ(B)", "/* two", "lines */ ENDPGM",
    ]
    found = parse_control(lines_of(spark, ("DRV", "CLLE", member)))
    calls = rows(found["parsed_cl_calls"], "via", "called_lib", "called_pgm", "resolved", "expr")
    assert ("CALL", None, "RPT9", True, None) in calls and ("SBMJOB", "QGPL", "NIGHT", True, None) in calls and ("RUNSQLSTM", "LIB", "MK", True, None) in calls
    assert ("CALL", None, None, False, "&PGM") in calls and ("CPYF", None, None, False, "&OUT") in calls and any(c[0] == "CRTDUPOBJ" for c in calls)
    assert rows(found["parsed_cl_calls"].where("called_pgm = 'RPT9'"), "params") == [(["A B", "&X", "3"],)]
    assert rows(found["parsed_cl_overrides"], "file", "to_file", "to_library", "to_member", "scope", "resolved") == [("ORDERS", "HIST", None, "M1", "*JOB", True)]
    assert rows(found["parsed_cl_statements"].where("command = 'ENDPGM'"), "program") == [("LIB/DRV",)]


# --- programs ----------------------------------------------------------------------------


def test_third_generation_columns(spark):
    member = [
        e.f_spec("MASTER", "U"), e.at((5, "F"), (20, "KRENAMENEWREC")), e.f_spec("REPORT", "O", "F"), e.at((5, "I"), (6, "MASTER")), e.i_spec("", "CODE", "1", "3", "EXTCODE"), e.at((5, "C"), (6, "*comment")),
        e.c_spec("KEY", "CHAIN", "MASTER"), e.c_spec("A", "ADD", "B", "TOTAL"), e.c_spec("", "MOVE", "'X'", "FLAG"), e.c_spec("", "MOVE", "ARR,3", "ITEM"), e.c_spec("", "UPDAT", "MASTER"), e.at((5, " /COPY SRC,MBR")), e.o_spec("REPORT"), e.o_spec("", "TOTAL", "20"), e.o_spec("", "UDATE", "30"),
    ]
    found = parse_rpg(lines_of(spark, ("OLD", "RPG", member)))
    assert rows(found["parsed_rpg_files"], "file", "usage", "extname", "rename_rec", "program_described") == [("MASTER", "update", "MASTER", "NEWREC", False), ("REPORT", "output", None, None, True)]
    assert rows(found["parsed_rpg_io_ops"], "seq", "opcode", "file", "direction") == [(1, "CHAIN", "MASTER", "read"), (2, "UPDAT", "MASTER", "write")]
    assert rows(found["parsed_rpg_moves"], "opcode", "source_field", "result_field") == [("ADD", "A", "TOTAL"), ("ADD", "B", "TOTAL"), ("MOVE", "ARR", "ITEM"), ("MOVE", None, "FLAG")]
    assert rows(found["parsed_rpg_ispec_fields"], "file", "field_name", "ext_name", "from_pos", "to_pos") == [("MASTER", "CODE", "EXTCODE", 1, 3)]
    assert rows(found["parsed_rpg_ospec_fields"], "file", "field_name", "end_pos") == [("REPORT", "TOTAL", 20)]
    assert rows(found["parsed_rpg_copies"], "library", "srcfile", "member") == [(None, "SRC", "MBR")]
    assert {r[0] for r in rows(found["parsed_rpg_field_refs"], "field_name")} >= {"KEY", "A", "B", "TOTAL", "FLAG"}


def test_free_form_and_embedded_sql(spark):
    member = [
        "**FREE", "dcl-f ORDERS usage(*input:*update) extdesc('APPLIB/ORDX') rename(REC:R2);", "dcl-s total packed(7:2);", "chain key ORDERS;", "read ORDERS;", "total = amount + 'x''y' + *blank;", "// a note about SECRETS",
        "exec sql select max(amt) into :total", "  from app/orders where id = :ds.id;", "update ORDERS;",
    ]
    found = parse_rpg(lines_of(spark, ("NEW", "SQLRPGLE", [" " * 8 + x for x in member])))
    assert rows(found["parsed_rpg_files"], "file", "usage", "extname", "rename_rec", "declared_via") == [("ORDERS", "update", "APPLIB/ORDX", "REC", "dclf")]
    assert rows(found["parsed_rpg_io_ops"], "opcode", "file") == [("CHAIN", "ORDERS"), ("READ", "ORDERS"), ("UPDATE", "ORDERS")]
    assert rows(found["rpg_sql_blocks"], "seq", "raw_sql") == [(0, "select max(amt) into ? from app/orders where id = ?")]
    refs = {r[0] for r in rows(found["parsed_rpg_field_refs"], "field_name")}
    assert {"AMOUNT", "KEY"} <= refs and "SECRETS" not in refs and "ORDERS" not in refs
    assert rows(found["program_classification"], "program_class", "reasons") == [("ext_described_io", ["mixed_sql_and_record_io"])]


def test_move_heavy_programs_are_complex(spark):
    member = [e.f_spec("A", "I"), *[e.c_spec("", "MOVE", f"F{i}", f"G{i}") for i in range(8)], *[e.c_spec("", "EXSR", "S") for _ in range(4)]]
    assert rows(parse_rpg(lines_of(spark, ("MV", "RPG", member)))["program_classification"], "program_class", "reasons", "needs_review") == [("program_described_or_complex", ["move_heavy"], True)]


def test_sql_members_and_scripts(spark):
    lines = lines_of(spark, ("DRV", "CLP", ["RUNSQLSTM SRCFILE(LIB/SRC) SRCMBR(SCRIPT)"]), ("SCRIPT", "SQL", ["INSERT INTO T (A) SELECT B FROM S; -- note; more", "COMMIT; DELETE FROM T"]), ("ALONE", "SQLVIEW", ["CREATE VIEW V AS", "SELECT A FROM T WITH UR"]))
    control = parse_control(lines)
    blocks = parse_rpg(lines)["rpg_sql_blocks"]
    found = parse_sql(assemble(lines), blocks, control["parsed_cl_calls"])["parsed_sql_statements"]
    assert rows(found, "program", "seq", "stmt_type") == [("LIB/ALONE#SQLMBR:SRC", 0, "CREATE_VIEW"), ("LIB/DRV#RUNSQLSTM:SCRIPT", 1000, "INSERT"), ("LIB/DRV#RUNSQLSTM:SCRIPT", 1002, "DELETE")]


def test_no_lines_give_empty_tables(spark):
    empty = spark.createDataFrame([], LAYERS["raw"]["raw_source_members"])
    for found in (parse_dds(empty), parse_control(empty), parse_rpg(empty)):
        assert all(df.where(F.lit(True)).isEmpty() for df in found.values())

"""Control programs: overrides, calls and copies, with names folded where variables are constant.

A member's text loses its comments, its continued lines become statements, and each kind of statement is
a projection over them. A variable's value at a statement is its last assignment before that statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint
from .lines import joined, of_language

#: Balanced to three levels inside an operand; an operand that is never closed runs to the end.
INSIDE = r"((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*)"


def operand(keyword: str, statement: Column | None = None) -> Column:
    """The text in a keyword's parentheses, null where the keyword is absent."""
    text = statement if statement is not None else F.col("raw_text")
    pattern = rf"(?i)\b{keyword}\s*\({INSIDE}"
    return F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1)))


def first_positional(statement: Column) -> Column:
    word = F.get(F.split(F.trim(statement), r"\s+", 3), F.lit(1))
    return F.when(~word.contains("("), word)


def qualified(name: Column) -> tuple[Column, Column]:
    """(library, object) of a constant name; *LIBL and *CURLIB are no library."""
    bare = F.regexp_replace(F.trim(name), "^['\"]+|['\"]+$", "")
    lib = F.trim(F.substring_index(bare, "/", 1))
    lib = F.when(bare.contains("/") & ~F.upper(lib).isin("*LIBL", "*CURLIB", ""), F.upper(lib))
    return lib, F.when(bare.contains("/"), F.trim(F.regexp_replace(bare, "^[^/]*/", ""))).otherwise(bare)


def statements(lines: DataFrame) -> DataFrame:
    """(program, seq, command, raw_text): seq counts logical lines, blank ones too."""
    texts = of_language(lines, "cl").groupBy("program", "srcfile").agg(joined("seq", "line", "\n").alias("text"))
    bare = texts.select("program", "srcfile", F.posexplode(F.split(F.regexp_replace("text", r"(?s)/\*.*?\*/", " "), "\n")).alias("at", "piece"))
    order = W.partitionBy("program", "srcfile").orderBy("at")
    mark = F.regexp_extract(F.rtrim("piece"), r"([+-])$", 1)
    placed = bare.withColumn("mark", mark).withColumn("after", F.coalesce(F.lag("mark").over(order), F.lit("")))
    placed = placed.withColumn("seq", F.sum((F.col("after") == "").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    body = F.when(F.col("after") == "+", F.ltrim("piece")).otherwise(F.col("piece"))
    cutoff = F.regexp_replace(F.rtrim(body), r"[+-]$", "")
    placed = placed.withColumn("piece", F.when(F.col("mark") == "+", F.concat(F.rtrim(cutoff), F.lit(""))).when(F.col("mark") == "-", cutoff).otherwise(body))
    whole = placed.groupBy("program", "srcfile", "seq").agg(joined("at", "piece", "").alias("raw_text"))
    bare = F.trim(F.regexp_replace("raw_text", r"(?i)^\s*[A-Z#$@][A-Z0-9#$@_]*:\s*", ""))
    return whole.select("program", F.col("seq").cast("int").alias("seq"), F.upper(F.get(F.split(bare, r"\s+", 2), F.lit(0))).alias("command"), bare.alias("raw_text")).where("raw_text <> ''")


def assignments(stmts: DataFrame) -> DataFrame:
    """(program, seq, variable, value): value is null where it is known at run time only."""
    rows = stmts.where("command IN ('DCL', 'CHGVAR')").select("program", "seq", F.upper(F.get(F.split(operand("VAR"), r"\s+"), F.lit(0))).alias("variable"), operand("VALUE").alias("given"))
    given = F.col("given")
    literal = given.rlike("^'.*'$")
    plain = ~given.rlike(r"(?i)\*[TB]?CAT|&|\s")
    return rows.where("variable IS NOT NULL").select("program", "seq", "variable", F.when(literal | plain, F.regexp_replace(given, "^['\"]+|['\"]+$", "")).alias("value"))


def folded(stmts: DataFrame, values: DataFrame, **raw: Column) -> DataFrame:
    """The statements with a column for each operand: struct(value, resolved, expr)."""
    out = stmts
    for name, column in raw.items():
        token = F.nullif(F.trim(column), F.lit(""))
        variable = F.when(token.startswith("&"), F.upper(F.get(F.split(token, r"\s+"), F.lit(0))))
        asked = out.withColumn("_raw", token).withColumn("_var", variable)
        known = values.select(F.col("program").alias("_p"), F.col("seq").alias("_s"), F.col("variable").alias("_v"), F.col("value").alias("_value"))
        needs = asked.where("_var IS NOT NULL").select("program", "seq", "_var").distinct()
        last = needs.join(known, (F.col("program") == F.col("_p")) & (F.col("_var") == F.col("_v")) & (F.col("_s") < F.col("seq"))).groupBy("program", "seq", "_var").agg(F.max_by("_value", "_s").alias("_last"))
        joined_ = asked.join(last, ["program", "seq", "_var"], "left")
        is_var = F.col("_var").isNotNull()
        value = F.when(is_var, F.col("_last")).otherwise(F.regexp_replace("_raw", "^['\"]+|['\"]+$", ""))
        resolved = ~is_var | F.col("_last").isNotNull()
        out = joined_.withColumn(name, F.struct(value.alias("value"), resolved.alias("resolved"), F.when(~resolved, F.col("_raw")).alias("expr"), F.col("_raw").alias("raw"))).drop("_raw", "_var", "_last")
    return out


def parse_control(lines: DataFrame) -> dict[str, DataFrame]:
    stmts = checkpoint(statements(lines))  # read by every kind of statement below
    values = assignments(stmts)
    text = F.col("raw_text")

    ovr = folded(stmts.where("command = 'OVRDBF'"), values, f=F.coalesce(operand("FILE"), first_positional(text)), t=operand("TOFILE"), m=operand("MBR"))
    to_lib, to_file = qualified(F.col("t.value"))
    resolved = F.col("f.resolved") & (F.col("t.raw").isNull() | F.col("t.resolved"))
    overrides = ovr.select(
        "program", "seq", F.upper(F.coalesce("f.value", "f.raw", F.lit(""))).alias("file"), F.upper(to_file).alias("to_file"), to_lib.alias("to_library"), F.upper("m.value").alias("to_member"),
        F.nullif(F.upper(operand("OVRSCOPE")), F.lit("")).alias("scope"), resolved.alias("resolved"), F.when(~resolved, F.coalesce("t.expr", "t.raw")).alias("expr"),
    )

    inner = operand("CMD")
    call_text = F.when(F.col("command") == "SBMJOB", inner).otherwise(text)
    called = stmts.where("command IN ('CALL', 'CALLPRC', 'SBMJOB')").withColumn("call_text", call_text).where(r"call_text RLIKE '(?i)^\\s*CALL(PRC)?\\b'")
    called = folded(called, values, p=F.coalesce(operand("PGM", F.col("call_text")), first_positional(F.col("call_text"))))
    lib, pgm = qualified(F.col("p.value"))
    parms = F.transform(F.regexp_extract_all(operand("PARM", F.col("call_text")), F.lit(r"('[^']*'|\S+)"), F.lit(1)), lambda x: F.regexp_replace(x, "^'+|'+$", ""))
    no_names = F.array().cast("array<string>")
    nothing = F.create_map().cast("map<string,string>")
    calls = called.select(
        "program", "seq", lib.alias("called_lib"), F.upper(pgm).alias("called_pgm"), F.when(F.col("command") == "SBMJOB", "SBMJOB").otherwise("CALL").alias("via"),
        F.coalesce(parms, no_names).alias("params"), nothing.alias("operands"), F.col("p.resolved").alias("resolved"), F.when(~F.col("p.resolved"), F.coalesce("p.expr", "p.raw")).alias("expr"),
    )

    def operands(**named: Column) -> Column:
        return F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in named.items()]))

    null = F.lit(None).cast("string")
    copied = folded(stmts.where("command = 'CPYF'"), values, a=operand("FROMFILE"), b=operand("TOFILE"))
    from_lib, from_file = qualified(F.col("a.value"))
    to_lib, to_file = qualified(F.col("b.value"))
    both = F.col("a.resolved") & F.col("b.resolved")
    copies = copied.select("program", "seq", null.alias("called_lib"), null.alias("called_pgm"), F.lit("CPYF").alias("via"), no_names.alias("params"), operands(from_lib=from_lib, from_file=F.upper(from_file), to_lib=to_lib, to_file=F.upper(to_file), fmtopt=F.trim(operand("FMTOPT"))).alias("operands"), both.alias("resolved"), F.when(~both, F.coalesce("a.expr", "b.expr")).alias("expr"))

    scripts = folded(stmts.where("command = 'RUNSQLSTM'"), values, s=operand("SRCFILE"), m=operand("SRCMBR"))
    src_lib, src_file = qualified(F.col("s.value"))
    runs = scripts.select("program", "seq", src_lib.alias("called_lib"), F.upper(F.coalesce("m.value", src_file)).alias("called_pgm"), F.lit("RUNSQLSTM").alias("via"), no_names.alias("params"), operands(srclib=src_lib, srcfile=src_file, srcmbr=F.col("m.value")).alias("operands"), (F.col("s.resolved") & F.col("m.resolved")).alias("resolved"), null.alias("expr"))

    duplicated = folded(stmts.where("command = 'CRTDUPOBJ'"), values, o=operand("OBJ"), n=operand("NEWOBJ"), l=operand("FROMLIB"))
    duplicates = duplicated.select("program", "seq", null.alias("called_lib"), null.alias("called_pgm"), F.lit("CRTDUPOBJ").alias("via"), no_names.alias("params"), operands(obj=F.col("o.value"), newobj=F.col("n.value"), fromlib=F.col("l.value")).alias("operands"), (F.col("o.resolved") & F.col("n.resolved")).alias("resolved"), null.alias("expr"))
    return {"parsed_cl_statements": stmts, "parsed_cl_overrides": overrides, "parsed_cl_calls": calls.unionByName(copies).unionByName(runs).unionByName(duplicates)}

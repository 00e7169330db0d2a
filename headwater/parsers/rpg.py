"""Record-oriented programs: declared files, operations, moves, input and output fields, embedded SQL.

Every specification line is cut by its columns; which file an input or output line belongs to is the
last file named above it, a running value over the member's lines. The third generation's columns hold
for its member types, the fourth's for the others, which may also be free in form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import hostvars_to_markers
from ..session import checkpoint
from .lines import MEMBER, NAME, before, by_member, cell, char, cut, is_name, joined, of_language, so_far

#: Member types in the third generation's columns.
THIRD = ("RPG", "RPG38", "RPT", "SQLRPG", "")
#: Operations that read and that write.
READS = ("CHAIN", "READ", "READE", "READP", "READPE", "REDPE", "READC", "SETLL", "SETGT")
WRITES = ("WRITE", "UPDAT", "UPDATE", "DELET", "DELETE", "EXCPT", "EXCEPT", "EXFMT")
#: Operations that assign, by the factors that they assign from.
FROM_SECOND = ("MOVE", "MOVEL", "MOVEA", "Z-ADD", "Z-SUB", "SQRT", "XFOOT", "XLATE", "SUBST")
FROM_BOTH = ("ADD", "SUB", "MULT", "DIV", "CAT")
FROM_NONE = ("MVR", "TIME", "CLEAR")
#: Output words that are no fields.
OUTPUT_WORDS = ("PAGE", "PAGE1", "PAGE2", "PAGE3", "PAGE4", "PAGE5", "PAGE6", "PAGE7", "UDATE", "UDAY", "UMONTH", "UYEAR")


def _by_generation(third: tuple[int, int], fourth: tuple[int, int]) -> Column:
    return F.when(F.col("third"), cell(*third)).otherwise(cell(*fourth))


def _word(value: Column) -> Column:
    """The first word of a factor without an array index, where it is a name."""
    word = F.split_part(F.split_part(F.coalesce(value, F.lit("")), F.lit(" "), F.lit(1)), F.lit(","), F.lit(1))
    return F.when(is_name(word), word)


def _keyword(name: str, text: Column) -> Column:
    found = F.regexp_extract(text, rf"(?i)\b{name}\s*\(([^)]*)\)", 1)
    return F.nullif(F.upper(F.trim(F.regexp_replace(F.split_part(found, F.lit(":"), F.lit(1)), "['\"]", ""))), F.lit(""))


def _external(text: Column) -> Column:
    return F.coalesce(*[F.nullif(_keyword(k, text), F.lit("*EXTDESC")) for k in ("EXTFILE", "EXTDESC", "EXTNAME")])


def _marked(lines: DataFrame) -> DataFrame:
    """Lines with ``third`` and ``block``: the number of the SQL block that a line is in, or null."""
    rows = of_language(lines, "rpg").withColumn("third", F.col("kind").isin(*THIRD))
    starts = F.col("line").rlike(r"(?i)[/\s]EXEC\s+SQL\b")
    rows = rows.withColumn("opens", starts).withColumn("fixed", F.when(starts, F.col("line").rlike(r"^.{5}[A-Za-z ]?/") | F.upper("line").contains("/EXEC")))
    rows = rows.withColumn("block", F.last(F.when(F.col("opens"), F.col("seq")), ignorenulls=True).over(so_far())).withColumn("fixed", F.last("fixed", ignorenulls=True).over(so_far()))
    ends = F.col("line").rlike(r"(?i)\bEND-EXEC\b") | (~F.coalesce("fixed", F.lit(True)) & F.rtrim("line").rlike(r";$"))
    rows = rows.withColumn("ends", ends).withColumn("ended", F.last(F.when(ends, F.col("seq")), ignorenulls=True).over(before()))
    return rows.withColumn("block", F.when(F.col("block").isNotNull() & (F.col("ended").isNull() | (F.col("ended") < F.col("block"))), F.col("block")))


def sql_blocks(marked: DataFrame) -> DataFrame:
    """(program, seq, raw_sql): embedded statements in order, host variables as markers."""
    line = F.col("line")
    inside = marked.where("block IS NOT NULL").where(~line.rlike(r"(?i)\bEND-EXEC\b"))
    body = F.when(char(5).isin("C", " ") & char(6).isin("/", "+"), cut(7)).when(char(5) == "C", cut(6)).otherwise(line)
    blocks = inside.withColumn("part", F.trim(body)).groupBy("program", *MEMBER, "block").agg(joined("seq", "part", " ").alias("text"))
    text = F.regexp_replace("text", r"(?i)\bEXEC\s+SQL\b|\bEND-EXEC\b", " ")
    text = hostvars_to_markers(F.trim(F.regexp_replace(F.trim(text), r"[;\s]+$", "")))
    order = W.partitionBy(*MEMBER).orderBy("block")
    return blocks.select("program", (F.row_number().over(order) - 1).alias("seq"), text.alias("raw_sql")).where("raw_sql <> ''")


def parse_rpg(lines: DataFrame) -> dict[str, DataFrame]:
    marked = checkpoint(_marked(lines))  # read by every table below
    copy = r"(?i)^(?:.{5}\s?|\s*)/(?:COPY|INCLUDE)\s+(\S+)"
    code = marked.where("block IS NULL").where(~F.col("line").rlike(copy)).where((char(6) != "*") & (F.col("third") | ~F.ltrim("line").startswith("//")))
    code = code.withColumn("form", char(5))
    free = code.where(~F.col("third") & ~F.col("form").isin("F", "I", "O", "C")).withColumn("stmt", F.trim("line"))

    # files: fixed declarations with their continuations, and free ones
    declared = code.where("form = 'F'").withColumn("file", _by_generation((6, 14), (6, 16)))
    order = by_member()
    declared = declared.withColumn("group", F.sum(F.col("file").isNotNull().cast("int")).over(so_far(order)))
    renamed = F.nullif(F.upper(F.regexp_extract("line", r"(?i)\bKRENAME\s*([A-Z0-9#$@_]*)", 1)), F.lit(""))
    continued = declared.where("file IS NULL").withColumn("to", renamed).where("to IS NOT NULL").groupBy(*MEMBER, "group").agg(F.max_by("to", "seq").alias("to"))
    use = F.when(F.col("third"), char(14)).otherwise(char(16))
    words = F.when(F.col("third"), F.lit("")).otherwise(cut(43))
    external = F.when(F.col("third"), char(18) == "E").otherwise((char(21) == "E") | _external(words).isNotNull())
    usage = F.when(use == "O", "output").when(use == "U", "update").when(use == "C", "combined").otherwise("input")
    fixed = declared.where("file IS NOT NULL").join(continued, [*MEMBER, "group"], "left").select(
        "program", "seq", "file", usage.alias("usage"), F.when(external, F.coalesce(_external(words), F.col("file"))).alias("extname"), F.coalesce("to", _keyword("RENAME", words)).alias("rename_rec"), F.lit("fspec").alias("declared_via"), (~external).alias("program_described")
    )
    dcl = free.where(F.col("stmt").rlike(r"(?i)^DCL-F\s+[A-Z0-9#$@_]+"))
    rest = F.regexp_extract("stmt", r"(?i)^DCL-F\s+[A-Z0-9#$@_]+(.*)$", 1)
    ways = F.array_distinct(F.regexp_extract_all(F.upper(F.regexp_extract(rest, r"(?i)\bUSAGE\s*\(([^)]*)\)", 1)), F.lit(r"(\*INPUT|\*OUTPUT|\*UPDATE|\*DELETE)"), F.lit(1)))
    only = F.lower(F.ltrim(F.get(ways, F.lit(0)), F.lit("*")))
    way = F.when(F.size(ways) == 0, "input").when((F.size(ways) > 1) | (only == "update"), "update").otherwise(only)
    free_file = F.upper(F.regexp_extract("stmt", r"(?i)^DCL-F\s+([A-Z0-9#$@_]+)", 1))
    named = dcl.select("program", "seq", free_file.alias("file"), way.alias("usage"), F.coalesce(_external(rest), free_file).alias("extname"), _keyword("RENAME", rest).alias("rename_rec"), F.lit("dclf").alias("declared_via"), F.lit(False).alias("program_described"))
    files = checkpoint(fixed.unionByName(named))
    known = files.select("program", F.col("file").alias("_file")).distinct()
    sole = files.groupBy("program").agg(F.when(F.count_distinct("file") == 1, F.first("file")).alias("_sole"))

    # calculations
    calc = code.where("form = 'C'").select("program", *MEMBER, "seq", _by_generation((17, 27), (11, 25)).alias("f1"), F.split_part(F.split_part(F.coalesce(_by_generation((27, 32), (25, 35)), F.lit("")), F.lit(" "), F.lit(1)), F.lit("("), F.lit(1)).alias("opcode"), _by_generation((32, 42), (35, 49)).alias("f2"), _by_generation((42, 48), (49, 63)).alias("res"))
    free_op = free.where(~F.col("stmt").rlike(r"(?i)^DCL-")).select("program", *MEMBER, "seq", F.upper(F.regexp_extract("stmt", r"(?i)^([A-Z][A-Z0-9-]*)\b", 1)).alias("opcode"), "stmt")
    after = F.trim(F.regexp_replace("stmt", r"(?i)^[A-Z][A-Z0-9-]*(?:\([A-Z]*\))?", ""))
    free_io = free_op.select("program", *MEMBER, "seq", "opcode", F.upper(F.regexp_replace(F.split_part(F.rtrim(after, F.lit(";")), F.lit(" "), F.lit(1)), "[();]", "")).alias("target"))
    io = calc.select("program", *MEMBER, "seq", "opcode", F.split_part(F.coalesce("f2", F.lit("")), F.lit(" "), F.lit(1)).alias("target")).unionByName(free_io).where(F.col("opcode").isin(*READS, *WRITES))
    io = io.join(known.withColumn("target", F.col("_file")), ["program", "target"], "left").join(sole, "program", "left").withColumn("file", F.coalesce("_file", "_sole")).where("file IS NOT NULL")
    ops = io.select("program", F.row_number().over(W.partitionBy("program").orderBy("seq")).alias("seq"), "opcode", "file", F.when(F.col("opcode").isin(*READS), "read").otherwise("write").alias("direction"))

    f1, f2 = _word(F.col("f1")), _word(F.col("f2"))
    sources = F.when(F.col("opcode").isin(*FROM_SECOND), F.array_compact(F.array(f2))).when(F.col("opcode").isin(*FROM_BOTH), F.array_compact(F.array(f1, f2))).when(F.col("opcode").isin(*FROM_NONE), F.array().cast("array<string>"))
    assigned = calc.withColumn("sources", sources).withColumn("result_field", _word(F.col("res"))).where("sources IS NOT NULL AND result_field IS NOT NULL")
    assigned = assigned.withColumn("seq", F.row_number().over(W.partitionBy("program").orderBy("seq")))
    moves = assigned.select("program", "seq", "opcode", F.explode_outer("sources").alias("source_field"), "result_field")

    # input and output fields
    out_name = _by_generation((6, 14), (6, 16))
    out = code.where("form = 'O'").withColumn("name", out_name)
    out = out.withColumn("file", F.last("name", ignorenulls=True).over(so_far())).withColumn("field", _by_generation((31, 37), (29, 43)))
    end = F.when(F.col("third"), F.trim(cut(39, 43))).otherwise(F.trim(cut(46, 51)))
    ofields = out.where("name IS NULL AND file IS NOT NULL AND field IS NOT NULL").where(is_name(F.col("field")) & ~F.col("field").isin(*OUTPUT_WORDS)).select("program", "file", F.col("field").alias("field_name"), F.when(end.rlike(r"^\d+$"), end.cast("int")).alias("end_pos"))
    inp = code.where("form = 'I'").withColumn("name", F.when(is_name(cell(6, 14)), cell(6, 14)))
    inp = inp.withColumn("file", F.last("name", ignorenulls=True).over(so_far())).withColumn("field", _by_generation((52, 58), (48, 62)))
    place = lambda s, e: F.when(F.col("third") & F.trim(cut(s, e)).rlike(r"^\d+$"), F.trim(cut(s, e)).cast("int"))
    ext = F.when(is_name(cell(20, 30)), cell(20, 30))
    ifields = inp.where("name IS NULL AND file IS NOT NULL AND field IS NOT NULL").where(is_name(F.col("field"))).select("program", "file", F.col("field").alias("field_name"), ext.alias("ext_name"), place(43, 47).alias("from_pos"), place(47, 51).alias("to_pos"))

    # names that calculations and output lines mention
    areas = calc.select("program", F.explode(F.array_compact(F.array("f1", "f2", "res"))).alias("area")).unionByName(out.select("program", cell(31, 43).alias("area")).where("area IS NOT NULL"))
    fixed_words = areas.select("program", F.explode(F.split("area", r"\s+")).alias("word")).select("program", F.regexp_replace("word", r"^[()]+|[()]+$", "").alias("field_name")).where(is_name(F.col("field_name")))
    bare = F.regexp_replace(F.regexp_replace("stmt", r"'(?:[^']|'')*'", " "), r"\*[A-Za-z0-9]+", " ")
    free_words = free_op.where("opcode <> ''").select("program", "opcode", F.explode(F.regexp_extract_all(bare, F.lit(r"([A-Za-z#$@][A-Za-z0-9#$@_]*)"), F.lit(1))).alias("word")).select("program", "opcode", F.upper("word").alias("field_name")).where("field_name <> opcode").drop("opcode")
    named_words = fixed_words.unionByName(free_words.where(F.col("field_name").rlike(NAME))).distinct()
    refs = named_words.join(known.withColumnRenamed("_file", "field_name"), ["program", "field_name"], "left_anti")

    copies = marked.where("block IS NULL").where(F.col("line").rlike(copy)).select("program", F.upper(F.regexp_extract("line", copy, 1)).alias("arg"))
    where = F.when(F.col("arg").contains("/"), F.nullif(F.substring_index("arg", "/", 1), F.lit("")))
    tail = F.regexp_replace("arg", "^[^/]*/", "")
    copies = copies.select("program", where.alias("library"), F.when(tail.contains(","), F.nullif(F.substring_index(tail, ",", 1), F.lit(""))).alias("srcfile"), F.trim(F.regexp_replace(tail, "^[^,]*,", "")).alias("member"))

    blocks = sql_blocks(marked)
    return {
        "parsed_rpg_files": files.drop("seq"),
        "parsed_rpg_io_ops": ops,
        "parsed_rpg_ospec_fields": ofields,
        "parsed_rpg_ispec_fields": ifields,
        "parsed_rpg_moves": moves,
        "parsed_rpg_field_refs": refs,
        "parsed_rpg_copies": copies,
        "rpg_sql_blocks": blocks,
        "program_classification": classify(code, marked, files, ops, blocks),
    }


def classify(code: DataFrame, marked: DataFrame, files: DataFrame, ops: DataFrame, blocks: DataFrame) -> DataFrame:
    """(program, program_class, reasons, needs_review): how far a program's lineage can be read off its source."""
    is_calc = (char(5) == "C") & (char(6) != "*")
    lines = marked.groupBy("program").agg(
        F.max(F.col("line").rlike(r"(?i)^\s*//\s*(?:LOAD|RUN|FILE)\b")).alias("s36"),
        F.count_if(is_calc).alias("n_calc"),
        F.count_if(is_calc & F.col("line").rlike(r"(?i)^.{27}(?:MOVE[LA]?|MOVEA)\b")).alias("n_move"),
        F.max((char(5) == "O") & (char(6) != "*")).alias("outputs"),
    )
    f = files.groupBy("program").agg(F.max("program_described").alias("described"), F.lit(True).alias("has_files"))
    o = ops.select("program").distinct().withColumn("has_io", F.lit(True))
    s = blocks.groupBy("program").agg(F.max(F.col("raw_sql").rlike(r"(?i)^\s*(?:PREPARE|EXECUTE)\b")).alias("dynamic"), F.lit(True).alias("has_sql"))
    flags = lines.join(f, "program", "left").join(o, "program", "left").join(s, "program", "left").na.fill(False)
    c = F.col
    heavy = (c("n_calc") >= 10) & (c("n_move") > 0.4 * c("n_calc"))
    is_complex = c("described") | c("s36") | heavy
    io = c("has_files") | c("has_io")
    kind = F.when(is_complex, "program_described_or_complex").when(c("has_sql") & ~io, "sql_pure").when(c("has_sql") | c("has_files"), "ext_described_io").otherwise("program_described_or_complex")
    why = F.when(is_complex, F.lit(None)).when(c("has_sql") & ~io, "all_access_via_sql").when(c("has_sql"), "mixed_sql_and_record_io").when(c("has_files"), "externally_described_record_io").otherwise("no_recognizable_io")
    reasons = F.array_compact(F.array(F.when(c("described"), "program_described_fspec"), F.when(c("s36"), "s36_markers"), F.when(heavy, "move_heavy"), F.when(c("dynamic"), "dynamic_sql"), F.when(c("outputs") & c("described"), "ospecs_on_program_described"), why))
    return flags.select("program", kind.alias("program_class"), reasons.alias("reasons"), ((kind == "program_described_or_complex") | c("dynamic")).alias("needs_review"))

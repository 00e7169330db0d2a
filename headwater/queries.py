"""Query catalogue: every operator over relations projected from the test tables, with its SQL.

Each query builds the operator's input relations from a table directory and applies the operator; the
SQL beside it computes the same from the same tables. Operators never know where a relation came from.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import confidence as conf
from .functions import ids, text
from .operators import analysis, closure, edges, resolve
from .parsers import sql
from .session import ship, table
from .sources import catalog, members, profiler
from .sources import calllog as logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return run

    return register


# --- Names and scope ---------------------------------------------------------


def _objects(spark, d) -> DataFrame:
    """Parts as catalog objects: the brand's first digit is the library, the type the name."""
    return table(spark, d, "part").select(F.concat(F.lit("LIB"), F.substring("p_brand", 7, 1)).alias("lib"), F.upper("p_type").alias("name"), F.upper("p_name").alias("alias"))


OBJECTS = "(SELECT DISTINCT 'LIB' || substr(p_brand, 7, 1) AS lib, upper(trim(x)) AS name FROM (SELECT p_brand, unnest([p_type, p_name]) AS x FROM part))"
LIBLIST = "(VALUES ('LIB3', 0), ('LIB1', 1), ('LIB5', 2)) l(lib, place)"


def _library_list(spark) -> DataFrame:
    return spark.createDataFrame([("LIB3", 0), ("LIB1", 1), ("LIB5", 2)], "lib string, place int")


@query(f"SELECT DISTINCT lib, name FROM {OBJECTS}")
def catalog_object_set(spark, d):
    return resolve.catalog_objects(_objects(spark, d))


@query(f"""
SELECT n.name, h.lib AS found_lib, coalesce(h.n > 1, false) AS ambiguous
FROM (SELECT DISTINCT upper(p_type) AS name FROM part UNION SELECT upper(c_name) FROM customer) n
LEFT JOIN (SELECT o.name, arg_min(o.lib, l.place) AS lib, count(DISTINCT o.lib) AS n FROM {OBJECTS} o JOIN {LIBLIST} ON o.lib = l.lib GROUP BY o.name) h USING (name)""")
def liblist_first_match(spark, d):
    names = _objects(spark, d).select("name").union(table(spark, d, "customer").select(F.upper("c_name").alias("name"))).distinct()
    return resolve.first_in_library_list(names, resolve.catalog_objects(_objects(spark, d)), _library_list(spark))


@query(f"""
SELECT o.name, count(DISTINCT o.lib) AS n_libs, string_agg(DISTINCT o.lib, ',' ORDER BY o.lib) AS libs
FROM {OBJECTS} o JOIN {LIBLIST} ON o.lib = l.lib GROUP BY o.name HAVING count(DISTINCT o.lib) > 1""")
def liblist_ambiguous(spark, d):
    objects = resolve.catalog_objects(_objects(spark, d))
    many = resolve.first_in_library_list(objects.select("name").distinct(), objects, _library_list(spark)).where("ambiguous").select("name")
    return objects.join(many, "name").join(_library_list(spark), "lib").groupBy("name").agg(F.count_distinct("lib").alias("n_libs"), F.array_join(F.array_sort(F.collect_set("lib")), ",").alias("libs"))


@query("""
WITH labels AS (
  SELECT 'LIB' || substr(p_brand, 7, 1) AS lib, unnest(list_distinct([p_type, p_brand])) AS label, p_brand AS canon, p_partkey AS ord FROM part),
best AS (SELECT lib, label, arg_max(canon, ord) AS canon FROM labels GROUP BY lib, label)
SELECT p_partkey, coalesce(b.canon, p.p_type) AS canon
FROM part p LEFT JOIN best b ON b.lib = CASE WHEN p_size % 2 = 0 THEN 'LIB1' ELSE 'LIB2' END AND b.label = p.p_type""")
def canonical_names(spark, d):
    part = table(spark, d, "part")
    labels = resolve.canonical_labels(part.select(F.concat(F.lit("LIB"), F.substring("p_brand", 7, 1)).alias("lib"), F.col("p_type").alias("name"), F.col("p_brand").alias("system_name"), F.col("p_partkey").alias("ord")))
    names = part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, "LIB1").otherwise("LIB2").alias("lib"), F.col("p_type").alias("name"))
    return resolve.canonical(names, labels).select("p_partkey", "canon")


@query("SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING' AND c_nationkey < 10)")
def scoped_pull_pairs(spark, d):
    pairs = table(spark, d, "customer").where("c_mktsegment = 'BUILDING' AND c_nationkey < 10").select(F.lit("O").alias("lib"), F.col("c_custkey").cast("string").alias("name"))
    rows = table(spark, d, "orders").withColumn("_schema", F.lit("o")).withColumn("_key", F.col("o_custkey").cast("string"))
    return resolve.in_scope(rows, pairs, "_schema", "_key").drop("_schema", "_key")


@query("""
SELECT p_partkey FROM part WHERE EXISTS (
  SELECT 1 FROM (SELECT DISTINCT upper(p_type) AS name FROM part WHERE p_size = 7 UNION SELECT DISTINCT upper(p_name) FROM part WHERE p_size = 9) q
  WHERE q.name IN (upper(part.p_type), upper(part.p_name)))""")
def scoped_pull_either_name(spark, d):
    part = table(spark, d, "part")
    pairs = part.where("p_size = 7").select(F.lit("L").alias("lib"), F.col("p_type").alias("name")).union(part.where("p_size = 9").select(F.lit("L"), "p_name"))
    rows = part.select("p_partkey", "p_type", "p_name", F.lit("l").alias("_schema"))
    return resolve.in_scope(rows, pairs, "_schema", "p_type", "p_name").select("p_partkey")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem h WHERE h.l_returnflag = 'R' AND h.l_partkey = l.l_partkey AND h.l_suppkey = l.l_suppkey)")
def resume_skip_harvested(spark, d):
    lines = table(spark, d, "lineitem")
    return resolve.not_harvested(lines.select("l_partkey", "l_suppkey").distinct(), lines.where("l_returnflag = 'R'"), "l_partkey", "l_suppkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def missing_source(spark, d):
    programs = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("pgm"), "c_custkey").alias("program"))
    sources = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit(" PGM"), "o_custkey").alias("member"))
    return resolve.without_source(programs, sources).select("c_custkey")


@query("SELECT s_suppkey AS id, s_name AS title, CAST(NULL AS VARCHAR) AS comment, CAST(s_nationkey AS INTEGER) AS nation FROM supplier")
def adaptive_projection(spark, d):
    spec = [("id", ("supplier_id", "S_SUPPKEY"), "long", True), ("title", ("s_title", "s_name"), "string", True), ("comment", ("s_comment",), "string", False), ("nation", ("s_nationkey",), "int", False)]
    return resolve.adaptive_projection(table(spark, d, "supplier"), spec)


@query("SELECT event_id, TRY_CAST(trim(substr(props, 1, (event_id % 5)::INT)) AS INTEGER)::VARCHAR AS a, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN ' ' || user_id || ' ' ELSE event_type END AS INTEGER)::VARCHAR AS b, trim('  ' || event_type || ' ') AS t FROM events")
def map_coercion(spark, d):
    e = table(spark, d, "events")
    number = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), "user_id", F.lit(" "))).otherwise(F.col("event_type"))
    return e.select("event_id", resolve.whole_number(F.expr("substr(props, 1, CAST(event_id % 5 AS INT))")).cast("string").alias("a"), resolve.whole_number(number).cast("string").alias("b"), resolve.trimmed(F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("t"))


@query("""
SELECT p_partkey, CASE WHEN p_size = 1 THEN 'missing' WHEN p_size % 4 = 0 THEN 'ddl_table' WHEN p_size % 4 = 1 THEN 'view' WHEN p_size % 8 = 2 THEN 'dds_pf' WHEN p_size % 8 = 6 THEN 'lf' ELSE 'unknown' END AS seed_class FROM part""")
def seed_classification(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size")
    attr = F.when(size % 8 == 2, "PF").when(size % 8 == 6, "LF").otherwise("SRC")
    kind = F.when(size == 1, None).when(size % 4 == 0, "TABLE").when(size % 4 == 1, "VIEW")
    return p.select("p_partkey", profiler.seed_class(F.when(size != 1, attr), kind).alias("seed_class"))


# --- Edges -------------------------------------------------------------------


def _references(spark, d) -> DataFrame:
    """Orders as programs that use parts; the line number is the usage flag."""
    return table(spark, d, "lineitem").select(
        F.lit("app").alias("program_lib"), F.col("l_orderkey").cast("string").alias("program_name"), F.lit("dat").alias("object_lib"), F.col("l_partkey").cast("string").alias("object_name"),
        F.when(F.col("l_linenumber") == 7, "*PGM").when(F.col("l_linenumber") == 6, "*DTAARA").otherwise("*FILE").alias("object_type"), F.col("l_linenumber").cast("string").alias("usage_flag"),
    )


@query("""
SELECT DISTINCT 'program:APP/' || l_orderkey AS src,
       CASE WHEN l_linenumber = 7 THEN 'program:DAT/' ELSE 'file:DAT/' END || l_partkey AS dst,
       CASE WHEN l_linenumber = 7 THEN 'calls' ELSE unnest(CASE WHEN l_linenumber = 2 THEN ['writes'] WHEN l_linenumber IN (3, 4) THEN ['reads', 'writes'] ELSE ['reads'] END) END AS kind,
       'xref' AS provenance, 'confirmed' AS confidence
FROM lineitem WHERE l_linenumber <> 6""")
def usage_direction_edges(spark, d):
    return edges.reference_edges(_references(spark, d)).select("src", "dst", "kind", "provenance", "confidence").distinct()


@query("""
SELECT 'N' || s_nationkey AS src, 'P' || (l_partkey % 50) AS dst, 'reads' AS kind, 'xref' AS provenance, 'parsed' AS confidence, arg_min(l_orderkey || '/' || l_linenumber, l_orderkey * 10 + l_linenumber) AS ctx
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def edge_dedup_first_context(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    made = edges.make_edges(rows, F.concat(F.lit("N"), "s_nationkey"), F.concat(F.lit("P"), F.col("l_partkey") % 50), "reads", "xref", "parsed", 1, F.col("l_orderkey") * 10 + F.col("l_linenumber"), at=F.concat("l_orderkey", F.lit("/"), "l_linenumber"))
    return edges.first_context(made).select(*edges.KEY, F.col("context")["at"].alias("ctx"))


@query("""
SELECT DISTINCT 'file:S/' || s_suppkey AS src, 'file:N/' || s_nationkey AS dst FROM supplier
UNION SELECT DISTINCT 'file:C/' || c_custkey, 'file:N/' || c_nationkey FROM customer WHERE c_acctbal > 0""")
def dependency_edges(spark, d):
    made = table(spark, d, "supplier").select(F.lit("s").alias("dep_lib"), F.col("s_suppkey").cast("string").alias("dep_file"), F.lit("n").alias("based_lib"), F.col("s_nationkey").cast("string").alias("based_file"))
    views = table(spark, d, "customer").where("c_acctbal > 0").select(F.lit("c").alias("view_schema"), F.col("c_custkey").cast("string").alias("view_name"), F.lit("n").alias("object_schema"), F.col("c_nationkey").cast("string").alias("object_name"))
    return edges.dependency_edges(made).unionByName(edges.view_edges(views)).select("src", "dst").distinct()


@query("""
WITH f AS (SELECT DISTINCT 'N' || s_nationkey AS file, p_brand AS field FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
r AS (SELECT 'N' || a.n_nationkey AS dep, 'N' || b.n_nationkey AS base FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey > b.n_nationkey),
k AS (SELECT DISTINCT 'N' || s_nationkey AS file, p_brand AS field FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE p_size < 2)
SELECT r.dep AS dep_file, r.base AS based_file, x.field FROM r JOIN f x ON x.file = r.dep JOIN f y ON y.file = r.base AND x.field = y.field
WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.file = r.dep AND k.field = x.field)""")
def lf_passthrough(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    fields = lines.select(F.lit("L").alias("lib"), F.concat(F.lit("N"), "s_nationkey").alias("file"), F.col("p_brand").alias("field"), "p_size")
    nation = table(spark, d, "nation")
    b = nation.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("b"))
    relations = nation.join(b, (F.col("n_regionkey") == F.col("r")) & (F.col("n_nationkey") > F.col("b"))).select(F.lit("L").alias("dep_lib"), F.concat(F.lit("N"), "n_nationkey").alias("dep_file"), F.lit("L").alias("based_lib"), F.concat(F.lit("N"), "b").alias("based_file"))
    found = edges.same_name_columns(relations, fields.select("lib", "file", "field").distinct(), fields.where("p_size < 2"))
    return found.select("dep_file", "based_file", "field")


def _sites(spark, d) -> tuple[DataFrame, DataFrame]:
    """Suppliers as programs, order lines as call sites and parts' brands as files; a returned line overrides."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    base = lines.select(F.concat(F.lit("S"), "l_suppkey").alias("program"), F.col("p_brand").alias("file"), F.concat("l_suppkey", F.lit("."), F.col("l_orderkey") % 3).alias("site"), "l_returnflag")
    sites = base.select("program", "site", F.when(F.col("l_returnflag") == "R", F.col("file")).alias("file"), F.when(F.col("l_returnflag") == "R", F.concat("file", F.lit("X"))).alias("to_file")).distinct()
    return base.select("program", "file", F.lit("reads").alias("kind")).distinct(), sites


SITES = """
base AS (SELECT 'S' || l_suppkey AS program, p_brand AS file, l_suppkey || '.' || (l_orderkey % 3) AS site, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey),
total AS (SELECT program, count(DISTINCT site) AS n FROM base GROUP BY program),
over AS (SELECT program, file, count(DISTINCT site) AS n FROM base WHERE l_returnflag = 'R' GROUP BY program, file),
gone AS (SELECT o.program, o.file FROM over o JOIN total t ON o.program = t.program AND o.n = t.n)"""


@query(f"WITH {SITES} SELECT program, file FROM gone")
def override_all_sites(spark, d):
    return edges.superseded(*_sites(spark, d))


@query(f"""WITH {SITES}
SELECT DISTINCT program, file, 'reads' AS kind, 'default' AS via FROM base b WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.program = b.program AND g.file = b.file)
UNION SELECT DISTINCT program, file || 'X', 'reads', 'override' FROM over""")
def override_partial(spark, d):
    return edges.overridden(*_sites(spark, d))


@query("""
WITH f AS (SELECT DISTINCT p_brand AS file, p_type AS field FROM part), r AS (SELECT DISTINCT 'P' || (p_partkey % 5) AS program, p_type AS field FROM part WHERE p_size < 3),
p AS (SELECT DISTINCT 'P' || (p_partkey % 5) AS program, p_brand AS file FROM part)
SELECT p.program, p.file, f.field, CASE WHEN r.field IS NULL THEN 'inferred' ELSE 'parsed' END AS confidence, CASE WHEN r.field IS NULL THEN 'record_io_all_fields' ELSE 'field_reference' END AS mechanism
FROM p JOIN f USING (file) LEFT JOIN r ON r.program = p.program AND r.field = f.field""")
def field_usage_confidence(spark, d):
    part = table(spark, d, "part").withColumn("program", F.concat(F.lit("P"), F.col("p_partkey") % 5))
    reads = part.select("program", F.col("p_brand").alias("file"))
    fields = part.select(F.col("p_brand").alias("file"), F.col("p_type").alias("field"))
    return edges.field_usage(reads, fields, part.where("p_size < 3").select("program", F.col("p_type").alias("field")))


@query("""
WITH f AS (SELECT DISTINCT p_brand AS file, p_type AS field FROM part),
c AS (SELECT DISTINCT 'C' || p_size AS program, a.p_brand AS from_file, 'Brand#' || (1 + a.p_size % 5) || (1 + a.p_partkey % 5) AS to_file, CASE WHEN p_size % 2 = 0 THEN '*map *drop' END AS fmtopt FROM part a)
SELECT DISTINCT c.program, c.from_file, c.to_file, x.field, CASE WHEN fmtopt IS NULL THEN 'inferred' ELSE 'parsed' END AS confidence, CASE WHEN fmtopt IS NULL THEN 'cpyf_layout' ELSE 'cpyf_map' END AS mechanism
FROM c JOIN f x ON x.file = c.from_file JOIN f y ON y.file = c.to_file AND x.field = y.field""")
def cpyf_column_usage(spark, d):
    part = table(spark, d, "part")
    copies = part.select(F.concat(F.lit("C"), "p_size").alias("program"), F.col("p_brand").alias("from_file"), F.concat(F.lit("Brand#"), 1 + F.col("p_size") % 5, 1 + F.col("p_partkey") % 5).alias("to_file"), F.when(F.col("p_size") % 2 == 0, "*map *drop").alias("fmtopt")).distinct()
    return edges.copied_fields(copies, part.select(F.col("p_brand").alias("file"), F.col("p_type").alias("field")))


PARALLEL = "SELECT 'S' || l_suppkey AS src, 'N' || (l_partkey % 40) AS dst, CASE l_returnflag WHEN 'A' THEN 'reads' ELSE 'writes' END AS kind, CASE WHEN l_linenumber % 3 = 0 THEN 'xref' WHEN l_linenumber % 3 = 1 THEN 'dds' ELSE 'catalog' END AS provenance, CASE WHEN l_quantity > 40 THEN 'confirmed' WHEN l_quantity > 20 THEN 'parsed' ELSE 'inferred' END AS confidence FROM lineitem"


def _parallel(spark, d) -> DataFrame:
    n, q = F.col("l_linenumber") % 3, F.col("l_quantity")
    return table(spark, d, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("N"), F.col("l_partkey") % 40).alias("dst"), F.when(F.col("l_returnflag") == "A", "reads").otherwise("writes").alias("kind"), F.when(n == 0, "xref").when(n == 1, "dds").otherwise("catalog").alias("provenance"), F.when(q > 40, "confirmed").when(q > 20, "parsed").otherwise("inferred").alias("confidence"))


@query(f"""
SELECT src, dst, kind, count(*) AS n, arg_max(provenance, r) AS provenance, arg_max(confidence, r) AS confidence
FROM (SELECT *, CASE confidence WHEN 'confirmed' THEN '3' WHEN 'parsed' THEN '2' ELSE '1' END || provenance AS r FROM ({PARALLEL})) GROUP BY src, dst, kind""")
def parallel_edge_merge(spark, d):
    return edges.merge_parallel(_parallel(spark, d))


@query(f"SELECT dst AS node, sum(CASE WHEN kind = 'writes' THEN 1 ELSE 0 END)::BIGINT AS n_writers, sum(CASE WHEN kind = 'reads' THEN 1 ELSE 0 END)::BIGINT AS n_readers FROM ({PARALLEL}) GROUP BY dst")
def node_degree(spark, d):
    return edges.degrees(_parallel(spark, d))


@query("SELECT 'N' || s_nationkey AS up, p_brand AS down, count(*) AS n FROM (SELECT DISTINCT s_nationkey, p_brand, p_type FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey) GROUP BY ALL")
def column_evidence_counts(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return edges.evidence_counts(lines.select(F.concat(F.lit("N"), "s_nationkey").alias("up"), F.col("p_brand").alias("down"), "p_type").distinct())


@query(f"WITH e AS (SELECT DISTINCT src, dst, kind FROM ({PARALLEL})), s AS (SELECT 'S' || s_suppkey AS node FROM supplier WHERE s_nationkey < 5 UNION ALL SELECT 'N' || n_nationkey FROM nation WHERE n_regionkey = 1) SELECT src, dst, kind FROM e WHERE src IN (SELECT node FROM s) AND dst IN (SELECT node FROM s)")
def edges_within_cone(spark, d):
    nodes = table(spark, d, "supplier").where("s_nationkey < 5").select(F.concat(F.lit("S"), "s_suppkey").alias("node")).union(table(spark, d, "nation").where("n_regionkey = 1").select(F.concat(F.lit("N"), "n_nationkey")))
    return edges.within(_parallel(spark, d).select("src", "dst", "kind").distinct(), nodes)


# --- Closure -----------------------------------------------------------------

#: Regions derive from nations, nations from suppliers, suppliers from parts, parts from brands.
GRAPH = """
flow AS (
  SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst, 3 AS rank FROM nation
  UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, CASE WHEN s_acctbal < 2000 THEN 1 ELSE 2 END FROM supplier
  UNION ALL SELECT 'S' || l_suppkey, 'P' || l_partkey, max(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 3 ELSE 2 END) FROM lineitem GROUP BY ALL
  UNION ALL SELECT 'P' || p_partkey, p_brand, CASE WHEN p_size > 25 THEN 2 ELSE 1 END FROM part)"""
REACH = """
walk AS (
  SELECT 'R' || r_regionkey AS seed, 'R' || r_regionkey AS node, 0 AS depth, 9 AS rank FROM region
  UNION SELECT w.seed, f.dst, w.depth + 1, least(w.rank, f.rank) FROM walk w JOIN flow f ON f.src = w.node WHERE w.depth < 64)"""


def _graph(spark, d) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 3).otherwise(2)
    made = [
        table(spark, d, "nation").select(F.concat(F.lit("R"), "n_regionkey").alias("src"), F.concat(F.lit("N"), "n_nationkey").alias("dst"), F.lit(3).alias("rank")),
        table(spark, d, "supplier").select(F.concat(F.lit("N"), "s_nationkey"), F.concat(F.lit("S"), "s_suppkey"), F.when(F.col("s_acctbal") < 2000, 1).otherwise(2)),
        table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max(flag).alias("rank")).select(F.concat(F.lit("S"), "l_suppkey"), F.concat(F.lit("P"), "l_partkey"), "rank"),
        table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey"), "p_brand", F.when(F.col("p_size") > 25, 2).otherwise(1)),
    ]
    out = made[0]
    for m in made[1:]:
        out = out.union(m)
    return out


def _regions(spark, d) -> DataFrame:
    return table(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("seed"), F.concat(F.lit("R"), "r_regionkey").alias("node"))


@query(f"WITH RECURSIVE {GRAPH}, {REACH} SELECT seed, node, min(depth) AS depth, max(rank)::BIGINT AS rank FROM walk WHERE node <> seed GROUP BY seed, node")
def backward_closure(spark, d):
    return closure.closure(_regions(spark, d), _graph(spark, d)).select("seed", "node", "depth", "rank")


TRADE = """
trade AS (SELECT 'N' || c_nationkey AS src, 'N' || s_nationkey AS dst, 1 + (count(*) % 3) AS rank
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def _trade(spark, d) -> DataFrame:
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    n = joined.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    return n.select(F.concat(F.lit("N"), "c_nationkey").alias("src"), F.concat(F.lit("N"), "s_nationkey").alias("dst"), (1 + F.col("n") % 3).alias("rank"))


@query(f"""WITH RECURSIVE {TRADE}, walk AS (
  SELECT 'N' || n_nationkey AS seed, 'N' || n_nationkey AS node, 0 AS depth, 9::BIGINT AS rank FROM nation
  UNION SELECT w.seed, t.dst, w.depth + 1, least(w.rank, t.rank) FROM walk w JOIN trade t ON t.src = w.node WHERE w.depth < 64)
SELECT seed, node, min(depth) AS depth, max(rank) AS rank FROM walk WHERE node <> seed GROUP BY seed, node""")
def closure_cyclic(spark, d):
    seeds = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("seed"), F.concat(F.lit("N"), "n_nationkey").alias("node"))
    return closure.closure(seeds, _trade(spark, d)).select("seed", "node", "depth", "rank")


@query("""
WITH e AS (SELECT 'program:S/' || l_suppkey AS src, 'file:P/' || l_partkey AS dst, CASE WHEN l_returnflag = 'R' THEN 'writes' ELSE 'reads' END AS kind FROM lineitem
  UNION ALL SELECT 'file:P/' || p_partkey, 'file:B/' || upper(p_brand), 'derives_from' FROM part WHERE p_size < 10)
SELECT DISTINCT dst AS node FROM e WHERE dst LIKE 'file:%' AND dst NOT IN (SELECT src FROM e WHERE kind = 'derives_from') AND dst NOT IN (SELECT dst FROM e WHERE kind = 'writes')""")
def base_files(spark, d):
    lines = table(spark, d, "lineitem").select(ids.program_id(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), ids.file_id(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.when(F.col("l_returnflag") == "R", "writes").otherwise("reads").alias("kind"))
    parts = table(spark, d, "part").where("p_size < 10").select(ids.file_id(F.lit("p"), F.col("p_partkey").cast("string")), ids.file_id(F.lit("b"), F.col("p_brand")), F.lit("derives_from"))
    made = lines.union(parts)
    return closure.base_nodes(made.where("dst LIKE 'file:%'").select(F.col("dst").alias("node")).distinct(), made)


CHAIN = "SELECT 'P' || p_partkey AS src, p_brand AS dst FROM part WHERE p_size < 40 UNION SELECT DISTINCT p_brand, p_type FROM part WHERE p_size % 10 = 3"


@query(f"""WITH RECURSIVE e AS ({CHAIN}), walk AS (SELECT 'P' || p_partkey AS seed, 'P' || p_partkey AS node FROM part UNION SELECT w.seed, e.dst FROM walk w JOIN e ON e.src = w.node)
SELECT seed, node FROM walk WHERE node NOT IN (SELECT src FROM e)""")
def flatten_logical(spark, d):
    part = table(spark, d, "part")
    flow = part.where("p_size < 40").select(F.concat(F.lit("P"), "p_partkey").alias("src"), F.col("p_brand").alias("dst")).union(part.where("p_size % 10 = 3").select("p_brand", "p_type")).distinct().withColumn("rank", F.lit(1))
    return closure.sinks(part.select(F.concat(F.lit("P"), "p_partkey").alias("seed"), F.concat(F.lit("P"), "p_partkey").alias("node")), flow)


@query("""WITH RECURSIVE calls AS (SELECT c_custkey AS src, 1 + c_custkey // 3 AS dst FROM customer),
walk AS (SELECT c_custkey AS seed, c_custkey AS node, 0 AS depth FROM customer UNION SELECT w.seed, c.src, w.depth + 1 FROM walk w JOIN calls c ON c.dst = w.node WHERE w.depth < 64)
SELECT seed, node, min(depth) AS depth FROM walk WHERE node <> seed GROUP BY seed, node""")
def transitive_callers(spark, d):
    c = table(spark, d, "customer")
    return closure.transitive_callers(c.select(F.col("c_custkey").alias("seed"), F.col("c_custkey").alias("node")), c.select(F.col("c_custkey").alias("src"), F.expr("1 + c_custkey div 3").alias("dst")))


@query(f"""WITH RECURSIVE {GRAPH}, kept AS (SELECT 'R' || r_regionkey AS node FROM region UNION ALL SELECT 'S' || s_suppkey FROM supplier UNION ALL SELECT DISTINCT p_brand FROM part),
walk AS (SELECT node AS seed, node, 9 AS rank, true AS go FROM kept UNION SELECT w.seed, f.dst, least(w.rank, f.rank), f.dst NOT IN (SELECT node FROM kept) FROM walk w JOIN flow f ON f.src = w.node WHERE w.go)
SELECT seed AS src, node AS dst, max(rank)::BIGINT AS rank FROM walk WHERE node IN (SELECT node FROM kept) AND node <> seed GROUP BY seed, node""")
def physical_contraction(spark, d):
    kept = table(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("node")).union(table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey"))).union(table(spark, d, "part").select("p_brand").distinct())
    return closure.contract(_graph(spark, d), kept).select("src", "dst", "rank")


@query(f"""WITH RECURSIVE counts AS (SELECT 'N' || c_nationkey AS src, 'N' || s_nationkey AS dst, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey < s_nationkey AND c_nationkey + 5 > s_nationkey GROUP BY ALL),
walk AS (SELECT 'N' || n_nationkey AS seed, 'N' || n_nationkey AS node, 1099511627776::BIGINT AS n FROM nation UNION SELECT w.seed, c.dst, least(w.n, c.n) FROM walk w JOIN counts c ON c.src = w.node)
SELECT seed, node, max(n) AS bottleneck FROM walk WHERE node <> seed GROUP BY seed, node""")
def evidence_bottleneck(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = joined.where("c_nationkey < s_nationkey AND c_nationkey + 5 > s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("rank"))
    flow = counts.select(F.concat(F.lit("N"), "c_nationkey").alias("src"), F.concat(F.lit("N"), "s_nationkey").alias("dst"), "rank")
    seeds = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("seed"), F.concat(F.lit("N"), "n_nationkey").alias("node"))
    return closure.closure(seeds, flow).select("seed", "node", F.col("rank").alias("bottleneck"))


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS src, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey // 2 ELSE o_orderkey - 4 END AS dst FROM orders WHERE o_orderkey > 8),
walk AS (SELECT o_orderkey AS seed, o_orderkey AS node, 0 AS depth FROM orders UNION SELECT w.seed, e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.node WHERE w.depth < 8)
SELECT seed, node, min(depth) AS depth FROM walk WHERE node <> seed GROUP BY seed, node""")
def move_chain(spark, d):
    o = table(spark, d, "orders")
    flow = o.where("o_orderkey > 8").select(F.col("o_orderkey").alias("src"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey div 2 ELSE o_orderkey - 4 END").alias("dst"), F.lit(1).alias("rank"))
    seeds = o.select(F.col("o_orderkey").alias("seed"), F.col("o_orderkey").alias("node"))
    return closure.closure(seeds, flow, max_depth=8).select("seed", "node", "depth")


@query("""WITH p AS (SELECT 'C' || c_nationkey AS src, arg_max('C' || (c_custkey % 25), c_custkey) AS dst FROM customer GROUP BY 1)
SELECT 'C' || n_nationkey AS node, coalesce(d.dst, c.dst, b.dst, a.dst, 'C' || n_nationkey) AS base FROM nation LEFT JOIN p a ON a.src = 'C' || n_nationkey LEFT JOIN p b ON b.src = a.dst LEFT JOIN p c ON c.src = b.dst LEFT JOIN p d ON d.src = c.dst""")
def ultimate_base(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_nationkey").alias("src"), F.concat(F.lit("C"), F.col("c_custkey") % 25).alias("dst"), F.col("c_custkey").alias("ord"))
    return closure.follow_last(c, table(spark, d, "nation").select(F.concat(F.lit("C"), "n_nationkey").alias("node")))


# --- Analyses ----------------------------------------------------------------

LINEAGE = """
lineage AS (SELECT 'N' || s_nationkey AS output_id, 'file:P/' || replace(upper(p_brand), '#', '') AS source_file, CASE WHEN p_size % 2 = 0 THEN p_type END AS source_column,
  CASE WHEN p_size = 3 THEN 'inferred' WHEN p_size % 3 = 0 THEN 'parsed' ELSE 'confirmed' END AS min_confidence, CASE WHEN p_size % 4 = 0 THEN 'used' ELSE 'derives' END AS relation
  FROM (SELECT DISTINCT s_nationkey, p_brand, p_type, p_size FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey))"""
MATRIX = f"{LINEAGE}, matrix AS (SELECT output_id, source_file AS source_id FROM lineage UNION SELECT output_id, 'column:' || substr(source_file, 6) || '.' || source_column FROM lineage WHERE relation = 'used' AND source_column IS NOT NULL)"


def _lineage(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    size = F.col("p_size")
    return lines.select("s_nationkey", "p_brand", "p_type", "p_size").distinct().select(
        F.concat(F.lit("N"), "s_nationkey").alias("output_id"), ids.file_id(F.lit("p"), F.replace("p_brand", F.lit("#"))).alias("source_file"), F.when(size % 2 == 0, F.col("p_type")).alias("source_column"),
        F.when(size == 3, "inferred").when(size % 3 == 0, "parsed").otherwise("confirmed").alias("min_confidence"), F.when(size % 4 == 0, "used").otherwise("derives").alias("relation"),
    )


@query(f"WITH {MATRIX} SELECT output_id, source_id, true AS present FROM matrix")
def commonality_matrix(spark, d):
    return analysis.commonality_matrix(_lineage(spark, d))


@query(f"WITH {MATRIX} SELECT source_id, count(DISTINCT output_id) AS fanout, string_agg(DISTINCT output_id, ',' ORDER BY output_id) AS outputs FROM matrix GROUP BY source_id")
def fanout(spark, d):
    return analysis.fan_out(analysis.commonality_matrix(_lineage(spark, d)))


@query(f"WITH {MATRIX}, m AS (SELECT 'R' || n_regionkey AS cluster, 'N' || n_nationkey AS output_id FROM nation) SELECT cluster, source_id FROM matrix JOIN m USING (output_id) GROUP BY cluster, source_id HAVING count(DISTINCT output_id) = 5")
def shared_sources(spark, d):
    clusters = table(spark, d, "nation").select(F.concat(F.lit("R"), "n_regionkey").alias("cluster"), F.concat(F.lit("N"), "n_nationkey").alias("output_id"))
    return analysis.shared_by_all(analysis.commonality_matrix(_lineage(spark, d)), clusters)


@query(f"""WITH {MATRIX}, n AS (SELECT output_id, count(*) AS n FROM matrix GROUP BY output_id)
SELECT x.output_id AS a, y.output_id AS b, round(count(*) / (any_value(p.n) + any_value(q.n) - count(*))::DOUBLE, 6) AS jaccard
FROM matrix x JOIN matrix y ON x.source_id = y.source_id AND x.output_id < y.output_id JOIN n p ON p.output_id = x.output_id JOIN n q ON q.output_id = y.output_id GROUP BY 1, 2""")
def jaccard_pairs(spark, d):
    return analysis.jaccard_pairs(analysis.commonality_matrix(_lineage(spark, d)))


@query(f"WITH {MATRIX} SELECT source_id, count(DISTINCT output_id) AS n_outputs FROM matrix GROUP BY source_id ORDER BY 2 DESC, 1 LIMIT 20")
def top_shared_sources(spark, d):
    return analysis.top_shared(analysis.commonality_matrix(_lineage(spark, d)))


STATUS = """status AS (SELECT o.output_id, CASE WHEN count(l.output_id) = 0 THEN 'unresolved' WHEN bool_or(l.min_confidence = 'inferred' OR l.source_file IN (SELECT 'file:P/BRAND1' || p_size FROM part WHERE p_size < 3)) THEN 'partial' ELSE 'resolved' END AS status
  FROM (SELECT 'N' || s_suppkey AS output_id FROM supplier) o LEFT JOIN lineage l USING (output_id) GROUP BY o.output_id)"""


def _status(spark, d) -> DataFrame:
    outputs = table(spark, d, "supplier").select(F.concat(F.lit("N"), "s_suppkey").alias("output_id"))
    gaps = table(spark, d, "part").where("p_size < 3").select(F.concat(F.lit("file:P/BRAND1"), "p_size").alias("object_id"))
    return analysis.coverage_status(outputs, _lineage(spark, d), gaps)


@query(f"WITH {LINEAGE}, {STATUS} SELECT * FROM status")
def coverage_status(spark, d):
    return _status(spark, d)


@query(f"WITH {LINEAGE}, {STATUS} SELECT count(*) AS n_outputs, count_if(status = 'resolved')::BIGINT AS n_resolved, count_if(status = 'partial')::BIGINT AS n_partial, count_if(status = 'unresolved')::BIGINT AS n_unresolved, round(100.0 * count_if(status = 'resolved') / count(*), 1)::DOUBLE AS resolved_pct FROM status")
def coverage_summary(spark, d):
    return analysis.coverage_summary(_status(spark, d))


@query("""
SELECT p_partkey, CASE WHEN p_size % 7 = 0 OR p_size % 4 > 1 THEN 'full_reengineering' WHEN p_size % 4 = 1 OR p_size % 5 > 0 OR p_size % 6 > 3 THEN 'moderate' ELSE 'replicate_as_view' END AS bucket,
       CASE WHEN p_size % 3 < p_partkey % 4 THEN ['unresolved', 'inferred', 'parsed'][1 + p_size % 3] ELSE ['unresolved', 'inferred', 'parsed', 'confirmed'][1 + p_partkey % 4] END AS weaker FROM part""")
def complexity_buckets(spark, d):
    size = F.col("p_size")
    bucket = conf.effort_bucket(size % 6, size % 4, size % 5, (size % 7 == 0).cast("int"))
    return table(spark, d, "part").select("p_partkey", bucket.alias("bucket"), conf.weaker(conf.name_of(size % 3), conf.name_of(F.col("p_partkey") % 4)).alias("weaker"))


GRAPH_EDGES = """
edges AS (
  SELECT DISTINCT 'program:P/S' || l_suppkey AS src, 'file:F/R' || n_regionkey AS dst, 'writes' AS kind, 3 AS rank FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT DISTINCT 'program:P/S' || l_suppkey, 'file:F/B' || right(p_brand, 2), 'reads', 2 FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION SELECT DISTINCT 'program:P/S' || l_suppkey, 'column:F/B' || right(p_brand, 2) || '.C' || (p_size % 4), 'reads', CASE WHEN l_linenumber = 1 THEN 2 ELSE 1 END FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION SELECT DISTINCT 'file:F/B' || right(p_brand, 2), 'file:F/T' || (p_size % 3), 'derives_from', 3 FROM part WHERE right(p_brand, 1) = '1'
  UNION SELECT DISTINCT 'column:F/R' || n_regionkey || '.C0', 'column:F/B' || right(p_brand, 2) || '.C1', 'derives_from', 2 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE p_size = n_regionkey),
flow AS (SELECT dst AS src, src AS dst, rank FROM edges WHERE kind = 'writes' UNION SELECT src, dst, rank FROM edges WHERE kind = 'derives_from' OR (kind = 'reads' AND src LIKE 'program:%'))"""


def _lineage_graph(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    place = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    placed = lines.join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    program, brand = F.concat(F.lit("program:P/S"), "l_suppkey"), F.concat(F.lit("F/B"), F.right(F.col("p_brand"), F.lit(2)))
    some = lines
    made = [
        placed.select(program.alias("src"), F.concat(F.lit("file:F/R"), "n_regionkey").alias("dst"), F.lit("writes").alias("kind"), F.lit("confirmed").alias("confidence")),
        some.select(program, F.concat(F.lit("file:"), brand), F.lit("reads"), F.lit("parsed")),
        some.select(program, F.concat(F.lit("column:"), brand, F.lit(".C"), F.col("p_size") % 4), F.lit("reads"), F.when(F.col("l_linenumber") == 1, "parsed").otherwise("inferred")),
        table(spark, d, "part").where("right(p_brand, 1) = '1'").select(F.concat(F.lit("file:"), brand), F.concat(F.lit("file:F/T"), F.col("p_size") % 3), F.lit("derives_from"), F.lit("confirmed")),
        placed.where("p_size = n_regionkey").select(F.concat(F.lit("column:F/R"), "n_regionkey", F.lit(".C0")), F.concat(F.lit("column:"), brand, F.lit(".C1")), F.lit("derives_from"), F.lit("parsed")),
    ]
    out = made[0]
    for m in made[1:]:
        out = out.union(m)
    return out.distinct()


@query(f"""WITH RECURSIVE {GRAPH_EDGES},
walk AS (SELECT 'R' || r_regionkey AS output_id, 'file:F/R' || r_regionkey AS node, 0 AS depth, 3 AS rank FROM region UNION SELECT w.output_id, f.dst, w.depth + 1, least(w.rank, f.rank) FROM walk w JOIN flow f ON f.src = w.node WHERE w.depth < 12),
cone AS (SELECT output_id, node, min(depth) AS depth, max(rank) AS rank FROM walk WHERE depth > 0 GROUP BY ALL),
base AS (SELECT DISTINCT node FROM cone WHERE node LIKE 'file:%' AND node NOT IN (SELECT src FROM edges WHERE kind = 'derives_from') AND node NOT IN (SELECT dst FROM edges WHERE kind = 'writes')),
cwalk AS (SELECT 'R' || r_regionkey AS output_id, 'column:F/R' || r_regionkey || '.C0' AS node, 0 AS depth, 3 AS rank FROM region UNION SELECT w.output_id, f.dst, w.depth + 1, least(w.rank, f.rank) FROM cwalk w JOIN flow f ON f.src = w.node WHERE w.depth < 12),
cols AS (SELECT output_id, node, min(depth) AS depth, max(rank) AS rank, 'derives' AS relation FROM cwalk WHERE depth > 0 AND node LIKE 'column:%' GROUP BY output_id, node
  UNION ALL SELECT c.output_id, e.dst, c.depth + 1, least(c.rank, e.rank), 'used' FROM cone c JOIN edges e ON e.src = c.node AND e.kind = 'reads' AND e.dst LIKE 'column:%' WHERE c.node LIKE 'program:%'),
best AS (SELECT output_id, 'file:' || regexp_replace(substr(node, 8), '\\.[^.]*$', '') AS source_file, split_part(node, '.', 2) AS source_column, relation, arg_min({{'d': depth, 'r': rank}}, depth * 10 - rank) AS b FROM cols GROUP BY output_id, node, relation)
SELECT output_id, node AS source_file, NULL AS source_column, depth AS path_len, ['unresolved', 'inferred', 'parsed', 'confirmed'][rank + 1] AS min_confidence, 'derives' AS relation FROM cone JOIN base USING (node)
UNION ALL SELECT output_id, source_file, source_column, b.d, ['unresolved', 'inferred', 'parsed', 'confirmed'][b.r + 1], relation FROM best WHERE source_file IN (SELECT node FROM base)""")
def output_lineage_rows(spark, d):
    region = table(spark, d, "region")
    seeds = region.select(F.concat(F.lit("R"), "r_regionkey").alias("output_id"), F.concat(F.lit("file:F/R"), "r_regionkey").alias("node"))
    columns = region.select(F.concat(F.lit("R"), "r_regionkey").alias("output_id"), F.concat(F.lit("column:F/R"), "r_regionkey", F.lit(".C0")).alias("node"))
    return analysis.output_lineage(seeds, columns, _lineage_graph(spark, d))


@query("""
SELECT 'N' || s_nationkey AS program, p_brand AS field, count(DISTINCT p_partkey) AS n_files, count(DISTINCT p_size) AS n_bases, CASE WHEN count(DISTINCT p_size) > 1 THEN 'inferred' ELSE 'parsed' END AS confidence
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def same_base_vs_ambiguous(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    bases = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file"), F.col("p_size").cast("string").alias("base"))
    return analysis.same_base(lines.select(F.concat(F.lit("N"), "s_nationkey").alias("program"), F.col("p_brand").alias("field"), F.col("p_partkey").cast("string").alias("file")).distinct(), bases)


# --- Sources, logs and text ---------------------------------------------------


@query("SELECT doc_id, string_agg(line, '|' ORDER BY line_no) AS body, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) GROUP BY doc_id")
def member_assembly(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line_text"))
    lines = docs.select(F.lit("L").alias("library"), F.lit("S").alias("srcfile"), F.col("doc_id").cast("string").alias("member"), F.lit("CLP").alias("member_type"), "seq", "line_text")
    found = members.assemble(lines)
    return found.select(F.col("member").cast("long").alias("doc_id"), F.array_join("lines", "|").alias("body"), F.size("lines").cast("long").alias("n_lines"))


@query("SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS total_size, sum(doc_id % 7)::BIGINT AS total_rows FROM documents GROUP BY source, lang")
def profile_volumes(spark, d):
    return profiler.volumes(table(spark, d, "documents").withColumn("r", F.col("doc_id") % 7), "source", "lang", size="n_chars", rows="r")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def largest_members(spark, d):
    return profiler.largest(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


def _log(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_type").alias("tag"), F.col("value").alias("ms"), (F.col("user_id") % 9 > 0).alias("ok"), F.concat(F.lit("q"), "event_id").alias("text"), F.when(F.col("user_id") % 9 == 0, F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("[CPF"), F.lpad(F.col("user_id") % 3, 4, "0"), F.lit("] object "), "event_id", F.lit(" not found"))).otherwise(F.concat(F.lit("line "), "event_id", F.lit(" of "), "user_id"))).alias("error"))


@query("SELECT event_type AS tag, count(*) AS n, round(sum(value), 1) AS total_ms, round(avg(value), 2) AS mean_ms, count_if(user_id % 9 = 0)::BIGINT AS n_failed FROM events GROUP BY event_type")
def hostcall_bottlenecks(spark, d):
    return logs.bottlenecks(_log(spark, d))


@query("SELECT event_type AS tag, value AS ms, 'q' || event_id AS text FROM events ORDER BY value DESC, ts, 'q' || event_id LIMIT 5")
def slowest_calls(spark, d):
    return logs.slowest(_log(spark, d)).select("tag", "ms", "text")


@query("""SELECT signature, count(*) AS n FROM (
  SELECT CASE WHEN event_id % 4 = 0 THEN 'CPF' || lpad((user_id % 3)::VARCHAR, 4, '0') ELSE substr(regexp_replace('line ' || event_id || ' of ' || user_id, '\\d+', 'N', 'g'), 1, 80) END AS signature FROM events WHERE user_id % 9 = 0) GROUP BY signature""")
def error_signatures(spark, d):
    return logs.error_counts(_log(spark, d))


@query(r"""WITH k AS (SELECT item_id AS id, substr(regexp_replace(regexp_replace('Line ' || item_id || ', Col: ' || length(text) || ': bad token ''' || CASE WHEN item_id % 3 = 0 THEN text ELSE 'x' || (item_id % 4) END || '''', 'Line \d+, Col: \d+', '_', 'g'), '''[^'']{40,}''', '''…''', 'g'), 1, 160) AS signature FROM benchmark)
SELECT signature, count(*) AS n, array_to_string(list(id ORDER BY id)[1:3], ',') AS samples FROM k GROUP BY signature""")
def sql_error_signatures(spark, d):
    b = table(spark, d, "benchmark")
    message = F.concat(F.lit("Line "), "item_id", F.lit(", Col: "), F.length("text"), F.lit(": bad token '"), F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("x"), F.col("item_id") % 4)), F.lit("'"))
    return logs.signature_samples(b.select(F.col("item_id").alias("id"), message.alias("message")))


SCRIPT = "'SELECT ' || p_partkey || ' FROM LIB/' || replace(p_brand, '#', '') || ' WITH UR; -- note; kept out' || chr(10) || 'INSERT INTO LIB/T VALUES(''a;b--c'', :HV' || p_size || '.X);  ; UPDATE T SET C = 1'"


def _script() -> F.Column:
    return F.concat(F.lit("SELECT "), "p_partkey", F.lit(" FROM LIB/"), F.replace("p_brand", F.lit("#")), F.lit(" WITH UR; -- note; kept out\nINSERT INTO LIB/T VALUES('a;b--c', :HV"), "p_size", F.lit(".X);  ; UPDATE T SET C = 1"))


@query("""SELECT p_partkey, unnest([0, 1, 2]) AS seq, unnest(['SELECT ' || p_partkey || ' FROM LIB/' || replace(p_brand, '#', '') || ' WITH UR', 'INSERT INTO LIB/T VALUES(''a;b--c'', :HV' || p_size || '.X)', 'UPDATE T SET C = 1']) AS stmt FROM part""")
def split_script(spark, d):
    return table(spark, d, "part").select("p_partkey", F.posexplode(text.split_statements(_script())).alias("seq", "stmt"))


@query(f"SELECT p_partkey, regexp_replace({SCRIPT}, ':[A-Za-z_][A-Za-z0-9_.]*', '?', 'g') AS stmt FROM part")
def hostvar_normalize(spark, d):
    return table(spark, d, "part").select("p_partkey", text.hostvars_to_markers(_script()).alias("stmt"))


@query("""SELECT p_partkey, unnest([0, 1, 2]) AS seq, unnest([
  'SELECT A , ' || p_partkey || ' FROM LIB.' || upper(replace(p_brand, '#', '')) || ' JOIN Q.T' || p_size || ' ON A / B = ''WITH UR''',
  'CREATE TABLE LIB.N' || p_size || ' ( A CHAR ( 3 ) DEFAULT ''x'' , B INT , C INT DEFAULT - ' || p_size || ' )',
  'DELETE FROM T WHERE A = : HV' || p_size || '.X']) AS stmt FROM part""")
def strip_dialect(spark, d):
    size, brand = F.col("p_size"), F.replace("p_brand", F.lit("#"))
    first = [F.lit("select a, "), "p_partkey", F.lit(" from lib / "), brand, F.lit(" join q/t"), size, F.lit(" on a/b = 'WITH UR' skip locked data for read only optimize for "), size, F.lit(" rows with "), F.element_at(F.array(*map(F.lit, ("ur", "cs", "rs", "rr", "nc"))), 1 + size % 5)]
    second = [F.lit("create table lib/n"), size, F.lit(" (a char(3) ccsid "), size, F.lit(" with default 'x', b for column bb int with default, c int with default -"), size, F.lit(") rcdfmt r"), size]
    third = [F.lit("delete from t where a = :hv"), size, F.lit(".x with nc -- note")]
    parts = table(spark, d, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # a table of one row group is read by one task
    made = parts.select("p_partkey", F.posexplode(F.array(F.concat(*first), F.concat(*second), F.concat(*third))).alias("seq", "sql"))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch["sql"].to_pylist()
            shown = {t: upper_but_strings(sql.plain_text(t)) for t in set(given)}
            yield batch.set_column(2, "stmt", pa.array([shown[t] for t in given], pa.string()))

    return made.mapInArrow(plain, "p_partkey long, seq int, stmt string")


def upper_but_strings(text: str) -> str:
    return "".join(p if k % 2 else p.upper() for k, p in enumerate(re.split("('[^']*')", text)))


@query("""SELECT o_orderkey, CASE WHEN s >= 3600 THEN format('{}:{:02d}:{:02d}', s // 3600, (s // 60) % 60, s % 60) ELSE format('{:02d}:{:02d}', (s // 60) % 60, s % 60) END AS shown FROM (SELECT o_orderkey, floor(o_totalprice / 20)::BIGINT AS s FROM orders)""")
def duration_text(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.duration(F.col("o_totalprice") / 20).alias("shown"))


@query("SELECT p_partkey, 'column:' || upper(substr(p_brand, 1, 5)) || '/P' || p_partkey || '.C' || p_size AS id, upper(substr(p_brand, 1, 5)) || '/P' || p_partkey AS spec, 'file:' || upper(substr(p_brand, 1, 5)) || '/P' || p_partkey AS file, 'C' || p_size AS col, 'P' || p_partkey AS short, upper(substr(p_brand, 1, 5)) AS lib FROM part")
def node_identity(spark, d):
    p = table(spark, d, "part").select("p_partkey", ids.column_id(F.substring("p_brand", 1, 5), F.concat(F.lit("p"), "p_partkey"), F.concat(F.lit("c"), "p_size")).alias("id"))
    node = F.col("id")
    return p.select("p_partkey", "id", ids.spec_of(node).alias("spec"), ids.file_of_column(node).alias("file"), ids.column_name(node).alias("col"), ids.short_name(node).alias("short"), ids.library_of(node).alias("lib"))


@query("""SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS shown FROM pages""")
def markup_escape(spark, d):
    return table(spark, d, "pages").select("page_id", text.markup_escape(F.col("html")).alias("shown"))

"""The store's lookups, joins and write path over the driver's tables, seen as a store's tables by VIEWS; whole tables, with DuckDB SQL.

The SQL of VIEWS reads alike in both engines, so query and oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import condition, kconfig_default, kconfig_type, snippet
from ..operators import backward, catalog, exports, graph, lookups, pointsto, relations, resolve, store, taint

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    "projects": "SELECT CAST(r_regionkey AS BIGINT) AS project_id, r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN '[\"/src/' || r_name || '\",\"/lib\"]' ELSE '/src/' || r_name END AS root_paths, 'never' AS last_indexed FROM region",
    "files": "SELECT s_suppkey AS file_id, CAST(s_nationkey % 5 AS BIGINT) AS project_id, 'src/n' || s_nationkey || '/' || s_name || '.c' AS path, 'h' || s_suppkey AS file_hash FROM supplier",
    "symbols": "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS file_id, 'u' || p_partkey % 700 AS usr, p_name AS name, p_brand || '::' || p_name || p_partkey AS qualified_name, CASE p_type WHEN 'SMALL' THEN 'FUNCTION' WHEN 'MEDIUM' THEN 'METHOD' WHEN 'ECONOMY' THEN 'CLASS' ELSE 'STRUCT' END AS kind, p_partkey % 90 AS line FROM part",
    "calls": "SELECT l_orderkey * 10 + l_linenumber AS call_id, l_partkey AS caller_id, CASE WHEN l_returnflag <> 'A' THEN l_suppkey END AS callee_id, 'f' || l_suppkey AS callee_name, l_suppkey % 60 AS file_id, l_linenumber AS line FROM lineitem",
    "raw_calls": "SELECT l_orderkey * 10 + l_linenumber AS call_id, l_suppkey % 60 AS file_id, 'u' || l_partkey % 900 AS caller_usr, 'u' || l_suppkey * 9 AS callee_usr FROM lineitem",
    "includes": "SELECT o_custkey % 100 AS file_id, 'inc' || o_orderkey % 150 AS included, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 100 END AS target_id, o_orderstatus = 'P' AS is_system FROM orders",
    "bases": "SELECT o_custkey AS derived_id, o_orderkey % 3000 AS base_id, 'B' || o_orderkey % 3000 AS base_name, o_orderpriority AS access FROM orders",
    "sources": "SELECT event_id AS source_id, user_id AS file_id, event_id % 2500 AS symbol_id, event_id % 30 AS pattern_id, event_type AS config_key, event_id % 97 AS line FROM events",
    "usages": "SELECT event_id AS usage_id, user_id AS file_id, event_id % 3100 AS symbol_id, event_type AS config_key, event_id % 89 AS line, CASE event_id % 3 WHEN 0 THEN 'CONDITION' WHEN 1 THEN 'RETURN' ELSE 'OTHER' END AS kind FROM events WHERE event_id % 4 < 3",
    "patterns": "SELECT CAST(n_nationkey AS BIGINT) AS pattern_id, n_name AS name, n_regionkey AS kind, n_nationkey % 3 > 0 AS is_active FROM nation",
    "paths": "SELECT o_orderkey AS path_id, o_orderkey % 5 AS project_id, 'cfg->f' || o_orderkey % 40 AS source_var, 'regs->' || o_orderstatus || o_custkey % 9 AS sink_var, o_orderkey % 7 AS depth FROM orders",
    "args": "SELECT l_orderkey AS call_id, l_linenumber AS arg_index, 'a' || l_suppkey AS text FROM lineitem",
    "assigns": "SELECT l_orderkey % 200 AS fn, 'r' || l_suppkey % 20 || CASE WHEN l_partkey % 3 = 0 THEN '->f' || l_partkey % 7 WHEN l_partkey % 3 = 1 THEN '.f' || l_partkey % 5 ELSE '' END AS lhs, 'q' || l_partkey % 20 || CASE WHEN l_suppkey % 2 = 0 THEN '->g' || l_partkey % 4 ELSE '' END AS rhs, l_orderkey * 10 + l_linenumber AS line FROM lineitem",
    "field_writes": "SELECT o_custkey AS fn, 'p' || o_orderkey % 4 AS pointer, o_orderkey AS line FROM orders",
}


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.sql(re.sub(r"FROM (\w+)", lambda m: f"FROM parquet.`{d}/{m[1]}.parquet`", VIEWS[name]))


def _with(sql: str, *more: str) -> str:
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", " ".join([sql, *more]))]
    parts = [*[f"{v} AS ({VIEWS[v]})" for v in used], *more]
    return f"WITH RECURSIVE {', '.join(parts)} {sql}" if parts else sql


def query(sql: str, *more: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = _with(sql, *more)
        return fn

    return add


def wanted(table: DataFrame, column: str = "id", every: int = 7) -> DataFrame:
    """The keys asked for: a parameter of the question, not a cut of the tables."""
    return table.where(F.col(column) % every == 0).select(F.col(column).alias("id"))


# --- points


@query("SELECT s.id, qualified_name, kind, path FROM symbols s JOIN files USING (file_id) WHERE s.id % 7 = 0")
def get_symbol(spark, d):
    s = view(spark, d, "symbols")
    return lookups.symbols_by_id(s, view(spark, d, "files"), wanted(s)).select("id", "qualified_name", "kind", "path")


@query("SELECT DISTINCT c.callee_usr AS usr, s.id FROM raw_calls c LEFT JOIN symbols s ON s.usr = c.callee_usr")
def resolve_symbol_id(spark, d):
    return lookups.ids_of(view(spark, d, "symbols"), view(spark, d, "raw_calls").select(F.col("callee_usr").alias("usr")))


@query("SELECT file_id, path FROM files WHERE path ILIKE '%/N1%' AND project_id = 1")
def list_project_files(spark, d):
    return lookups.files_like(view(spark, d, "files"), "/N1", 1).select("file_id", "path")


@query("SELECT f.file_id, f.path FROM files f WHERE EXISTS (SELECT 1 FROM includes i WHERE i.target_id = f.file_id)")
def get_file(spark, d):
    asked = view(spark, d, "includes").where("target_id IS NOT NULL").select(F.col("target_id").alias("file_id"))
    return lookups.files_at(view(spark, d, "files"), asked).select("file_id", "path")


@query("SELECT file_id, project_id, path FROM files WHERE path LIKE 'src/n1%'")
def get_file_by_path(spark, d):
    f = view(spark, d, "files")
    return lookups.files_at(f, f.where("path LIKE 'src/n1%'").select("project_id", "path")).select("file_id", "project_id", "path")


@query("SELECT file_id, path, file_hash FROM files")
def all_file_hashes(spark, d):
    return lookups.hashes(view(spark, d, "files"))


@query("SELECT w.want, coalesce((SELECT min(file_id) FROM files WHERE path = w.want), (SELECT min(file_id) FROM files WHERE regexp_extract(path, '[^/]*$') = regexp_extract(w.want, '[^/]*$'))) AS file_id FROM w", "w AS (SELECT path AS want FROM files WHERE file_id % 2 = 0 UNION SELECT 'other/' || regexp_extract(path, '[^/]*$') FROM files WHERE file_id % 2 = 1 UNION SELECT 'x.c')")
def file_by_name(spark, d):
    f = view(spark, d, "files")
    asked = f.where("file_id % 2 = 0").select(F.col("path").alias("want")).unionByName(f.where("file_id % 2 = 1").select(F.concat(F.lit("other/"), lookups.base_name(F.col("path"))).alias("want"))).unionByName(spark.range(1).select(F.lit("x.c").alias("want")))
    return lookups.files_by_name(f, asked)


@query("SELECT project_id, name, CASE WHEN project_id % 2 = 0 THEN '/src/' || name || '|/lib' ELSE '/src/' || name END AS roots FROM projects")
def list_projects(spark, d):
    return lookups.projects(view(spark, d, "projects")).select("project_id", "name", F.array_join("roots", "|").alias("roots"))


@query("SELECT project_id, count(*) AS n FROM files WHERE project_id = 3 GROUP BY project_id")
def resolve_project(spark, d):
    """Files of the project that is resolved: here by its id."""
    chosen = lookups.resolve_project(view(spark, d, "projects"), 3)
    return view(spark, d, "files").where(F.col("project_id") == chosen).groupBy("project_id").agg(F.count("*").alias("n"))


@query("SELECT pattern_id, name FROM patterns WHERE is_active")
def get_active_config_patterns(spark, d):
    return lookups.active(view(spark, d, "patterns")).select("pattern_id", "name")


@query("SELECT path_id, source_var, sink_var FROM paths WHERE source_var ILIKE '%CFG->f1%' AND sink_var ILIKE '%F1%' ORDER BY source_var, sink_var, path_id LIMIT 50")
def get_dataflow_paths(spark, d):
    return lookups.dataflow_paths(view(spark, d, "paths"), "CFG->f1", "F1").select("path_id", "source_var", "sink_var")


@query("SELECT call_id, arg_index, text FROM args WHERE call_id % 7 = 0")
def get_call_args(spark, d):
    a = view(spark, d, "args")
    return lookups.call_args(a, wanted(a, "call_id").withColumnRenamed("id", "call_id")).select("call_id", "arg_index", "text")


# --- joins


@query("SELECT c.call_id, c.callee_id, s.qualified_name AS caller, f.path FROM calls c JOIN symbols s ON s.id = c.caller_id JOIN files f ON f.file_id = c.file_id WHERE c.callee_id % 7 = 0")
def callers_with_files(spark, d):
    s = view(spark, d, "symbols")
    return lookups.callers(view(spark, d, "calls"), s, view(spark, d, "files"), wanted(s)).select("call_id", "callee_id", "caller", "path")


@query("SELECT c.call_id, c.caller_id, coalesce(s.qualified_name, c.callee_name) AS callee, f.path AS callee_path FROM calls c LEFT JOIN symbols s ON s.id = c.callee_id LEFT JOIN files f ON f.file_id = s.file_id WHERE c.caller_id % 7 = 0")
def get_callees(spark, d):
    s = view(spark, d, "symbols")
    return lookups.callees(view(spark, d, "calls"), s, view(spark, d, "files"), wanted(s)).select("call_id", "caller_id", "callee", "callee_path")


@query("SELECT b.derived_id, b.base_name, b.access, s.qualified_name AS base, f.path AS base_path FROM bases b LEFT JOIN symbols s ON s.id = b.base_id LEFT JOIN files f ON f.file_id = s.file_id WHERE b.derived_id IN (SELECT id FROM symbols WHERE id % 7 = 0)")
def base_classes(spark, d):
    s = view(spark, d, "symbols")
    return lookups.base_classes(view(spark, d, "bases"), s, view(spark, d, "files"), wanted(s)).select("derived_id", "base_name", "access", "base", "base_path")


@query("SELECT b.base_id, s.qualified_name AS derived, f.path AS derived_path FROM bases b JOIN symbols s ON s.id = b.derived_id JOIN files f ON f.file_id = s.file_id WHERE b.base_id IN (SELECT id FROM symbols WHERE id % 7 = 0)")
def derived_classes(spark, d):
    s = view(spark, d, "symbols")
    return lookups.derived_classes(view(spark, d, "bases"), s, view(spark, d, "files"), wanted(s)).select("base_id", "derived", "derived_path")


@query("SELECT b.derived_id AS src, b.base_id AS dst, count(*) AS n FROM bases b JOIN symbols s ON s.id = b.base_id JOIN symbols t ON t.id = b.derived_id GROUP BY ALL")
def inheritance_edges(spark, d):
    """One hop of inheritance between known classes."""
    known = view(spark, d, "symbols").select("id")
    edges = view(spark, d, "bases").join(known, F.col("base_id") == F.col("id"), "left_semi").join(known, F.col("derived_id") == F.col("id"), "left_semi")
    return edges.groupBy(F.col("derived_id").alias("src"), F.col("base_id").alias("dst")).agg(F.count("*").alias("n"))


@query("SELECT source_id, f.path, c.line, s.qualified_name AS symbol, p.name AS pattern FROM sources c JOIN files f USING (file_id) LEFT JOIN symbols s ON s.id = c.symbol_id LEFT JOIN patterns p USING (pattern_id) WHERE config_key = 'click'")
def get_config_sources(spark, d):
    t = lambda n: view(spark, d, n)
    return lookups.config_sources(t("sources"), t("files"), t("symbols"), t("patterns"), "click").select("source_id", "path", "line", "symbol", "pattern")


@query("SELECT usage_id, f.path, u.line, u.kind, s.qualified_name AS symbol FROM usages u JOIN files f USING (file_id) LEFT JOIN symbols s ON s.id = u.symbol_id")
def get_config_usages(spark, d):
    t = lambda n: view(spark, d, n)
    return lookups.config_usages(t("usages"), t("files"), t("symbols")).select("usage_id", "path", "line", "kind", "symbol")


@query("SELECT 'source' AS role, f.path, c.line, s.qualified_name AS symbol, p.name AS how FROM sources c JOIN files f USING (file_id) LEFT JOIN symbols s ON s.id = c.symbol_id LEFT JOIN patterns p USING (pattern_id) WHERE config_key = 'view' UNION ALL SELECT 'usage', f.path, u.line, s.qualified_name, u.kind FROM usages u JOIN files f USING (file_id) LEFT JOIN symbols s ON s.id = u.symbol_id WHERE config_key = 'view'")
def query_config(spark, d):
    t = lambda n: view(spark, d, n)
    return lookups.query_config(t("sources"), t("usages"), t("files"), t("symbols"), t("patterns"), "view")


_EDGES = "SELECT DISTINCT caller_id AS src, callee_id AS dst FROM calls WHERE callee_id IS NOT NULL AND file_id IN (SELECT file_id FROM files)"


@query("SELECT caller_id AS src, callee_id AS dst, count(*) AS n FROM calls WHERE callee_id IS NOT NULL AND file_id IN (SELECT file_id FROM files) GROUP BY ALL")
def all_calls(spark, d):
    return lookups.call_edges(view(spark, d, "calls"), view(spark, d, "files")).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("SELECT file_id AS src, target_id AS dst, count(*) AS n FROM includes WHERE target_id IS NOT NULL AND NOT is_system AND file_id IN (SELECT file_id FROM files) GROUP BY ALL")
def all_includes(spark, d):
    return lookups.include_edges(view(spark, d, "includes"), view(spark, d, "files")).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("SELECT call_id, caller_id, callee_id FROM (SELECT call_id, coalesce((SELECT min(id) FROM symbols s WHERE s.file_id = r.file_id AND s.usr = r.caller_usr), (SELECT min(id) FROM symbols s WHERE s.usr = r.caller_usr)) AS caller_id, coalesce((SELECT min(id) FROM symbols s WHERE s.file_id = r.file_id AND s.usr = r.callee_usr), (SELECT min(id) FROM symbols s WHERE s.usr = r.callee_usr)) AS callee_id FROM raw_calls r) WHERE caller_id IS NOT NULL")
def insert_calls(spark, d):
    """Calls by usr, resolved in their own file first: the rows that are appended."""
    return store.linked_calls(view(spark, d, "raw_calls"), view(spark, d, "symbols")).select("call_id", "caller_id", "callee_id")


@query("SELECT a.call_id, a.arg_index AS idx, a.text AS argument, 'p' || a.arg_index AS param FROM args a")
def call_param_binding(spark, d):
    """Arguments on parameters: every call is of one function with parameters 1 to 7."""
    a = view(spark, d, "args")
    listed = a.groupBy("call_id", "arg_index").agg(F.collect_list("text").alias("ts")).select("call_id", F.lit("f").alias("callee"), "arg_index", F.explode("ts").alias("text"))
    args = listed.select("call_id", "callee", F.concat(F.array_repeat(F.lit(None).cast("string"), F.col("arg_index")), F.array("text")).alias("args"))
    params = spark.range(1, 8).select(F.lit("f").alias("function"), F.col("id").cast("int").alias("idx"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"))
    return lookups.bound_arguments(args, params).where("argument IS NOT NULL").select("call_id", "idx", "argument", "param")


@query("SELECT n_name AS field, r.vals AS enum_values FROM nation n LEFT JOIN (SELECT r_regionkey % 3 AS enum, arg_max(r_name, r_regionkey) AS vals FROM region GROUP BY r_regionkey % 3) r ON r.enum = n.n_regionkey")
def enum_last_definition(spark, d):
    nation, region = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    fields = nation.select(F.col("n_name").alias("field"), F.concat(F.lit("enum e"), F.col("n_regionkey").cast("string")).alias("type"))
    types = region.select(F.concat(F.lit("e"), (F.col("r_regionkey") % 3).cast("string")).alias("enum"), F.array("r_name").alias("values"), F.col("r_regionkey").alias("ord"))
    return lookups.last_definition_of(fields, types).select("field", F.array_join("values", "|").alias("enum_values"))


# --- aggregations


@query("SELECT 'files' AS name, (SELECT count(*) FROM files) AS n UNION ALL SELECT 'symbols', (SELECT count(*) FROM symbols) UNION ALL SELECT 'functions', (SELECT count(*) FROM symbols WHERE kind IN ('FUNCTION', 'METHOD', 'CONSTRUCTOR')) UNION ALL SELECT 'classes', (SELECT count(*) FROM symbols WHERE kind IN ('CLASS', 'STRUCT')) UNION ALL SELECT 'calls', (SELECT count(*) FROM calls) UNION ALL SELECT 'config_keys', (SELECT count(DISTINCT config_key) FROM sources) UNION ALL SELECT 'sources', (SELECT count(*) FROM sources) UNION ALL SELECT 'usages', (SELECT count(*) FROM usages) UNION ALL SELECT 'dataflow_paths', (SELECT count(*) FROM paths)")
def store_stats(spark, d):
    t = {n: view(spark, d, n) for n in ("files", "symbols", "calls", "sources", "usages", "paths")}
    return catalog.store_stats(**t)


@query("SELECT access, count(*) AS n FROM bases GROUP BY access")
def dependency_breakdown(spark, d):
    return lookups.breakdown(view(spark, d, "bases"), "access")


@query("SELECT DISTINCT fn, pointer FROM field_writes WHERE (fn, pointer) IN (SELECT (fn, pointer) FROM field_writes GROUP BY fn, pointer HAVING count(*) >= 3)")
def bulk_assignments(spark, d):
    return lookups.groups_of(view(spark, d, "field_writes"), ["fn", "pointer"], 3).select("fn", "pointer").distinct()


@query("SELECT sink_var, string_agg(source_var, '|' ORDER BY a) AS source_vars FROM (SELECT sink_var, source_var, min(path_id) AS a FROM paths GROUP BY ALL) GROUP BY sink_var")
def spec_sources(spark, d):
    """Distinct sources of each sink, in the order of their first path."""
    return lookups.ordered_distinct(view(spark, d, "paths"), "sink_var", "source_var", "path_id").select("sink_var", F.array_join("values", "|").alias("source_vars"))


_FINGERPRINT = [f"l{k} AS (SELECT k // 4096 AS k, sha256(string_agg(d, chr(10) ORDER BY k, d)) AS d FROM {f'l{k - 1}' if k else 'l'} GROUP BY k // 4096)" for k in range(6)]


@query("SELECT d AS fingerprint FROM l5", "l AS (SELECT call_id AS k, call_id || ':' || callee_name || line AS d FROM calls)", *_FINGERPRINT)
def project_fingerprint(spark, d):
    """Over the calls, so that the tree branches: 60,000 rows stand in 15 leaves and more."""
    return catalog.fingerprint(view(spark, d, "calls"), "call_id", F.concat("callee_name", F.col("line").cast("string")))


@query("SELECT config_key AS gating, string_agg(DISTINCT kind, ',' ORDER BY kind) AS gated FROM usages GROUP BY config_key UNION ALL SELECT kind, string_agg(DISTINCT config_key, ',' ORDER BY config_key) FROM usages GROUP BY kind")
def gating_both_ways(spark, d):
    from ..operators import configdeps

    u = view(spark, d, "usages")
    one = lambda a, b: configdeps.gating_map(u, a, b).select(F.col(a).alias("gating"), F.array_join(b, ",").alias("gated"))
    return one("config_key", "kind").unionByName(one("kind", "config_key"))


@query("SELECT sink_var AS sink, string_agg(x, ' ' ORDER BY x) AS paths FROM (SELECT DISTINCT sink_var, source_var || '/' || depth AS x FROM paths) GROUP BY sink_var")
def paths_by_sink(spark, d):
    p = view(spark, d, "paths").select(F.col("sink_var").alias("sink"), F.concat_ws("/", "source_var", F.col("depth").cast("string")).alias("path"))
    return taint.by_sink(p).select("sink", F.array_join("paths", " ").alias("paths"))


# --- graphs


@query("SELECT array_to_string(list_transform(p, lambda x: x::VARCHAR), '>') AS path FROM (SELECT p FROM w WHERE p[-1] IN (SELECT id FROM symbols WHERE qualified_name = (SELECT qualified_name FROM symbols WHERE id = 3)) ORDER BY len(p), p LIMIT 10)", f"e AS ({_EDGES})", "w AS (SELECT [src, dst] AS p FROM e WHERE src <> dst AND src IN (SELECT id FROM symbols WHERE qualified_name = (SELECT qualified_name FROM symbols WHERE id = 1)) UNION ALL SELECT list_append(p, dst) FROM w JOIN e ON e.src = p[-1] WHERE len(p) < 4 AND NOT list_contains(p, dst))")
def trace_path(spark, d):
    s = view(spark, d, "symbols")
    src, dst = (s.where(F.col("id") == k).first()["qualified_name"] for k in (1, 3))
    found = graph.trace_path(lookups.call_edges(view(spark, d, "calls"), view(spark, d, "files")), s, src, dst, cutoff=3)
    return found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


_FIRST = "(SELECT id FROM symbols WHERE name = 'red widget' ORDER BY name, id LIMIT 1)"


@query(f"SELECT {_FIRST} AS start, dst AS id, min(hops) AS hops FROM (SELECT dst, 1 AS hops FROM e WHERE src = {_FIRST} UNION ALL SELECT b.dst, 2 FROM e a JOIN e b ON b.src = a.dst WHERE a.src = {_FIRST}) GROUP BY dst", f"e AS ({_EDGES})")
def who(spark, d):
    return graph.who(lookups.call_edges(view(spark, d, "calls"), view(spark, d, "files")), view(spark, d, "symbols"), "red widget", "callees", 2)


@query("SELECT id, 'direct' AS role FROM d UNION ALL SELECT DISTINCT dst, 'affected' FROM (SELECT e.dst FROM d JOIN e ON e.src = d.id UNION SELECT b.dst FROM d JOIN e a ON a.src = d.id JOIN e b ON b.src = a.dst) WHERE dst NOT IN (SELECT id FROM d)", f"e AS ({_EDGES})", "d AS (SELECT DISTINCT symbol_id AS id FROM usages WHERE config_key = 'purchase')")
def trace_config(spark, d):
    roles, _ = graph.trace_config(view(spark, d, "usages"), lookups.call_edges(view(spark, d, "calls"), view(spark, d, "files")), "purchase", depth=2)
    return roles


@query("SELECT node, parent, depth, rep AS repeats, array_to_string(list_transform(path, lambda x: x::VARCHAR), '>') AS path FROM t", "e AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM (SELECT DISTINCT file_id AS src, target_id AS dst FROM includes WHERE target_id IS NOT NULL AND NOT is_system AND file_id IN (SELECT file_id FROM files))) WHERE k <= 15)", "t AS (SELECT 1::BIGINT AS node, NULL::BIGINT AS parent, 0 AS depth, [1::BIGINT] AS path, false AS rep UNION ALL SELECT e.dst, e.src, depth + 1, list_append(path, e.dst), list_contains(path, e.dst) FROM t JOIN e ON e.src = t.node WHERE depth < 3 AND NOT rep)")
def include_tree(spark, d):
    found = graph.tree(lookups.include_edges(view(spark, d, "includes"), view(spark, d, "files")), 1, depth=3, breadth=15)
    return found.select("node", "parent", "depth", "repeats", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


# --- the write path


@query("SELECT p.project_id, p.name, CASE WHEN n.name IS NULL THEN p.root_paths ELSE '/new' END AS root_paths, CASE WHEN n.name IS NULL THEN p.last_indexed ELSE 'now' END AS last_indexed FROM projects p LEFT JOIN (SELECT name FROM projects WHERE project_id > 2) n USING (name)")
def upsert_project(spark, d):
    p = view(spark, d, "projects")
    return store.upsert_projects(p, p.where("project_id > 2").select("name", F.lit("/new").alias("root_paths")), F.lit("now"))


@query("SELECT project_id, CASE WHEN project_id = 2 THEN 'now' ELSE last_indexed END AS last_indexed FROM projects")
def touch_project(spark, d):
    return store.touched(view(spark, d, "projects"), 2, F.lit("now")).select("project_id", "last_indexed")


@query("SELECT id, file_id, line FROM symbols WHERE file_id % 3 > 0 UNION ALL SELECT id + 1000000, file_id, line + 1 FROM symbols WHERE file_id % 6 = 0")
def replace_file_rows(spark, d):
    """Every third file is indexed again; half of these have no symbols left."""
    s = view(spark, d, "symbols").select("id", "file_id", "line")
    rows = s.where("file_id % 6 = 0").select((F.col("id") + 1000000).alias("id"), "file_id", (F.col("line") + 1).alias("line"))
    return store.replaced(s, rows, s.where("file_id % 3 = 0"))


@query("SELECT path_id, project_id, depth FROM paths WHERE project_id <> 2 UNION ALL SELECT path_id + 1, project_id, 9 FROM paths WHERE project_id = 2 AND depth = 1")
def save_results(spark, d):
    p = view(spark, d, "paths").select("path_id", "project_id", "depth")
    rows = p.where("project_id = 2 AND depth = 1").select((F.col("path_id") + 1).alias("path_id"), "project_id", F.lit(9).cast("long").alias("depth"))
    return store.saved_results(p, 2, rows)


@query("SELECT path_id, source_var, sink_var, depth FROM paths")
def path_json_round_trip(spark, d):
    p = view(spark, d, "paths")
    coded = store.encoded(p, ["source_var", "sink_var", "depth"]).select("path_id", "path_json")
    return store.decoded(coded, "source_var string, sink_var string, depth bigint")


@query("SELECT pattern_id, name, kind, pattern_id % 2 = 0 AS is_active FROM patterns")
def sync_config_patterns(spark, d):
    """The pattern file now holds every other pattern."""
    p = view(spark, d, "patterns")
    return store.synced_patterns(p, p.where("pattern_id % 2 = 0").select("name", "kind"))


@query("SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'new' ELSE file_hash END AS file_hash FROM files")
def config_scan_state(spark, d):
    f = view(spark, d, "files").select("file_id", "file_hash")
    return store.mark_scanned(f, f.where("file_id % 3 = 0").select("file_id", F.lit("new").alias("file_hash")))


@query("SELECT source_id, file_id, line FROM sources WHERE file_id % 3 > 0 UNION ALL SELECT source_id, file_id, line + 1 FROM sources WHERE file_id % 3 = 0 AND line > 50")
def scan_changed_files(spark, d):
    """A scan gated by hash: files with a new hash are scanned again, others keep their hits."""
    from ..operators import cache

    s = view(spark, d, "sources").select("source_id", "file_id", "line")
    files = s.select("file_id").distinct().withColumn("file_hash", F.when(F.col("file_id") % 3 == 0, "new").otherwise("old"))
    due = cache.to_scan(files, files.select("file_id", F.lit("old").alias("file_hash")).withColumn("patterns", F.lit(cache.pattern_key([]))), [])
    return store.rescanned(s, due, s.join(due, "file_id", "left_semi").where("line > 50").withColumn("line", F.col("line") + 1))


@query("SELECT file_id, CASE WHEN file_id % 4 = 0 THEN 'due' ELSE 'held' END AS state FROM files WHERE file_id % 5 < 4")
def parse_cache(spark, d):
    """Files that the cache answers for, and those to be parsed: changed ones, not those that went."""
    cached = view(spark, d, "files").select("file_id", "file_hash")
    files = cached.where("file_id % 5 < 4").withColumn("file_hash", F.when(F.col("file_id") % 4 == 0, F.concat("file_hash", F.lit("x"))).otherwise(F.col("file_hash")))
    held = store.cache_valid(cached, files).select("file_id", F.lit("held").alias("state"))
    return held.unionByName(store.parse_due(files, cached).select("file_id", F.lit("due").alias("state")))


# --- relations of dataflow


@query("SELECT DISTINCT fn, 'lhs' AS view, lhs AS key FROM assigns UNION SELECT DISTINCT fn, 'suffix', regexp_extract(lhs, '(->|\\.).*$') FROM assigns WHERE regexp_matches(lhs, '->|\\.')")
def writer_index(spark, d):
    return relations.writers(view(spark, d, "assigns")).select("fn", "view", "key").distinct()


@query("SELECT fn, lhs AS name, arg_max(rhs, (line, rhs)) AS origin FROM assigns WHERE regexp_full_match(lhs, '\\w+') AND regexp_full_match(rhs, '\\w+') GROUP BY fn, lhs")
def alias_map(spark, d):
    return relations.aliases(view(spark, d, "assigns"))


@query("SELECT DISTINCT a.fn, a.lhs AS var, b.lhs AS other FROM assigns a JOIN assigns b ON a.fn = b.fn AND regexp_extract(a.lhs, '^\\w+') = regexp_extract(b.lhs, '^\\w+') WHERE regexp_matches(a.lhs, '->|\\.') AND regexp_matches(b.lhs, '->|\\.') AND a.lhs <> b.lhs AND regexp_extract(a.lhs, '^\\w+') IN ('r1', 'r2', 'r3')")
def union_aliases(spark, d):
    unions = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "var string")
    return relations.union_members(view(spark, d, "assigns"), unions)


@query("SELECT DISTINCT fn, regexp_extract(lhs, '^\\w+') AS var, lhs AS part FROM assigns WHERE regexp_matches(lhs, '->|\\.') AND (fn, regexp_extract(lhs, '^\\w+')) NOT IN (SELECT (fn, lhs) FROM assigns)")
def partial_writes(spark, d):
    return relations.partial_writes(view(spark, d, "assigns"))


@query("SELECT DISTINCT a.fn, a.lhs AS var, b.fn AS writer FROM assigns a JOIN assigns b ON regexp_extract(a.lhs, '(->|\\.).*$') = regexp_extract(b.lhs, '(->|\\.).*$') WHERE regexp_matches(a.lhs, '->|\\.') AND a.fn <> b.fn AND a.fn % 50 = 0")
def cross_function_writers(spark, d):
    """Writers of the same field in other functions, for functions without callers (here: every fiftieth)."""
    a = view(spark, d, "assigns")
    return relations.field_writers(a, a.where("fn % 50 = 0").select("fn").distinct())


@query("SELECT path_id, replace(sink_var, 'regs', 'dev_' || depth) AS sink FROM paths")
def sink_substitution(spark, d):
    """The parameter regs of each sink's function, as its caller names it."""
    p = view(spark, d, "paths")
    return p.select("path_id", relations.substituted(F.col("sink_var"), F.array(F.struct(F.lit("regs").alias("param"), F.concat(F.lit("dev_"), F.col("depth").cast("string")).alias("argument")))).alias("sink"))


@query("SELECT DISTINCT fn, rhs AS var, regexp_extract(rhs, '^\\w+') IN ('q1', 'q2') AS is_param FROM assigns")
def is_param(spark, d):
    a = view(spark, d, "assigns")
    params = a.select("fn").distinct().select("fn", F.explode(F.array(F.lit("q1"), F.lit("q2"))).alias("name"))
    return relations.with_is_param(a.select("fn", F.col("rhs").alias("var")).distinct(), params)


# --- texts


@query("SELECT path_id, 'regs' || '_' || depth || ' <= ' || (depth + 1) AS made FROM paths")
def kconfig_condition(spark, d):
    p = view(spark, d, "paths")
    return p.select("path_id", condition(F.concat(F.lit("regs->"), F.col("depth").cast("string"), F.lit("<="), (F.col("depth") + 1).cast("string"))).alias("made"))


@query("SELECT id, CASE kind WHEN 'FUNCTION' THEN 'bool' WHEN 'METHOD' THEN 'string' ELSE 'int' END AS type, CASE kind WHEN 'FUNCTION' THEN 'y' WHEN 'METHOD' THEN '\"' || name || '\"' ELSE line::VARCHAR END AS given, left(name || ' ' || usr, 12) AS short FROM symbols")
def kconfig_values(spark, d):
    s = view(spark, d, "symbols")
    c_type = F.when(F.col("kind") == "FUNCTION", "bool").when(F.col("kind") == "METHOD", "char *").otherwise("unsigned int")
    value = F.when(F.col("kind") == "FUNCTION", "true").when(F.col("kind") == "METHOD", F.col("name")).otherwise(F.col("line").cast("string"))
    return s.select("id", kconfig_type(c_type).alias("type"), kconfig_default(c_type, value).alias("given"), snippet(F.concat("name", F.lit("\n"), "usr"), 12).alias("short"))


@query("SELECT sink_var AS sink, source_var || ' -> v' || depth || ' => ' || sink_var AS chain, count(*) AS n FROM paths GROUP BY ALL")
def format_chain(spark, d):
    p = view(spark, d, "paths")
    steps = F.array(F.concat(F.lit("v"), F.col("depth").cast("string")), F.col("source_var"))
    return p.select(F.col("sink_var").alias("sink"), taint.chain(steps, F.col("sink_var")).alias("chain")).groupBy("sink", "chain").agg(F.count("*").alias("n"))


@query("SELECT r_name AS struct, 'menu \"' || r_name || '\"' || chr(10) || string_agg('config ' || upper(regexp_replace(r_name || '_' || n_name, '[^A-Za-z0-9]', '_', 'g')) || chr(10) || '    int' || chr(10) || '    default ' || n_nationkey || chr(10) || '    range 0 ' || n_nationkey, chr(10) || chr(10) ORDER BY n_name) || chr(10) || 'endmenu' AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def kconfig_text(spark, d):
    nation, region = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    specs = rows.select(F.col("r_name").alias("struct"), F.col("n_name").alias("field"), F.lit("int").alias("type"), F.array().cast("array<string>").alias("enum_values"), F.lit("0").alias("low"), F.col("n_nationkey").cast("string").alias("high"))
    return exports.kconfig(specs, None, rows.select(F.col("n_name").alias("field"), F.col("n_nationkey").cast("string").alias("value")))


# --- the ordered trace, call targets and alias chains

VIEWS |= {
    "alias_writes": "SELECT l_orderkey % 400 AS fn, 'v' || l_suppkey % 40 AS lhs, 'v' || l_partkey % 40 AS rhs, l_orderkey * 10 + l_linenumber AS line FROM lineitem",
    "pt_bases": "SELECT 'n' || s_suppkey * 7 AS loc, 'f' || s_suppkey AS target FROM supplier",
    "pt_copies": "SELECT 'n' || o_custkey % 700 AS src, 'n' || o_orderkey % 1900 AS dst FROM orders WHERE o_orderkey % 3 = 0",
    "pt_calls": "SELECT c_custkey AS call, 'n' || c_custkey AS loc FROM customer",
    "pt_args": "SELECT c_custkey AS call, 0 AS idx, 'n' || c_custkey * 3 % 1500 AS loc FROM customer",
    "pt_params": "SELECT 'f' || s_suppkey AS target, 0 AS idx, 'n' || s_suppkey * 11 AS loc FROM supplier",
    "flow_assigns": """SELECT 'f' || l_orderkey % 3000 AS fn, CASE l_suppkey % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'p->x' || (l_partkey * 7 + l_suppkey * 13) % 2003 WHEN 3 THEN 'u.m' || l_partkey % 3 WHEN 4 THEN 's.y' || l_partkey % 2 ELSE 'g' || (l_partkey * 7 + l_suppkey * 13) % 2003 END AS lhs,
  CASE l_partkey % 9 WHEN 0 THEN 'cfg->k' || l_suppkey % 9 WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'p->x' || (l_partkey * 11 + l_suppkey * 17) % 2003 WHEN 4 THEN 'u.m' || l_suppkey % 3 WHEN 5 THEN 'g' || (l_partkey * 11 + l_suppkey * 17) % 2003 WHEN 6 THEN 's' WHEN 7 THEN 'p' ELSE 'dst' END AS rhs,
  CASE WHEN l_quantity > 44 THEN 'f' || l_partkey % 3000 ELSE '' END AS rhs_call, CAST((l_orderkey - l_orderkey % 3000) / 3000 AS INT) * 10 + l_linenumber AS line FROM lineitem""",
    "flow_params": "SELECT 'f' || o_orderkey AS fn, 0 AS idx, 'p' AS name FROM orders WHERE o_orderkey < 3000 AND o_orderkey % 2 = 0",
    "flow_returns": "SELECT 'f' || o_orderkey % 3000 AS fn, CASE o_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'g' || o_custkey * 11 % 2003 ELSE 'p->x' || o_custkey * 7 % 2003 END AS var, CAST((o_orderkey - o_orderkey % 3000) / 3000 AS INT) AS line FROM orders WHERE o_custkey % 4 = 0",
    "flow_calls": "SELECT 'f' || o_orderkey % 3000 AS fn, 'f' || o_custkey * 2 % 3000 AS target, CAST((o_orderkey - o_orderkey % 3000) / 3000 AS INT) AS line, 0 AS idx, CASE o_custkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'p' WHEN 2 THEN 'g' || o_custkey * 11 % 2003 ELSE 's.y1' END AS text FROM orders WHERE o_orderkey % 5 < 2",
    "flow_unions": "SELECT 'f' || o_orderkey AS fn, 'u' AS name FROM orders WHERE o_orderkey < 3000 AND o_orderkey % 3 = 0",
    "flow_copies": "SELECT 'f' || o_orderkey AS fn, 'dst' AS dst, CASE o_orderkey % 2 WHEN 0 THEN 'b' ELSE 'u.m1' END AS src FROM orders WHERE o_orderkey < 3000 AND o_orderkey % 7 < 3",
    "flow_locals": "SELECT 'f' || o_orderkey AS fn, 'g' || o_orderkey * 3 % 2003 AS name FROM orders WHERE o_orderkey < 3000 UNION ALL SELECT DISTINCT 'f' || l_orderkey % 3000, 'a' FROM lineitem UNION ALL SELECT DISTINCT 'f' || l_orderkey % 3000, 'b' FROM lineitem",
    "flow_sinks": """SELECT CAST(l_orderkey * 10 + l_linenumber AS STRING) AS sink_id, 'regs->r' || l_linenumber || ' = ' || CASE l_partkey % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'p->x' || (l_partkey * 11 + l_suppkey * 17) % 2003 WHEN 3 THEN 'u.m0' WHEN 4 THEN 's' ELSE 'g' || (l_partkey * 11 + l_suppkey * 17) % 2003 END AS sink, 'f' || l_orderkey % 3000 AS fn,
  CAST((l_orderkey - l_orderkey % 3000) / 3000 AS INT) * 10 + l_linenumber AS line, CASE l_partkey % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'p->x' || (l_partkey * 11 + l_suppkey * 17) % 2003 WHEN 3 THEN 'u.m0' WHEN 4 THEN 's' ELSE 'g' || (l_partkey * 11 + l_suppkey * 17) % 2003 END AS var, 0 AS pos FROM lineitem WHERE l_suppkey = 7""",
}


@query(
    "SELECT fn, name, coalesce(CASE WHEN next IS NULL THEN cur ELSE list_min(path[list_position(path, next):]) END, cur) AS origin FROM ends WHERE name <> coalesce(CASE WHEN next IS NULL THEN cur ELSE list_min(path[list_position(path, next):]) END, cur)",
    "al AS (SELECT fn, lhs AS name, arg_max(rhs, (line, rhs)) AS origin FROM alias_writes WHERE lhs <> rhs GROUP BY fn, lhs)",
    "chase AS (SELECT fn, name, origin AS cur, [name, origin] AS path FROM al UNION ALL SELECT c.fn, c.name, al.origin, list_append(path, al.origin) FROM chase c JOIN al ON al.fn = c.fn AND al.name = c.cur WHERE NOT list_contains(path, al.origin))",
    "ends AS (SELECT c.fn, c.name, c.cur, c.path, al.origin AS next FROM chase c LEFT JOIN al ON al.fn = c.fn AND al.name = c.cur WHERE al.origin IS NULL OR list_contains(c.path, al.origin))",
)
def alias_closure(spark, d):
    """What each alias stands for at the end of its chain, however long; cycles by their least name."""
    return pointsto.closed_aliases(relations.aliases(view(spark, d, "alias_writes")))


def _rounds(n: int) -> list[str]:
    """Targets and copies after each of n rounds, written out."""
    parts = ["p0 AS MATERIALIZED (SELECT DISTINCT loc, target FROM pt_bases)", "e0 AS MATERIALIZED (SELECT DISTINCT src, dst FROM pt_copies)"]
    for k in range(n):
        parts.append(f"p{k + 1} AS MATERIALIZED (SELECT loc, target FROM p{k} UNION SELECT dst, target FROM p{k} JOIN e{k} ON src = loc)")
        parts.append(f"e{k + 1} AS MATERIALIZED (SELECT src, dst FROM e{k} UNION SELECT a.loc, m.loc FROM p{k} p JOIN pt_calls c ON c.loc = p.loc JOIN pt_args a ON a.call = c.call JOIN pt_params m ON m.target = p.target AND m.idx = a.idx)")
    return parts


@query("SELECT DISTINCT call, target FROM p40 p JOIN pt_calls c ON c.loc = p.loc", *_rounds(40))
def call_targets(spark, d):
    """The functions that each call may enter, by copies of pointers and by arguments of calls that are found on the way."""
    return pointsto.points_to(*(view(spark, d, f"pt_{k}") for k in ("bases", "copies", "calls", "args", "params")))[1]


def _flow(spark: SparkSession, d: str) -> backward.Facts:
    a, calls = view(spark, d, "flow_assigns"), view(spark, d, "flow_calls")
    returns = view(spark, d, "flow_returns").withColumn("vars", F.array("var"))
    made = a.withColumn("rhs_vars", F.array("rhs")).withColumn("transform", F.lit("assign"))
    return backward.Facts(made, calls.withColumn("vars", F.array("text")), view(spark, d, "flow_params"), returns, view(spark, d, "flow_unions"), view(spark, d, "flow_copies"), view(spark, d, "flow_locals"))


_DEPTH = 4
_TAIL = r"regexp_extract({}, '^\w+?(([.]|->).*)?$', 1)"
_HEAD = r"regexp_extract({}, '^\w+')"


def _trace_sql() -> list[str]:
    head, tail = _HEAD.format, _TAIL.format
    key = lambda rank, at, sub, pos: f"'{rank:02d}' || lpad(({at})::VARCHAR, 10, '0') || {sub} || lpad(({pos})::VARCHAR, 4, '0') || to_fn || ':' || to_var"
    end = backward.END
    return [
        "defs AS (SELECT fn, lhs, line, min(rhs_call || chr(1) || rhs) AS d FROM flow_assigns GROUP BY ALL)",
        "one AS MATERIALIZED (SELECT fn, lhs, line, split_part(d, chr(1), 1) AS rhs_call, split_part(d, chr(1), 2) AS rhs FROM defs)",
        "rets AS (SELECT fn, var, row_number() OVER (PARTITION BY fn ORDER BY line, var) AS pos FROM flow_returns)",
        f"reads AS MATERIALIZED (SELECT o.fn, lhs, line, 0 AS sub, pos, rhs_call AS to_fn, var AS to_var, {end} AS to_line FROM one o JOIN rets r ON r.fn = o.rhs_call UNION ALL SELECT fn, lhs, line, 1, 0, fn, rhs, line FROM one)",
        f"passed AS (SELECT c.target AS fn, name AS key, c.line, c.fn AS to_fn, text AS to_var FROM flow_calls c JOIN flow_params p ON p.fn = c.target AND p.idx = c.idx)",
        "own AS (SELECT fn, name FROM flow_locals UNION SELECT fn, name FROM flow_params)",
        f"""moves AS MATERIALIZED (
  SELECT DISTINCT 'def' AS rule, fn, lhs AS key, line AS since, NULL AS but, {key(3, f'{end} - line', 'sub', 'pos')} AS ord, to_fn, to_var, to_line, '' AS carry FROM reads
  UNION SELECT 'union', fn, {head('lhs')}, NULL, lhs, {key(4, f'{end} - line', 'sub', 'pos')}, to_fn, to_var, to_line, '' FROM reads r WHERE {tail('lhs')} LIKE '.%' AND EXISTS (SELECT 1 FROM flow_unions u WHERE u.fn = r.fn AND u.name = {head('lhs')})
  UNION SELECT 'copy', fn, dst, NULL, NULL, {key(5, '0', '0', '0')}, to_fn, to_var, NULL, '' FROM (SELECT fn, dst, fn AS to_fn, src AS to_var FROM flow_copies)
  UNION SELECT 'part', fn, {head('lhs')}, NULL, NULL, {key(6, f'{end} - line', 'sub', 'pos')}, to_fn, to_var, to_line, '' FROM reads WHERE {tail('lhs')} <> ''
  UNION SELECT 'param', fn, key, NULL, NULL, {key(9, 'line', '1', '0')}, to_fn, to_var, {end}, 'field' FROM passed
  UNION SELECT 'param', fn, key, NULL, NULL, {key(9, 'line', '2', '0')}, to_fn, to_var, {end}, '' FROM passed
  UNION SELECT 'field', '', {tail('lhs')}, NULL, fn, {key(10, 'line', 'sub', 'pos')}, to_fn, to_var, {end}, '' FROM reads WHERE sub = 1 AND {tail('lhs')} <> ''
  UNION SELECT 'global', '', lhs, NULL, fn, {key(11, 'line', 'sub', 'pos')}, to_fn, to_var, {end}, '' FROM reads r WHERE sub = 1 AND {tail('lhs')} = '' AND NOT EXISTS (SELECT 1 FROM own WHERE own.fn = r.fn AND own.name = lhs))""",
        r"al AS (SELECT fn, lhs AS name, arg_max(rhs, (line, rhs)) AS origin FROM flow_assigns WHERE regexp_full_match(lhs, '\w+') AND regexp_full_match(rhs, '\w+') AND lhs <> rhs GROUP BY fn, lhs)",
        "chase AS (SELECT fn, name, origin AS cur, [name, origin] AS path FROM al UNION ALL SELECT c.fn, c.name, al.origin, list_append(path, al.origin) FROM chase c JOIN al ON al.fn = c.fn AND al.name = c.cur WHERE NOT list_contains(path, al.origin))",
        "origins AS MATERIALIZED (SELECT * FROM (SELECT c.fn, c.name, CASE WHEN al.origin IS NULL THEN c.cur ELSE list_min(c.path[list_position(c.path, al.origin):]) END AS origin FROM chase c LEFT JOIN al ON al.fn = c.fn AND al.name = c.cur WHERE al.origin IS NULL OR list_contains(c.path, al.origin)) WHERE name <> origin)",
        "firsts AS MATERIALIZED (SELECT fn, lhs AS var, min(line) AS first FROM one GROUP BY fn, lhs)",
        f"parts AS MATERIALIZED (SELECT DISTINCT fn, {head('lhs')} AS var FROM one WHERE {tail('lhs')} <> '')",
        "called AS MATERIALIZED (SELECT DISTINCT target AS fn FROM flow_calls)",
        f"""starts AS (SELECT sink_id, '0000' AS start, sink AS label, '' AS ord, fn, var, line AS bound, [fn || ':' || var] AS steps FROM flow_sinks
  UNION ALL SELECT sink_id, '0000@' || c.fn || ':' || lpad(c.line::VARCHAR, 10, '0'), regexp_replace(sink, '\\bp\\b', text, 'g'), lpad((k - 1)::VARCHAR, 4, '0'), c.fn, CASE WHEN k = 1 THEN text || {tail('s.var')} ELSE text END, {end}, [s.fn || ':' || s.var, c.fn || ':' || CASE WHEN k = 1 THEN text || {tail('s.var')} ELSE text END]
  FROM flow_sinks s JOIN flow_params p ON p.fn = s.fn AND p.name = {head('s.var')} JOIN flow_calls c ON c.target = s.fn AND c.idx = p.idx, (SELECT unnest([1, 2]) AS k) WHERE k = 1 OR {tail('s.var')} <> '')""",
        f"""walk AS (SELECT 0 AS level, sink_id, start, label, ord, fn, var, bound, steps FROM (SELECT *, row_number() OVER (PARTITION BY sink_id, start, fn, var, bound ORDER BY ord) AS k FROM starts) WHERE k = 1
  UNION ALL (SELECT level, sink_id, start, label, ord, fn, var, bound, steps FROM (SELECT *, row_number() OVER (PARTITION BY sink_id, start, fn, var, bound ORDER BY ord) AS k FROM (
    SELECT l.level + 1 AS level, l.sink_id, l.start, l.label, l.ord || chr(1) || q.turn || m.ord AS ord, m.to_fn AS fn, m.to_var || CASE WHEN m.carry = 'field' THEN l.more ELSE '' END AS var, coalesce(m.to_line, l.bound) AS bound,
      list_append(l.steps, m.to_fn || ':' || m.to_var || CASE WHEN m.carry = 'field' THEN l.more ELSE '' END) AS steps
    FROM (SELECT s.*, unnest([
        {{'rule': 'def', 'f': fn, 'key': var, 'turn': '0', 'ok': TRUE}}, {{'rule': 'def', 'f': fn, 'key': real, 'turn': '1', 'ok': real <> var}},
        {{'rule': 'union', 'f': fn, 'key': {head('real')}, 'turn': '1', 'ok': fresh AND member}}, {{'rule': 'copy', 'f': fn, 'key': real, 'turn': '1', 'ok': fresh AND NOT member}},
        {{'rule': 'part', 'f': fn, 'key': real, 'turn': '1', 'ok': fresh AND {tail('real')} = ''}}, {{'rule': 'param', 'f': fn, 'key': {head('var')}, 'turn': '1', 'ok': is_param}},
        {{'rule': 'field', 'f': '', 'key': more, 'turn': '1', 'ok': is_param AND NOT is_called AND more <> ''}},
        {{'rule': 'global', 'f': '', 'key': var, 'turn': '1', 'ok': fresh AND NOT has_parts AND NOT is_param AND NOT is_local AND more = ''}}]) AS q
      FROM (SELECT w.*, coalesce(f.first > w.bound, TRUE) AS fresh, t.var IS NOT NULL AS has_parts, w.in_union AND {tail('w.real')} LIKE '.%' AS member FROM (
        SELECT w.*, {tail('w.var')} AS more, coalesce(o.origin || {tail('w.var')}, w.var) AS real, EXISTS (SELECT 1 FROM flow_unions u WHERE u.fn = w.fn AND u.name = coalesce(o.origin, {head('w.var')})) AS in_union,
          EXISTS (SELECT 1 FROM flow_params p WHERE p.fn = w.fn AND p.name = {head('w.var')}) AS is_param, EXISTS (SELECT 1 FROM flow_locals p WHERE p.fn = w.fn AND p.name = {head('w.var')}) AS is_local,
          EXISTS (SELECT 1 FROM called c WHERE c.fn = w.fn) AS is_called
        FROM walk w LEFT JOIN origins o ON o.fn = w.fn AND o.name = {head('w.var')} WHERE w.level < {_DEPTH - 1} AND w.var NOT LIKE '%cfg->%') w
        LEFT JOIN firsts f ON f.fn = w.fn AND f.var = w.real LEFT JOIN parts t ON t.fn = w.fn AND t.var = w.real WHERE w.real NOT LIKE '%cfg->%') s) l
    JOIN moves m ON m.rule = q.rule AND m.fn = q.f AND m.key = q.key
    WHERE q.ok AND (m.since IS NULL OR m.since <= l.bound) AND (m.but IS NULL OR m.but <> CASE WHEN q.rule = 'union' THEN l.real ELSE l.fn END) AND (m.carry <> 'field' OR l.more <> '')
      AND NOT list_contains(l.steps, m.to_fn || ':' || m.to_var || CASE WHEN m.carry = 'field' THEN l.more ELSE '' END)) x) y WHERE k = 1))""",
        f"hits AS (SELECT w.*, CASE WHEN w.var LIKE '%cfg->%' THEN w.var ELSE o.origin || {tail('w.var')} END AS source FROM walk w LEFT JOIN origins o ON o.fn = w.fn AND o.name = {head('w.var')} WHERE w.var LIKE '%cfg->%' OR o.origin || {tail('w.var')} LIKE '%cfg->%')",
        "least AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY sink_id, start ORDER BY ord) = 1)",
    ]


@query("SELECT sink_id, start, label, source, fn AS source_fn, array_to_string(steps, ' < ') AS chain, (len(steps) - 1)::INTEGER AS hops FROM least QUALIFY row_number() OVER (PARTITION BY sink_id, source, fn, label ORDER BY start) = 1", *_trace_sql())
def trace_backward(spark, d):
    """The least chain from each sink, and from each call that leads to it, back to a source: all rules, with definitions by line."""
    found = backward.trace(view(spark, d, "flow_sinks"), _flow(spark, d), [r"cfg->\w+"], _DEPTH)
    return found.select("sink_id", "start", "label", "source", "source_fn", F.array_join(backward.told(F.col("nodes")), " < ").alias("chain"), "hops")


# --- whole cycles, long paths, roots

VIEWS |= {
    "ring_edges": "SELECT c_custkey AS src, c_custkey - c_custkey % 12 + (c_custkey + 1) % 12 AS dst FROM customer WHERE c_custkey % 144 < 132 UNION ALL SELECT c_custkey, c_custkey - c_custkey % 12 + (c_custkey + 5) % 12 FROM customer WHERE c_custkey % 4 = 1 UNION ALL SELECT c_custkey, c_custkey + 12 FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 36 < 24",
    "page_roots": "SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/]+/)', 1) AS root FROM pages UNION SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/]+/[^/]+)/', 1) FROM pages WHERE page_id % 3 = 0 UNION SELECT url FROM pages WHERE page_id % 7 = 0",
    "page_paths": "SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/src/a.c' ELSE 'x/b.c' END AS path FROM pages",
}


@query(
    "SELECT array_to_string(list_transform(p, lambda x: x::VARCHAR), '>') AS cycle FROM w WHERE nxt = p[1]",
    "e AS (SELECT DISTINCT src, dst FROM ring_edges)",
    "w AS (SELECT [src] AS p, dst AS nxt FROM e WHERE src <= dst UNION ALL SELECT list_append(p, nxt), e.dst FROM w JOIN e ON e.src = nxt WHERE NOT list_contains(p, nxt) AND e.dst >= p[1])",
)
def circular_all(spark, d):
    """All elementary cycles, however long."""
    return graph.cycles(view(spark, d, "ring_edges")).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("cycle"))


_SIMPLE = "w AS (SELECT [src, dst] AS p FROM e WHERE src = {0} UNION ALL SELECT list_append(p, e.dst) FROM w JOIN e ON e.src = p[-1] WHERE len(p) <= 15 AND NOT list_contains(p, e.dst) AND p[-1] <> {1})"


@query("SELECT array_to_string(list_transform(p, lambda x: x::VARCHAR), '>') AS path FROM (SELECT p FROM w WHERE p[-1] = 30 ORDER BY len(p), p LIMIT 20)", "e AS (SELECT DISTINCT src, dst FROM ring_edges WHERE src <> dst)", _SIMPLE.format(1, 30))
def all_paths_long(spark, d):
    """The twenty shortest simple paths of up to 15 edges."""
    return graph.all_paths(view(spark, d, "ring_edges"), 1, 30).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("SELECT page_id, path, (SELECT arg_max(root, len(root)) FROM page_roots r WHERE rtrim(p.path, '/') = rtrim(r.root, '/') OR starts_with(p.path, rtrim(r.root, '/') || '/')) AS root FROM page_paths p")
def owning_root(spark, d):
    """The longest root that holds each path."""
    return resolve.owning_roots(view(spark, d, "page_paths"), view(spark, d, "page_roots")).select("page_id", "path", "root")


@query(
    """SELECT r_name AS struct, n_name AS field, '- name: ' || r_name || '.' || n_name || chr(10) || '  type: ' || CASE WHEN n_nationkey % 3 = 0 THEN 'enum k' || chr(10) || '  enum:' || chr(10) || '    type: k' || chr(10) || '    values:' || chr(10) || '    - A' || n_nationkey || chr(10) || '    - ''7''' ELSE 'int' END || chr(10)
  || CASE WHEN n_nationkey % 2 = 0 THEN '  range:' || chr(10) || '    min: ''0''' || chr(10) || CASE WHEN n_nationkey % 4 = 0 THEN '    max: ''' || n_nationkey || '''' || chr(10) ELSE '' END ELSE '' END
  || CASE WHEN n_nationkey % 5 < 2 THEN '  sinks:' || chr(10) || '  - regs->a' || n_nationkey || ' = v' || chr(10) ELSE '' END || '  description: ''no: ' || n_nationkey || '''' || chr(10) AS text FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def config_language(spark, d):
    """Each field's entry of the configuration language."""
    nation, region = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    k, n = F.col("n_nationkey"), F.col("n_nationkey").cast("string")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    typed = rows.select(F.col("r_name").alias("struct"), F.col("n_name").alias("field"), F.when(k % 3 == 0, "enum k").otherwise("int").alias("type"), F.when(k % 3 == 0, "k").alias("enum"), F.array(F.concat(F.lit("A"), n), F.lit("7")).alias("enum_values"), F.when(k % 2 == 0, "0").alias("low"), F.when(k % 4 == 0, n).alias("high"), F.when(k % 5 < 2, F.array(F.concat(F.lit("regs->a"), n, F.lit(" = v")))).alias("sinks"), F.concat(F.lit("no: "), n).alias("description"))
    return exports.config_language(typed)


@query("SELECT array_to_string(list_transform(p, lambda x: x::VARCHAR), '>') AS path FROM (SELECT [id] AS p FROM d WHERE id NOT IN (SELECT src FROM e) UNION SELECT p FROM w WHERE len(p) = 3 OR p[-1] NOT IN (SELECT src FROM e)) ORDER BY p LIMIT 30", f"e AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM (SELECT DISTINCT src, dst FROM ({_EDGES}))) WHERE k <= 5)", "d AS (SELECT DISTINCT symbol_id AS id FROM usages WHERE config_key = 'purchase' AND symbol_id IS NOT NULL)", "w AS (SELECT [src, dst] AS p FROM e WHERE src IN (SELECT id FROM d) UNION ALL SELECT list_append(p, e.dst) FROM w JOIN e ON e.src = p[-1] WHERE len(p) <= 2)")
def trace_config_chains(spark, d):
    """The call chains from the functions that use a key."""
    _, found = graph.trace_config(view(spark, d, "usages"), lookups.call_edges(view(spark, d, "calls"), view(spark, d, "files")), "purchase", depth=2)
    return found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))

"""The engine's operators as queries over the driver's tables, each over whole tables, with DuckDB SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import kconfig_symbol
from ..operators import catalog, configdeps, graph, intervals, patterns, resolve

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- graphs: parts to suppliers (wide), owners (orders, customers, nations, regions: a forest), trade between nations (dense)


def parts(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


def owners(spark, d):
    edge = lambda t, a, p, b, q: read(spark, d, t).select(F.concat(F.lit(p), F.col(a).cast("string")).alias("src"), F.concat(F.lit(q), F.col(b).cast("string")).alias("dst"))
    return edge("orders", "o_orderkey", "o", "o_custkey", "c").unionByName(edge("customer", "c_custkey", "c", "c_nationkey", "n")).unionByName(edge("supplier", "s_suppkey", "s", "s_nationkey", "n")).unionByName(edge("nation", "n_nationkey", "n", "n_regionkey", "r"))


def trade(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("src"))
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return li.join(o, "o_orderkey").join(c, "k").join(s, "l_suppkey").select("src", "dst").distinct()


_PARTS = "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem"
_OWNERS = "SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"
_TRADE = "SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"


@query(f"SELECT dst AS id, count(*) AS n FROM ({_PARTS}) GROUP BY dst ORDER BY n DESC, id LIMIT 15")
def top_callees(spark, d):
    return graph.top_degrees(parts(spark, d), "dst")


@query(f"SELECT src AS id, count(*) AS n FROM ({_PARTS}) GROUP BY src ORDER BY n DESC, id LIMIT 15")
def top_callers(spark, d):
    return graph.top_degrees(parts(spark, d), "src")


@query(f"WITH e AS ({_OWNERS}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), i AS (SELECT dst AS id, count(*) AS n FROM e GROUP BY dst) SELECT v.id, coalesce(n, 0) AS n FROM v LEFT JOIN i USING (id)")
def included_degrees(spark, d):
    e = owners(spark, d)
    return graph.degrees(e, "dst", graph.node_ids(e))


@query(f"WITH e AS ({_OWNERS}) SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS node_count, (SELECT count(*) FROM e) AS edge_count")
def graph_counts(spark, d):
    return graph.counts(owners(spark, d))


@query(f"WITH e AS ({_OWNERS}), a AS (SELECT r.r AS start, e.src AS id FROM (SELECT 'r' || r_regionkey AS r FROM region) r JOIN e ON e.dst = r.r), b AS (SELECT a.start, e.src AS id FROM a JOIN e ON e.dst = a.id) SELECT start, id, 1 AS hops FROM a UNION SELECT start, id, 2 FROM b")
def callers_of(spark, d):
    starts = read(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    return graph.reach(graph.reversed_(owners(spark, d)), starts, 2)


@query(f"WITH RECURSIVE e AS ({_OWNERS}), r AS (SELECT src AS start, dst AS id, 1 AS hops FROM e WHERE src LIKE 'o%' UNION SELECT r.start, e.dst, hops + 1 FROM r JOIN e ON e.src = r.id) SELECT start, id, hops FROM r")
def callees_of(spark, d):
    e = owners(spark, d)
    return graph.reach(e, e.where("src LIKE 'o%'").select(F.col("src").alias("id")))


@query(f"WITH e AS ({_TRADE}), r AS (SELECT s.src AS start, e.dst AS id FROM (SELECT DISTINCT src FROM e) s JOIN e ON e.src = s.src), t AS (SELECT r.start, e.dst AS id FROM r JOIN e ON e.src = r.id) SELECT start, id, min(hops) AS hops FROM (SELECT start, id, 1 AS hops FROM r UNION ALL SELECT start, id, 2 FROM t) GROUP BY start, id")
def includes_of(spark, d):
    e = trade(spark, d)
    return graph.reach(e, e.select(F.col("src").alias("id")), 2)


@query(f"WITH RECURSIVE e AS ({_TRADE}), r AS (SELECT dst AS id FROM e WHERE src = 0 UNION SELECT e.dst FROM r JOIN e ON e.src = r.id) SELECT count(*) FILTER (id = 24) > 0 AS reachable FROM r")
def can_reach(spark, d):
    return spark.createDataFrame([(graph.can_reach(trade(spark, d), 0, 24),)], "reachable boolean")


@query(f"WITH RECURSIVE e AS ({_TRADE}), p AS (SELECT dst AS id, [src, dst] AS path FROM e WHERE src = 0 AND dst <> 0 UNION ALL SELECT e.dst, list_append(path, e.dst) FROM p JOIN e ON e.src = p.id WHERE len(path) < 3 AND NOT list_contains(path, e.dst)) SELECT id, array_to_string(list_transform(min(path), lambda x: x::VARCHAR), '>') AS path FROM p WHERE (id, len(path)) IN (SELECT id, min(len(path)) FROM p GROUP BY id) GROUP BY id")
def shortest_path(spark, d):
    found = graph.shortest_paths(trade(spark, d), 0)
    return found.select("id", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"WITH RECURSIVE e AS ({_TRADE}), p AS (SELECT [src, dst] AS path FROM e WHERE src = 0 AND dst <> 0 UNION ALL SELECT list_append(path, e.dst) FROM p JOIN e ON e.src = path[-1] WHERE len(path) <= 3 AND path[-1] <> 1 AND NOT list_contains(path, e.dst)) SELECT array_to_string(list_transform(path, lambda x: x::VARCHAR), '>') AS path FROM p WHERE path[-1] = 1")
def all_paths(spark, d):
    return graph.all_paths(trade(spark, d), 0, 1, cutoff=3, most=None).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"WITH RECURSIVE e AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM ({_TRADE})) WHERE k <= 8), t AS (SELECT 0 AS node, NULL::INT AS parent, 0 AS depth, [0] AS path, false AS rep UNION ALL SELECT e.dst, e.src, depth + 1, list_append(path, e.dst), list_contains(path, e.dst) FROM t JOIN e ON e.src = t.node WHERE depth < 3 AND NOT rep) SELECT node, parent, depth, array_to_string(list_transform(path, lambda x: x::VARCHAR), '>') AS path, rep AS repeats FROM t")
def call_tree(spark, d):
    found = graph.tree(trade(spark, d), 0, depth=3, breadth=8)
    return found.select("node", "parent", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "repeats")


@query(f"WITH RECURSIVE e AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM ({_OWNERS})) WHERE k <= 5), t AS (SELECT [src] AS path FROM (SELECT DISTINCT src FROM e WHERE src LIKE 's%') UNION ALL SELECT list_append(path, e.dst) FROM t JOIN e ON e.src = path[-1] WHERE len(path) <= 6) SELECT array_to_string(path, '>') AS chain FROM t WHERE path[-1] NOT IN (SELECT src FROM e) OR len(path) = 7")
def expand_chains(spark, d):
    e = owners(spark, d)
    return graph.chains(e, e.where("src LIKE 's%'").select(F.col("src").alias("id")).distinct(), most=None).select(F.array_join("path", ">").alias("chain"))


@query(f"WITH e AS ({_TRADE}), c AS (SELECT [src] AS p FROM e WHERE src = dst UNION ALL SELECT [a.src, a.dst] FROM e a JOIN e b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst UNION ALL SELECT [a.src, a.dst, b.dst] FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst) SELECT array_to_string(list_transform(p, lambda x: x::VARCHAR), '>') AS cycle FROM c")
def circular_dependencies(spark, d):
    return graph.cycles(trade(spark, d), 3).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("cycle"))


@query(f"WITH e AS ({_OWNERS}), n AS (SELECT 'c' || c_custkey AS id, c_name AS name FROM customer) SELECT e.src, e.dst AS id, coalesce(n.name, '<id:' || e.dst || '>') AS label FROM e LEFT JOIN n ON n.id = e.dst")
def node_decoration(spark, d):
    names = read(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    return graph.decorated(graph.simple(owners(spark, d)).withColumnRenamed("dst", "id"), names).select("src", "id", "label")


# --- catalog


@query("SELECT o_orderkey AS call_id, c_custkey AS caller_id, c_name AS caller FROM orders JOIN customer ON o_custkey = c_custkey")
def get_callers(spark, d):
    calls = read(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_custkey").alias("caller_id"))
    symbols = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return catalog.neighbours(calls, symbols, "callee_id", "caller_id", "inner").select("call_id", "caller_id", F.col("other_name").alias("caller"))


def _symbols(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws("::", "p_brand", "p_name").alias("qualified_name"), F.col("p_type").alias("kind"))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE (p_name ILIKE '%ED W%' OR p_brand || '::' || p_name ILIKE '%ED W%') AND p_type = 'SMALL' ORDER BY p_name, p_partkey LIMIT 50")
def search_symbols(spark, d):
    return catalog.search(_symbols(spark, d), "ED W", "small").select("id", "name")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name = 'red widget' ORDER BY p_name, p_partkey LIMIT 5")
def find_by_name(spark, d):
    return catalog.find_by_name(_symbols(spark, d), "red widget").select("id", "name")


@query("SELECT page_id, url FROM pages WHERE url ILIKE '%/en/%' ORDER BY url, page_id")
def list_files(spark, d):
    return read(spark, d, "pages").where(F.col("url").ilike("%/en/%")).select("page_id", "url").orderBy("url", "page_id")


@query("SELECT 'files' AS name, (SELECT count(*) FROM documents) AS n UNION ALL SELECT 'symbols', (SELECT count(*) FROM part) UNION ALL SELECT 'functions', (SELECT count(*) FROM part WHERE p_type IN ('SMALL', 'MEDIUM')) UNION ALL SELECT 'calls', (SELECT count(*) FROM lineitem) UNION ALL SELECT 'config_keys', (SELECT count(DISTINCT event_type) FROM events) UNION ALL SELECT 'sources', (SELECT count(*) FROM events)")
def stats(spark, d):
    t = lambda n: read(spark, d, n)
    return catalog.stats({"files": t("documents"), "symbols": t("part"), "functions": t("part").where(F.col("p_type").isin("SMALL", "MEDIUM")), "calls": t("lineitem"), "config_keys": t("events").select("event_type").distinct(), "sources": t("events")})


@query("SELECT p_brand, p_type, p_partkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey) AS k FROM part) WHERE k = 1")
def insert_symbol(spark, d):
    """Of rows with one key the preferred one stays (a definition before declarations)."""
    return catalog.first_by(read(spark, d, "part"), ["p_brand", "p_type"], [F.desc("p_size"), F.col("p_partkey")]).select("p_brand", "p_type", F.col("p_partkey").alias("id"))


@query("SELECT c_custkey AS id, c_nationkey AS v FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
def upsert_file(spark, d):
    old = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("v"))
    return catalog.upsert(old, read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("v")), ["id"])


@query("SELECT event_type AS config_key, count(*) AS n, arg_min(user_id, event_id) AS first_user FROM events GROUP BY event_type")
def list_config_keys(spark, d):
    return catalog.list_keys(read(spark, d, "events").select(F.col("event_type").alias("config_key"), F.col("user_id").alias("first_user"), "event_id"), "config_key", "first_user", "event_id")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS file_hash FROM documents")
def file_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("file_hash"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_skip(spark, d):
    """Documents that the state (the labelled ones, with their hash) doesn't hold."""
    docs = file_hash(spark, d)
    return catalog.changed(docs, docs.join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi"), ["doc_id", "file_hash"]).select("doc_id")


# --- scan, intervals, resolution

_PATTERNS = [{"name": "link", "regex": r'href="([^"]+)"'}, {"name": "class", "regex": r'class="([^"]+)"'}, {"name": "any", "regex": r'[a-z]+="([^"]+)"'}]


def _hits(spark, d):
    return patterns.scan(patterns.lines(read(spark, d, "pages"), "page_id", "html"), _PATTERNS, "page_id")


_LINES = r"SELECT page_id, unnest(string_split(html, chr(10))) AS content, generate_subscripts(string_split(html, chr(10)), 1) AS line FROM pages"
_HITS = f"""SELECT page_id, line, content, 'link' AS pattern, 0 AS ord, unnest(regexp_extract_all(content, 'href="([^"]+)"', 1)) AS config_key FROM ({_LINES})
UNION ALL SELECT page_id, line, content, 'class', 1, unnest(regexp_extract_all(content, 'class="([^"]+)"', 1)) FROM ({_LINES})
UNION ALL SELECT page_id, line, content, 'any', 2, unnest(regexp_extract_all(content, '[a-z]+="([^"]+)"', 1)) FROM ({_LINES})"""


def _marked(name: str, ord_: int, regex: str) -> str:
    marked = f"string_split(regexp_replace(content, '{regex}', chr(1) || '\\0' || chr(2), 'g'), chr(1))"
    return f"SELECT page_id, line, '{name}' AS pattern, {ord_} AS ord, unnest(regexp_extract_all(content, '{regex}', 1)) AS config_key, unnest(list_transform(range(1, len({marked})), lambda k: (1 + len(replace(array_to_string({marked}[1:k], ''), chr(2), '')))::INTEGER)) AS col FROM ({_LINES})"


_MARKED = " UNION ALL ".join(_marked(p["name"], i, p["regex"]) for i, p in enumerate(_PATTERNS))


@query(f"SELECT page_id, line, col, config_key, pattern FROM ({_MARKED})")
def config_positions(spark, d):
    """Every match with its line and column."""
    return _hits(spark, d).select("page_id", "line", "col", "config_key", "pattern")


@query(f"SELECT page_id, line, col, config_key, arg_min(pattern, ord) AS pattern FROM ({_MARKED}) GROUP BY ALL")
def config_sources_at(spark, d):
    return patterns.sources_at(_hits(spark, d), "page_id")


@query(f"SELECT page_id, pattern, config_key, count(*) AS n FROM ({_HITS}) GROUP BY ALL")
def config_scan(spark, d):
    return _hits(spark, d).groupBy("page_id", "pattern", "config_key").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, line, config_key, arg_min(pattern, ord) AS pattern FROM ({_HITS}) GROUP BY page_id, line, config_key")
def config_sources(spark, d):
    return patterns.sources(_hits(spark, d), "page_id")


@query(r"SELECT page_id, line, CASE WHEN regexp_matches(content, '\b(if|while|for|switch|else|elif)\b|\?') THEN 'CONDITION' WHEN regexp_matches(content, '\breturn\b') THEN 'RETURN' WHEN regexp_matches(content, '[^=!<>]=([^=]|$)') THEN 'ASSIGNMENT' WHEN regexp_matches(content, '[0-9A-Za-z_]+\s*\(') THEN 'CALL_ARG' ELSE 'OTHER' END AS usage FROM (" + _LINES + ")")
def classify_usage(spark, d):
    return patterns.lines(read(spark, d, "pages"), "page_id", "html").select("page_id", "line", patterns.usage(F.col("content")).alias("usage"))


_MINUTE = "epoch_us(ts) // 60000000"


@query(f"WITH s AS (SELECT user_id, event_id AS span_id, {_MINUTE} AS a, {_MINUTE} + floor(value)::BIGINT AS b FROM events), p AS (SELECT user_id, event_id, {_MINUTE} AS x FROM events) SELECT p.event_id, (SELECT s.span_id FROM s WHERE s.user_id = p.user_id AND s.a <= p.x AND s.b >= p.x ORDER BY s.b - s.a, s.span_id LIMIT 1) AS span_id FROM p")
def enclosing_function(spark, d):
    """Innermost of a user's spans (from each event on, value minutes long) around each event."""
    minute = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60)
    ev = read(spark, d, "events").select("user_id", "event_id", minute.alias("at"), "value")
    spans = ev.select("user_id", F.col("event_id").alias("span_id"), F.col("at").alias("begin"), (F.col("at") + F.floor("value")).alias("end"))
    return intervals.innermost(ev.select("user_id", "event_id", "at"), spans, "user_id").select("event_id", "span_id")


@query("WITH e AS (SELECT * FROM events) SELECT u.event_id AS use_id, (SELECT max(d.event_id) FROM e d WHERE d.user_id = u.user_id AND d.event_type = 'click' AND d.event_id <= u.event_id) AS def_id FROM e u WHERE u.event_type <> 'click'")
def reaching_defs(spark, d):
    """A user's clicks as definitions, other events as uses, event ids as lines: the newest definition that reaches each use."""
    ev = read(spark, d, "events").select("user_id", F.col("event_id").alias("line"), F.col("event_id"), "event_type")
    return intervals.last_definition(ev.where("event_type = 'click'").withColumnRenamed("event_id", "def_id"), ev.where("event_type <> 'click'").withColumnRenamed("event_id", "use_id"), ["user_id"])


@query(r"""WITH f AS (SELECT page_id AS file_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), a AS (SELECT path AS want FROM f UNION SELECT regexp_replace(path, '^[^/]*/', '') FROM f UNION SELECT regexp_extract(path, '[^/]*$') FROM f),
b AS (SELECT want, (SELECT min(file_id) FROM f WHERE path = want) AS f1, (SELECT min(file_id) FROM f WHERE want <> '' AND ends_with(path, '/' || want)) AS f2, (SELECT CASE WHEN count(*) = 1 THEN min(file_id) END FROM f WHERE regexp_extract(path, '[^/]*$') = regexp_extract(want, '[^/]*$')) AS f3 FROM a)
SELECT want, coalesce(f1, f2, f3) AS file_id, CASE WHEN f1 IS NOT NULL THEN 1 WHEN f2 IS NOT NULL THEN 2 WHEN f3 IS NOT NULL THEN 3 END AS tier FROM b""")
def resolve_includes(spark, d):
    files = read(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    wanted = files.select(F.col("path").alias("want")).union(files.select(F.regexp_replace("path", "^[^/]*/", ""))).union(files.select(F.regexp_extract("path", "[^/]*$", 0))).distinct()
    return resolve.resolve(wanted, files)


# --- configuration fields


@query("SELECT a.f AS field, string_agg(DISTINCT b.f, ',' ORDER BY b.f) AS others FROM (SELECT DISTINCT l_suppkey AS s, p_brand AS f FROM lineitem JOIN part ON l_partkey = p_partkey) a JOIN (SELECT DISTINCT l_suppkey AS s, p_brand AS f FROM lineitem JOIN part ON l_partkey = p_partkey) b USING (s) WHERE a.f <> b.f GROUP BY a.f")
def co_dependencies(spark, d):
    uses = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("sink"), F.col("p_brand").alias("field")).distinct()
    return configdeps.co_dependencies(uses).select("field", F.array_join("others", ",").alias("others"))


@query("WITH e AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) SELECT event_type AS gating, string_agg(DISTINCT nxt, ',' ORDER BY nxt) AS gated FROM e WHERE nxt IS NOT NULL AND nxt <> event_type GROUP BY event_type")
def gating(spark, d):
    from pyspark.sql import Window

    e = read(spark, d, "events").withColumn("nxt", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id")))
    pairs = e.where("nxt IS NOT NULL AND nxt <> event_type").select(F.col("event_type").alias("gating"), F.col("nxt").alias("gated"))
    return configdeps.gating_map(pairs, "gating", "gated").select("gating", F.array_join("gated", ",").alias("gated"))


@query("SELECT p_partkey AS field, p_name AS name, arg_max(l_quantity, (l_orderkey, l_linenumber)) FILTER (l_returnflag = 'A') AS low, arg_max(l_quantity, (l_orderkey, l_linenumber)) FILTER (l_returnflag = 'R') AS high FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_name")
def range_lookup(spark, d):
    """The last lower (flag A) and upper (flag R) bound of each field."""
    li = read(spark, d, "lineitem").select(F.col("l_partkey").alias("field"), F.when(F.col("l_returnflag") == "A", "min").when(F.col("l_returnflag") == "R", "max").alias("side"), F.col("l_quantity").alias("bound"), F.struct("l_orderkey", "l_linenumber").alias("ord"))
    fields = read(spark, d, "part").select(F.col("p_partkey").alias("field"), F.col("p_name").alias("name"))
    return configdeps.with_ranges(fields, li, "field")


@query("SELECT c_nationkey AS enum_id, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS enum_values FROM customer GROUP BY c_nationkey")
def enum_lookup(spark, d):
    return read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("enum_id")).agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "|").alias("enum_values"))


@query("SELECT l_partkey AS flag, l_suppkey AS config FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 3)")
def cli_groups(spark, d):
    pairs = parts(spark, d).select(F.col("src").alias("flag"), F.col("dst").alias("config"))
    return configdeps.at_least(pairs, "flag", 3)


@query("SELECT a.o_custkey AS target, a.o_orderdate AS line, min(a.o_orderkey) AS k FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderdate = a.o_orderdate AND b.o_orderstatus = 'F') GROUP BY a.o_custkey, a.o_orderdate")
def self_override(spark, d):
    """Rows without a known dependency on the same target and line, one each."""
    o = read(spark, d, "orders")
    return configdeps.without_known(o, o.where("o_orderstatus = 'F'"), ["o_custkey", "o_orderdate"]).groupBy(F.col("o_custkey").alias("target"), F.col("o_orderdate").alias("line")).agg(F.min("o_orderkey").alias("k"))


@query("SELECT p_name AS name, arg_min(p_partkey, p_partkey) AS config, count(*) AS n FROM part GROUP BY p_name")
def find_config_by_field(spark, d):
    p = read(spark, d, "part")
    first = catalog.first_by(p, ["p_name"], [F.col("p_partkey")]).select(F.col("p_name").alias("name"), F.col("p_partkey").alias("config"))
    return p.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")).join(first, "name").select("name", "config", "n")



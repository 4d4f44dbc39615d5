"""Exports, caches, scans and the stream."""

from pyspark.sql import functions as F
from quernstone.functions import text
from quernstone.operators import cache, catalog, exports, graph, intervals, patterns
from quernstone.streaming import watch


def test_kconfig_text(spark):
    specs = spark.createDataFrame([("s", "a-b", "int", ["X"], "0", "9"), ("s", "c", "bool", [], None, None)], "struct string, field string, type string, enum_values array<string>, low string, high string")
    made = exports.kconfig(specs, spark.createDataFrame([("c", "s->x <= 5")], "field string, condition string"), spark.createDataFrame([("a-b", "3")], "field string, value string")).first()["text"]
    assert made == 'menu "s"\nconfig S_A_B\n    int\n    default 3\n    range 0 9\n    # values: X\n\nconfig S_C\n    bool\n    depends on s_x <= 5\nendmenu'


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([("b", ["x", "y"]), ("a", [])], "k string, v array<string>")
    exports.to_csv(df, f"file://{tmp_path}/csv", ["k"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"file://{tmp_path}/csv").collect()] == [("a", None), ("b", "x|y")]
    exports.to_json(df, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == 2


def test_cache_is_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    key = cache.trace_key(5, ["b", "a"], ["c"])
    assert key == cache.trace_key(5, ["a", "b"], ["c"]) != cache.trace_key(5, ["a", "b"], ["c"], False)
    for fp in ("x", "x", "y"):
        assert cache.cached(spark, f"file://{tmp_path}/c", key, fp, make).count() == 3
    assert len(made) == 2


def test_usage_and_bad_patterns(spark):
    rows = spark.createDataFrame([(1, 'if (getenv("A"))'), (2, 'x = getenv("B");'), (3, "// getenv(\"C\")"), (4, 'return getenv("D");'), (5, 'f(getenv("E"))')], "id int, content string").withColumn("line", F.lit(1))
    hits = patterns.scan(rows, [{"name": "env", "regex": r'getenv\("(\w+)"\)'}, {"name": "bad", "regex": "("}, {"name": "far", "regex": "getenv", "key_group": 7}], "id")
    got = {(r.id, r.config_key, r.u) for r in hits.where("pattern = 'env'").withColumn("u", patterns.usage(F.col("content"))).collect()}
    assert got == {(1, "A", "CONDITION"), (2, "B", "ASSIGNMENT"), (4, "D", "RETURN"), (5, "E", "CALL_ARG")}
    assert {r.config_key for r in hits.where("pattern = 'far'").collect()} == {"getenv"}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.c").write_text('int x;\ny = getenv("KEY");\n')
    out = watch.scanned(watch.watched(spark, f"file://{tmp_path}/in"), [{"name": "env", "regex": r'getenv\("(\w+)"\)'}])
    q = out.writeStream.format("memory").queryName("hits").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.line, r.config_key, r.usage) for r in spark.sql("SELECT * FROM hits").collect()] == [(2, "KEY", "ASSIGNMENT")]


def test_cycle_rules(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 3), (3, 4)], "src int, dst int")
    start = spark.createDataFrame([(1,)], "id int")
    assert {(r.id, r.hops) for r in graph.reach(e, start, 3).collect()} == {(2, 1), (3, 2), (1, 3), (4, 3)}
    assert {r.id for r in graph.reach(e, start).collect()} == {2, 3, 4}
    assert {tuple(r.path) for r in graph.cycles(e, 4).collect()} == {(1, 2, 3), (3,)}
    assert graph.reach(e, spark.createDataFrame([(9,)], "id int")).count() == 0


def test_intervals_and_first(spark):
    spans = spark.createDataFrame([("f", "outer", 1, 500), ("f", "inner", 90, 110), ("f", "same", 90, 110)], "k string, span_id string, begin int, end int")
    points = spark.createDataFrame([("f", 100), ("f", 400), ("f", 600), ("g", 1)], "k string, at int")
    assert {(r.k, r.at, r.span_id) for r in intervals.innermost(points, spans, "k").collect()} == {("f", 100, "inner"), ("f", 400, "outer"), ("f", 600, None), ("g", 1, None)}
    defs, uses = spark.createDataFrame([("f", 3, 30), ("f", 7, 70)], "k string, line int, def_id long"), spark.createDataFrame([("f", 7, 1), ("f", 5, 2), ("f", 1, 3)], "k string, line int, use_id long")
    assert {(r.use_id, r.def_id) for r in intervals.last_definition(defs, uses, ["k"]).collect()} == {(1, 70), (2, 30), (3, None)}
    assert {(r.use_id, r.def_id) for r in intervals.reaching(defs, uses, ["k"]).where("nearest = 1").collect()} == {(1, 70), (2, 30)}
    one = catalog.first_by(spans, ["k"], [F.desc("begin"), F.col("span_id")])
    assert one.first()["span_id"] == "inner"
    assert spark.range(1).select(text.kconfig_symbol(F.lit("a->b")).alias("x")).first()["x"] == "A__B"

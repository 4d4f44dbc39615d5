"""Pattern files, positions, the configuration language, projects and menus."""

import pytest
from pyspark.sql import functions as F
from quernstone.operators import exports, graph, lookups, patterns, pointsto, resolve
from quernstone.plans import model
from quernstone.sources import patternfiles


def test_pattern_files(tmp_path):
    built = patternfiles.config_patterns()
    assert len(built) == len({p["name"] for p in built}) == 22
    (tmp_path / "p.yaml").write_text("patterns:\n  - name: env\n    type: ENV\n    regex: 'getenv\\(\"([^\"]+)\"'\n  - {name: two, regex: 'a(b)(c)', key_group: 2}\n")
    got = patternfiles.config_patterns(str(tmp_path / "p.yaml"))
    assert [(p["name"], p["kind"], p["key_group"]) for p in got] == [("env", "ENV", 1), ("two", "OTHER", 2)]
    (tmp_path / "t.yaml").write_text("sources:\n  - regex: 'cfg->(\\w+)'\nsinks:\n  - {regex: 'writel\\(', value_arg: 0}\n  - {regex: 'put\\('}\n")
    assert patternfiles.taint_patterns(str(tmp_path / "t.yaml")) == (["cfg->(\\w+)"], [{"regex": "writel\\(", "value_arg": 0}, {"regex": "put\\("}])
    (tmp_path / "e.yaml").write_text("other: 1\n")
    with pytest.raises(ValueError, match="neither"):
        patternfiles.taint_patterns(str(tmp_path / "e.yaml"))
    (tmp_path / "b.yaml").write_text("patterns:\n  - {name: x}\n")
    with pytest.raises(ValueError, match="no regex"):
        patternfiles.config_patterns(str(tmp_path / "b.yaml"))


def test_positions_and_literals(spark):
    text = 'x = getenv("HOME"); y = getenv( "é" );\n// getenv("no")\n#define USE_FAN 1\ncfg->rate = 4; p->rate = cfg["a"];\nint z = FLAGS_depth + FLAGS_depth;\x01FLAGS_x'
    found = patterns.scan(patterns.lines(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text"), patternfiles.config_patterns(), "id")
    got = {(r.line, r.col, r.pattern, r.config_key) for r in found.collect()}
    assert got == {(1, 5, "getenv", "HOME"), (1, 25, "getenv", "é"), (3, 1, "define_macro", "USE_FAN"), (4, 1, "struct_ptr_assign", "rate"), (4, 16, "struct_ptr_assign", "rate"), (4, 26, "map_bracket", "a"), (5, 9, "gflags_usage", "depth"), (5, 23, "gflags_usage", "depth"), (5, 36, "gflags_usage", "x")}
    assert patterns.literal(r"DEFINE_bool\s*\(") == "DEFINE_bool" and patterns.literal("a|b") == "" and patterns.literal(r"(\w+)->(\w+)") == ""
    assert patterns.literal(r"getenvs?\(") == "getenv" or patterns.literal(r"getenvs?\(") == ""


def test_language_is_yaml(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    rows = [("s", "f", "int", "k", ["A", "yes", "it's"], "-1", None, ["regs->a = v"], None, "a: b # c"), ("", "g", "char *", None, [], None, None, [], ["x"], "")]
    specs = spark.createDataFrame(rows, "struct string, field string, type string, enum string, enum_values array<string>, low string, high string, sinks array<string>, gates array<string>, description string")
    exports.whole_language(exports.config_language(specs), f"file://{tmp_path}/out")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert yaml.safe_load(text) == {"config_fields": [
        {"name": "g", "type": "char *", "gates": ["x"]},
        {"name": "s.f", "type": "int", "enum": {"type": "k", "values": ["A", "yes", "it's"]}, "range": {"min": "-1"}, "sinks": ["regs->a = v"], "description": "a: b # c"},
    ]}


def test_projects_are_resolved_or_refused(spark):
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "project_id long")
    assert lookups.resolve_project(frame(4, 5), 5) == 5 and lookups.resolve_project(frame(4)) == 4
    with pytest.raises(ValueError, match="no project"):
        lookups.resolve_project(frame())
    with pytest.raises(ValueError, match="several"):
        lookups.resolve_project(frame(4, 5))


def test_menus_have_conditions(spark):
    specs = spark.createDataFrame([("s", "f", "int", [], "1", "9")], "struct string, field string, type string, enum_values array<string>, low string, high string")
    depends = spark.createDataFrame([("f", "cfg->use"), ("f", "cfg->mode == 2")], "field string, condition string")
    text = exports.kconfig(specs, depends).first().text
    assert "    range 1 9" in text and "    depends on " in text and " && " in text


def test_components_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (6, 7), (7, 7), (8, 1), (5, 4)], "src long, dst long")
    assert {tuple(r) for r in graph.strong_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4)}
    assert {tuple(r.path) for r in graph.cycles(edges).collect()} == {(1, 2, 3), (4, 5, 6), (4, 5), (7,)}
    assert graph.cycles(edges.where("src = 8")).count() == graph.strong_components(edges.limit(0)).count() == 0


def test_paths_stop_at_the_limit(spark):
    layers = [(i, j) for i in range(0, 12, 3) for j in range(i + 3, i + 6)] + [(i + a, i + 3 + b) for i in range(0, 12, 3) for a in range(3) for b in range(3)]
    edges = spark.createDataFrame(layers + [(0, 12)], "src long, dst long")
    assert [list(r.path) for r in graph.all_paths(edges, 0, 12, most=3).collect()] == [[0, 12], [0, 3, 6, 9, 12], [0, 3, 6, 10, 12]]


def test_alias_chains_and_cycles(spark):
    rows = [(1, f"a{i}", f"a{i + 1}") for i in range(40)] + [(2, "x", "y"), (2, "y", "z"), (2, "z", "x"), (2, "in", "mid"), (2, "mid", "z"), (3, "p", "q")]
    got = {(r.fn, r.name): r.origin for r in pointsto.closed_aliases(spark.createDataFrame(rows, "fn long, name string, origin string")).collect()}
    assert all(got[1, f"a{i}"] == "a40" for i in range(40)) and got[3, "p"] == "q"
    assert {got[2, n] for n in ("y", "z", "in", "mid")} == {"x"} and (2, "x") not in got
    assert pointsto.closed_aliases(spark.createDataFrame([], "fn long, name string, origin string")).count() == 0


def test_roots(spark):
    files = spark.createDataFrame([("/a/b/c.c",), ("/a/bc/d.c",), ("/x/y.c",), ("/a/b",)], "path string")
    roots = spark.createDataFrame([("/a/",), ("/a/b",), ("/a/b",)], "root string")
    assert {tuple(r) for r in resolve.owning_roots(files, roots).collect()} == {("/a/b/c.c", "/a/b"), ("/a/bc/d.c", "/a/"), ("/x/y.c", None), ("/a/b", "/a/b")}


def test_line_breaks_and_report(spark):
    text = "a\r\nb\x0bc\x0cd\x1ce\x85f\u2028g\rh\n\ni\n"
    got = patterns.lines(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").orderBy("line").collect()
    assert [r.content for r in got] == text.splitlines() and [r.line for r in got] == list(range(1, 11))
    named = lambda *rows: spark.createDataFrame(list(rows), "name string, n long")
    text = exports.report(named(("files", 3)), named(("HOME", 2), ("A", 2)), spark.createDataFrame([("f", 9)], "id string, n long"))
    assert text.index("- files: 3") < text.index("- A: 2") < text.index("- HOME: 2") < text.index("- f: 9")


def test_views_of_the_trace_are_whole_tables():
    assert not any("LIMIT" in v for v in model.VIEWS.values()) and F is not None

"""Hard inputs of the front end, names that are a function's own, and patterns of the engine's regex dialect."""

import pytest
from quernstone.operators import patterns
from quernstone.plans.code import Code
from quernstone.sources import cfront, files

DEEP = {"braces": ("{" * 2000, "x = 1;", "}" * 2000), "subscripts": ("a" + "[" * 3000, "i", "]" * 3000 + " = 2;"), "brackets": ("y = " + "(" * 3000, "i", ")" * 3000 + ";"), "conditions": ("if (a) {" * 1500, "x = 1;", "}" * 1500)}


@pytest.mark.parametrize("name", sorted(DEEP))
def test_deep_nesting_is_read(name):
    found = cfront.extract("void f(void) {" + "".join(DEEP[name]) + "}")
    assert [s["name"] for s in found["symbols"]] == ["f"]
    assert len(found["assignments"]) == 1


def test_bases_with_scopes_and_access():
    found = cfront.extract("class A : public x::B, private C { void m() {} };")
    assert {(b["class_name"], b["base"], b["access"]) for b in found["bases"]} == {("A", "x::B", "public"), ("A", "C", "private")}


def test_names_carry_their_namespace():
    found = cfront.extract("namespace n { class K { void g() {} }; int h(int a) { return a; } }")
    assert {"n::K::g", "n::h"} <= {s["qualified_name"] for s in found["symbols"]}


def test_clamps_are_ranges():
    found = cfront.extract("void f(struct c *cfg) { cfg->x = MIN(cfg->x, 10); cfg->y = cfg->y > 5 ? 5 : cfg->y; }")
    assert {(r["variable"], r["side"], r["bound"]) for r in found["ranges"]} == {("cfg->x", "max", "10"), ("cfg->y", "max", "5")}


def write(folder, texts):
    for name, text in texts.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    return str(folder)


def test_own_names_are_no_globals(spark, tmp_path):
    own = "void a(struct s *cfg) { int t; t = cfg->z; }\nvoid b(void) { int t; read_it(&t); regs->b = t; }\n"
    shared = "int g;\nvoid c(struct s *cfg) { g = cfg->y; }\nvoid d(void) { regs->c = g; }\n"
    found = Code.index(spark, [write(tmp_path, {"own.c": own + shared})]).trace()
    assert {(r.source, r.function) for r in found.collect()} == {("cfg->y", "d")}


def test_other_files_are_not_opened(spark, tmp_path):
    root = write(tmp_path, {"a.c": "int a;", "B.HPP": "int b;", "notes.txt": "x", "c.cc~": "x", "build/d.c": "int d;", "sub/e.h": "int e;"})
    assert {r.path for r in files.collect(spark, [root]).select("path").collect()} == {"a.c", "B.HPP", "sub/e.h"}


def test_patterns_compile_where_they_run(spark):
    given = [{"name": "python", "regex": r"(?P<key>\w+)="}, {"name": "open", "regex": "(a"}, {"name": "java", "regex": r"(?<key>\w+)=", "key_group": 1}, {"name": "none", "regex": r"\w+="}]
    assert [(p["name"], p["key_group"]) for p in patterns.valid(spark, given)] == [("java", 1), ("none", 0)]
    rows = patterns.lines(spark.createDataFrame([(1, "a=1")], "k int, t string"), "k", "t")
    assert {(r.pattern, r.config_key) for r in patterns.scan(rows, given, "k").collect()} == {("java", "a"), ("none", "a=")}

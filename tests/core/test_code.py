"""The C front end and what is built on it, against expectations derived by hand from the corpus."""

import pytest
from quernstone.operators import graph
from quernstone.plans.code import Code
from quernstone.sources import cfront, files


@pytest.fixture(scope="module")
def code(spark):
    return Code.index(spark, [files.corpus()])


def pairs(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_files_and_entities(code):
    assert pairs(code.files, "path") == {("kiln.c",), ("kiln.h",), ("kiln_hw.h",), ("modes.c",), ("panel.c",)}
    assert pairs(code.fields.where("struct = 'kiln_settings'"), "field", "type", "comment") == {("target_temp", "int", "degrees"), ("ramp_rate", "int", "degrees a minute"), ("mode", "enum heat_mode", ""), ("label", "unsigned char *", ""), ("use_fan", "int", ""), ("fan_level", "int", "")}
    assert pairs(code.enum_values, "value", "number") == {("HEAT_OFF", 0), ("HEAT_SLOW", 4), ("HEAT_FAST", 5)}
    assert pairs(code.ranges, "function", "variable", "side", "bound") == {("clamp_level", "level", "max", "most"), ("modes_apply", "cfg->fan_level", "max", "3")}
    assert pairs(code.macros.where("writes"), "macro") == {("WRITE_REG",), ("POKE",)}
    assert pairs(code.functions.where("is_definition"), "name") == {(n,) for n in ("clamp_level", "scaled", "set_fan", "kiln_defaults", "kiln_apply", "kiln_flush", "on_up", "on_fan", "panel_main", "modes_apply", "modes_parse")}


def test_graphs(code):
    assert pairs(code.call_graph(), "src", "dst") == {("kiln_apply", "scaled"), ("kiln_apply", "clamp_level"), ("kiln_apply", "set_fan"), ("panel_main", "on_up"), ("panel_main", "on_fan"), ("panel_main", "kiln_apply"), ("modes_parse", "modes_apply")}
    assert pairs(code.include_graph(), "src", "dst", "tier") == {("kiln.c", "kiln.h", 1), ("panel.c", "kiln.h", 1), ("modes.c", "kiln.h", 1), ("kiln.h", "kiln_hw.h", 1), ("panel.c", None, None)}
    assert graph.can_reach(code.call_graph(), "panel_main", "set_fan") and not graph.can_reach(code.call_graph(), "set_fan", "panel_main")


def test_innermost_function(code):
    found = pairs(code.enclosing(code.calls.select("file_id", "line", "callee")), "callee", "function")
    assert {("scaled", "kiln_apply"), ("WRITE_REG", "kiln_flush"), ("getenv", "panel_main")} <= found


def test_dataflow(code):
    found = pairs(code.trace(), "source", "sink", "function")
    assert ("cfg->target_temp", "regs->heat = heat", "kiln_apply") in found  # through a return
    assert ("cfg->fan_level", "regs->fan = speed", "set_fan") in found  # through a parameter
    assert ("cfg->ramp_rate", "WRITE_REG(&regs->bank[1], last_ramp)", "kiln_flush") in found  # through a global and an alias
    assert not code.trace(sources=[r"nothing->here"]).count()


def test_sinks_name_their_value_argument(spark, tmp_path):
    (tmp_path / "a.c").write_text("void f(struct s *cfg, int base) {\n  writel(cfg->gain, base);\n}\nvoid g(void) {\n  writel();\n}\n")
    own = Code.index(spark, [str(tmp_path)])
    found = lambda *sinks: pairs(own.trace(sinks=list(sinks)), "source", "function")
    first = {"regex": r"\bwritel\s*\(", "value_arg": 0}
    assert found(first) == found(first | {"value_arg": -2}) == found(first, first["regex"]) == {("cfg->gain", "f")}
    assert found(first["regex"]) == found(first | {"value_arg": 7}) == found(first["regex"], first) == set()


def test_specs_defaults_overrides(code):
    spec = {r.field: r for r in code.specs().where("struct = 'kiln_settings'").collect()}
    assert spec["mode"].enum_values == ["HEAT_OFF", "HEAT_SLOW", "HEAT_FAST"]
    assert spec["fan_level"].sinks == ["regs->fan = speed"] and "via set_fan" in spec["fan_level"].description
    assert pairs(code.defaults(), "field", "value") == {("target_temp", "900"), ("ramp_rate", "5"), ("fan_level", "1"), ("use_fan", "0")}
    assert ("cfg->use_fan", "cfg->fan_level") in pairs(code.overrides(), "gating", "gated")


def test_dependencies(code):
    found = pairs(code.dependencies(), "kind", "source", "target", "value")
    assert {("CASCADE", "mode", "target_temp", "20"), ("CASCADE", "mode", "ramp_rate", "2"), ("CASCADE", "mode", "fan_level", "3")} <= found
    assert {("DIRECT_OVERRIDE", "use_fan", "ramp_rate", "1"), ("DIRECT_OVERRIDE", "mode", "ramp_rate", "1")} <= found
    assert ("SELF_OVERRIDE", "fan_level", "fan_level", "3") in found
    assert ("AGGREGATION", "mode", "fan_level", "3") in found and ("AGGREGATION", "-dry", "use_fan", "") in found
    assert ("MUTUAL_EXCLUSION", "modes_parse", "ramp_rate", "2") in found


def test_front_end_bears_anything():
    for text in ("", "{", "}", "int f(", "#define", "struct {", "a = = b;", 'char *s = "unclosed;\nint x;', "void f() { if (x { } ", "/* open", "\x00\xff", "switch(", "int a[] = {[0] = f, g};"):
        assert set(cfront.extract(text)) == set(cfront.ENTITIES)
    got = cfront.extract("class A : public B { public: virtual int run(int n) { return n; } };")
    assert got["bases"][0] == {"class_name": "A", "base": "B", "access": "public", "is_virtual": False}
    assert any(s["qualified_name"] == "A::run" for s in got["symbols"])


def test_save(code, tmp_path):
    code.save(f"file://{tmp_path}/db")
    assert code.parsed.sparkSession.read.parquet(f"file://{tmp_path}/db/symbols").count() > 5

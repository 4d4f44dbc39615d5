"""The ordered backward trace, rule by rule, on sources written for it; expectations by hand."""

import pytest
from quernstone.plans.code import Code

RULES = {
    # a write after the sink doesn't reach it; the newest definition before it comes first
    "order": ("void f(struct s *cfg, struct r *regs) {\n int t;\n t = cfg->old;\n t = cfg->now;\n regs->a = t;\n t = cfg->late;\n regs->b = 0;\n}", {("cfg->now", "regs->a = t")}),
    "only_later": ("void f(struct s *cfg, struct r *regs) {\n int t;\n regs->a = t;\n t = cfg->late;\n}", set()),
    "reassigned": ("void f(struct s *cfg, struct r *regs) {\n int t, u;\n t = cfg->one;\n u = t;\n t = cfg->two;\n regs->a = u;\n}", {("cfg->one", "regs->a = u")}),
    "alias": ("void f(struct s *cfg, struct r *regs) {\n struct s *p = cfg;\n struct s *q = p;\n regs->a = q->gain;\n}", {("cfg->gain", "regs->a = q->gain")}),
    "union": ("union word { int raw; int low; };\nvoid f(struct s *cfg, struct r *regs) {\n union word w;\n w.low = cfg->half;\n regs->a = w.raw;\n}", {("cfg->half", "regs->a = w.raw")}),
    "copy": ("void f(struct s *cfg, struct r *regs) {\n int block[4];\n memcpy(block, &cfg->table, 16);\n regs->a = block;\n}", {("cfg->table", "regs->a = block")}),
    "part": ("struct pk { int x; int y; };\nvoid f(struct s *cfg, struct r *regs) {\n struct pk v;\n v.x = cfg->part;\n regs->a = v;\n}", {("cfg->part", "regs->a = v")}),
    "return": ("int pick(struct s *cfg) {\n return cfg->best;\n}\nvoid f(struct s *c, struct r *regs) {\n int t = pick(c);\n regs->a = t;\n}", {("cfg->best", "regs->a = t")}),
    "param": ("void put(struct r *regs, int v) {\n regs->a = v;\n}\nvoid f(struct s *cfg, struct r *r) {\n put(r, cfg->level);\n}", {("cfg->level", "regs->a = v")}),
    "param_field": ("void put(struct r *regs, struct t *p) {\n regs->a = p->level;\n}\nvoid f(struct r *r) {\n struct t cfg;\n put(r, &cfg);\n}", {("cfg->level", "regs->a = p->level")}),
    "literal": ("void put(struct r *regs, struct t p) {\n regs->a = p.hi;\n}\nvoid f(struct s *cfg, struct r *r) {\n put(r, (struct t){ .lo = 1, .hi = cfg->high });\n}", {("cfg->high", "regs->a = p.hi")}),
    # no caller: writers of the same field elsewhere
    "field": ("void fill(struct s *cfg, struct fw *out) {\n out->timing = cfg->clock;\n}\nvoid flush(struct fw *fw, struct r *regs) {\n regs->a = fw->timing;\n}", {("cfg->clock", "regs->a = fw->timing")}),
    "field_with_caller": ("void fill(struct s *cfg, struct fw *out) {\n out->timing = cfg->clock;\n}\nvoid flush(struct fw *fw, struct r *regs) {\n regs->a = fw->timing;\n}\nvoid top(struct fw *other, struct r *r) {\n flush(other, r);\n}", {("cfg->clock", "regs->a = fw->timing")}),
    "global": ("int shared;\nvoid fill(struct s *cfg) {\n shared = cfg->mode;\n}\nvoid flush(struct r *regs) {\n regs->a = shared;\n}", {("cfg->mode", "regs->a = shared")}),
    "own_name_is_no_global": ("void fill(struct s *cfg) {\n int t;\n t = cfg->mode;\n}\nvoid flush(struct r *regs) {\n int t;\n regs->a = t;\n}", set()),
    "loops_end": ("void f(struct s *cfg, struct r *regs) {\n int x, y;\n x = cfg->seed;\n y = x;\n x = x + y;\n y = x + y;\n regs->a = y;\n}", {("cfg->seed", "regs->a = y")}),
    "local_pointer": ("static void put(struct r *regs, int v) {\n regs->a = v;\n}\nstatic void (*ops[2])(struct r *, int) = { put, put };\nvoid f(struct s *cfg, struct r *r, int i) {\n void (*fp)(struct r *, int);\n fp = ops[i];\n fp(r, cfg->speed);\n}", {("cfg->speed", "regs->a = v")}),
    "registrar": ("void put(struct r *regs, int v) {\n regs->a = v;\n}\nstatic void (*hooks[4])(struct r *, int);\nvoid reg_hook(void (*cb)(struct r *, int), int i) {\n hooks[i] = cb;\n}\nvoid init(void) {\n reg_hook(put, 0);\n}\nvoid f(struct s *cfg, struct r *r) {\n hooks[0](r, cfg->tone);\n}", {("cfg->tone", "regs->a = v")}),
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    """All cases in one tree; functions and globals of each have its name before theirs."""
    root = tmp_path_factory.mktemp("rules")
    own = ("put", "fill", "flush", "top", "pick", "init", "reg_hook", "hooks", "ops", "shared", "timing")
    import re

    for k, (name, (text, _)) in enumerate(RULES.items()):
        text = re.sub(rf"\b({'|'.join(own)})\b", lambda m, n=name: f"{n}_{m[1]}", text)
        (root / f"{name}.c").write_text(re.sub(r"\bf\(", f"f{k}(", text))
    code = Code.index(spark, [str(root)])
    made: dict = {}
    for r in code.trace(depth=8).collect():
        made.setdefault(r.path.removesuffix(".c"), []).append(r)
    return made


@pytest.mark.parametrize("name", RULES)
def test_rule(found, name):
    want = {(s, sink.replace("shared", f"{name}_shared").replace("timing", f"{name}_timing")) for s, sink in RULES[name][1]}
    assert {(r.source, r.sink) for r in found.get(name, [])} == want


def test_labels_and_nodes(found):
    param = {r.label: r for r in found["param"]}
    assert set(param) == {"regs->a = v", "r->a = cfg->level"}
    assert [(n.var, n.transform) for n in param["regs->a = v"].nodes] == [("v", ""), ("cfg->level", "param")]
    chain = [n.var for n in found["reassigned"][0].nodes]
    assert chain == ["u", "t", "cfg->one"] and found["reassigned"][0].hops == 2
    assert [n.transform for n in found["return"][0].nodes][1] == "=return_pick(...)"


def test_reverse_trace(spark, tmp_path):
    (tmp_path / "a.c").write_text("void f(struct s *cfg, struct r *regs) {\n int t = cfg->x;\n regs->a = t;\n regs->b = cfg->y;\n}\n")
    got = Code.index(spark, [str(tmp_path)]).reverse_trace(r"\bregs->a\b").collect()
    assert [(r.sink, r.paths) for r in got] == [("regs->a = t", ["f:cfg->x -> f:t => regs->a = t"])]

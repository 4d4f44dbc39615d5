"""A tolerant C and C++ front end: source text to entity rows, without a preprocessor or a full grammar.

The text is cut into tokens; both arms of conditionals are kept. Braces, parentheses and statement ends
then give namespaces, types, functions, statements and expressions; what isn't understood is skipped up to the next
statement, and brackets that don't match, or nest too deep, give a diagnostic row.
``extract`` gives one dictionary of row lists a file; nothing here knows Spark.
"""

from __future__ import annotations

import re
import sys

_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<hash>^[ \t]*\#(?:[^\n\\]|\\\n|\\.)*)|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<number>(?:0[xX][0-9A-Fa-f]+|\d+\.?\d*(?:[eE][+-]?\d+)?)[uUlLfF]*)|(?P<name>[A-Za-z_]\w*)|(?P<op><<=|>>=|\.\.\.|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|::|.)",
    re.S | re.M,
)
KEYWORDS = frozenset("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while bool class public private protected namespace using virtual override new delete true false nullptr template typename".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
CLAMPS = frozenset("CLAMP clamp CLIP clip SATURATE saturate".split())
COPIES = frozenset("memcpy memmove bcopy".split())
#: Frames that nested blocks and expressions may take; they are Python frames, so none of the C stack.
DEPTH = 60_000
_ACCESS = ("public", "protected", "private")
_OPENS, _SHUTS = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")


class Tok(tuple):
    """(kind, text, line)"""

    kind, text, line = property(lambda s: s[0]), property(lambda s: s[1]), property(lambda s: s[2])


def tokenize(source: str):
    """Tokens without space; comments by the line they begin on; preprocessor lines."""
    toks, comments, directives, line = [], {}, [], 1
    for m in _TOKEN.finditer(source):
        kind, text = m.lastgroup, m[0]
        if kind == "comment":
            comments.setdefault(line, text.strip("/* \t\n"))
        elif kind == "hash":
            directives.append((line, text.strip()))
        elif kind != "space":
            toks.append(Tok((kind, text, line)))
        line += text.count("\n")
    return toks, comments, directives


def close(toks, at: int) -> int:
    """Index of the token that closes the bracket at ``at`` (or the last one)."""
    depth = 0
    for k in range(at, len(toks)):
        t = toks[k].text
        if t in _OPENS:
            depth += 1
        elif t in _SHUTS:
            depth -= 1
            if depth == 0:
                return k
    return len(toks) - 1


def text_of(toks) -> str:
    out, last = [], None
    for t in toks:
        if last is not None and last.kind in ("name", "number") and t.kind in ("name", "number"):
            out.append(" ")
        elif last is not None and t.kind == "op" and t.text not in "()[].,->::++--!~" and last.text not in "([!~&*" or last is not None and last.kind == "op" and last.text not in "()[].->::!~&*++--" and last.text != ",":
            out.append(" ")
        elif last is not None and last.text == ",":
            out.append(" ")
        out.append(t.text)
        last = t
    return "".join(out)


def path_at(toks, k: int):
    """The access path that begins at name k (a->b.c[i]) and the index after it."""
    start = k
    k += 1
    while k < len(toks):
        if toks[k].text in ("->", ".", "::") and k + 1 < len(toks) and toks[k + 1].kind == "name":
            k += 2
        elif toks[k].text == "[":
            k = close(toks, k) + 1
        else:
            break
    return "".join(t.text for t in toks[start:k]), k


def variables(toks) -> list[str]:
    """Access paths read by an expression, in order and once each; callees, types and casts are none."""
    found, k = [], 0
    while k < len(toks):
        t = toks[k]
        if t.kind == "name" and t.text not in KEYWORDS and not (k and toks[k - 1].text in ("struct", "enum", "union")):
            path, end = path_at(toks, k)
            called = end < len(toks) and toks[end].text == "("
            for j in range(k, end):
                if toks[j].text == "[":
                    found += variables(toks[j + 1 : close(toks, j)])
            if not called and not (k and toks[k - 1].text == "." and (k < 2 or toks[k - 2].text in "{,")):
                found.append(path)
            k = end
        else:
            k += 1
    return list(dict.fromkeys(found))


def split_args(toks) -> list[list]:
    out, cur, depth = [], [], 0
    for t in toks:
        if t.text == "," and depth == 0:
            out.append(cur)
            cur = []
            continue
        depth += (t.text in _OPENS) - (t.text in _SHUTS)
        cur.append(t)
    if cur or out:
        out.append(cur)
    return out


def calls(toks):
    """(callee text, arguments as tokens, line) of every call within."""
    k = 0
    while k < len(toks):
        if toks[k].kind == "name" and toks[k].text not in KEYWORDS and not (k and toks[k - 1].text in ("->", ".", "::")):
            path, end = path_at(toks, k)
            if end < len(toks) and toks[end].text == "(":
                yield path, split_args(toks[end + 1 : close(toks, end)]), toks[k].line
            k = max(k + 1, end if end < len(toks) and toks[end].text == "(" else k + 1)
        else:
            k += 1


def _params(toks, function: str, line: int):
    for i, arg in enumerate(split_args(toks)):
        names = [t.text for t in arg if t.kind == "name" and t.text not in KEYWORDS]
        if text_of(arg) in ("void", ""):
            continue
        inner = re.search(r"\(\s*\*\s*(\w+)\s*\)", text_of(arg))
        name = inner[1] if inner else names[-1] if names else ""
        kind = text_of(arg[: max(0, max((k for k, t in enumerate(arg) if t.text == name), default=0))])
        yield {"function": function, "idx": i, "name": name, "type": kind.strip(), "line": line}


class _File:
    def __init__(self, source: str):
        self.lines = source.split("\n")
        self.toks, self.comments, directives = tokenize(source)
        self.rows: dict[str, list] = {k: [] for k in ENTITIES}
        self.unions: set[str] = set()
        for line, text in directives:
            if m := re.match(r"#\s*include\s*([<\"])([^>\"]+)", text):
                self.rows["includes"].append({"included": m[2], "line": line, "is_system": m[1] == "<"})
            elif m := re.match(r"#\s*define\s+(\w+)\(([^)]*)\)\s*(.*)", text, re.S):
                self.rows["macros"].append({"macro": m[1], "params": m[2].strip(), "body": m[3].strip()[:500], "line": line, "writes": bool(re.search(r"->\s*\w+\s*(\[|\)?\s*=[^=])|\*\s*\(", m[3]))})
        self._balance()
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, DEPTH))
        try:
            self.top(0, len(self.toks), "", "")
        except RecursionError:
            self.add("diagnostics", severity="error", message="nested too deep; the rest of the file is not read", line=self.toks[-1].line)
        finally:
            sys.setrecursionlimit(before)

    def add(self, what: str, /, **row):
        self.rows[what].append(row)

    def _balance(self):
        """Diagnostics for brackets without a partner."""
        open_ = []
        for t in self.toks:
            if t.text in _OPENS:
                open_.append(t)
            elif t.text in _SHUTS:
                if open_ and _OPENS[open_[-1].text] == t.text:
                    open_.pop()
                else:
                    self.add("diagnostics", severity="error", message=f"unexpected {t.text}", line=t.line)
        for t in open_:
            self.add("diagnostics", severity="error", message=f"unclosed {t.text}", line=t.line)

    def _symbol(self, name, scope, kind, first, last, defined, spaces="", access="", template="", signature=None):
        self.add("symbols", name=name, qualified_name=scope + name, kind=kind, signature=signature if signature is not None else text_of(first), line_start=first[0].line, line_end=last.line, is_definition=defined, namespace=spaces, visibility=access, template_params=template, is_static=any(t.text == "static" for t in first) and not access)

    def _angle(self, k: int, end: int) -> int:
        """Index of the > that closes the < at k."""
        depth = 0
        for j in range(k, end):
            depth += (self.toks[j].text == "<") - (self.toks[j].text == ">") - 2 * (self.toks[j].text == ">>")
            if depth <= 0:
                return j
            if self.toks[j].text in "{;":
                break
        return k

    def top(self, k: int, end: int, scope: str, spaces: str, owner: str = "", access: str = ""):
        """Declarations from k to end: of a file, a namespace (spaces), or a class (owner, with its access so far)."""
        toks, start, template = self.toks, k, ""
        while k < end:
            t = toks[k]
            if t.text == "template" and k + 1 < end and toks[k + 1].text == "<":
                stop = self._angle(k + 1, end)
                template = text_of(toks[k + 2 : stop])
                k = start = max(stop, k + 1) + 1
                continue
            if t.text in ("struct", "union", "class", "enum") and self._body(k, end):
                k = self._type(start, k, end, scope, spaces, owner, access, template)
                start, template = k, ""
                continue
            if t.text == "namespace" and not any(x.text == "using" for x in toks[start:k]):
                names = []
                while k < end and toks[k].text not in "{;=":
                    names += [toks[k].text] if toks[k].kind == "name" and toks[k].text not in KEYWORDS else []
                    k += 1
                if k < end and toks[k].text == "{":
                    shut, name = close(toks, k), "::".join(names) or "(anonymous)"
                    self._symbol(name, scope, "NAMESPACE", toks[start : k or 1] or [toks[k]], toks[shut], True, spaces, signature=f"namespace {name}")
                    self.top(k + 1, shut, f"{scope}{name}::", f"{spaces}::{name}" if spaces else name)
                    k = shut
                k += 1
                start = k
                continue
            if t.text == "extern" and k + 2 < end and toks[k + 1].kind == "string" and toks[k + 2].text == "{":
                k = start = k + 3  # a linkage block: its brace closes as a stray one
                continue
            if owner and t.text in _ACCESS and k + 1 < end and toks[k + 1].text == ":":
                access, k = t.text, k + 2
                start = k
                continue
            if t.text == "(" and k > start and (found := self._callable(start, k)):
                shut = close(toks, k)
                j = self._after_params(shut + 1, end)
                name, kind = found
                if template and kind == "FUNCTION":
                    kind = "FUNCTION_TEMPLATE"
                if owner or "::" in name:
                    last = owner or name.split("::")[-2]
                    plain = name.split("::")[-1]
                    kind = "DESTRUCTOR" if plain.startswith("~") else "CONSTRUCTOR" if plain == last else "FUNCTION_TEMPLATE" if template else "METHOD"
                if j < end and toks[j].text == "{":
                    last = close(toks, j)
                    self._function(name, kind, scope, spaces, access, template, start, k, shut, j, last)
                    k = start = last + 1
                    template = ""
                    continue
                if j < end and toks[j].text == ";" and (k - start >= 2 or kind == "CONSTRUCTOR") and "=" not in [x.text for x in toks[start:k]]:
                    self._symbol(name, scope, kind, toks[start : shut + 1], toks[j], False, spaces, access, template)
                    k, start, template = j + 1, j + 1, ""
                    continue
                k = shut + 1
                continue
            if t.text == "=" and toks[start].text not in ("using", "typedef"):
                stop = self._initializer(start, k, end)
                self._declared(start, k, toks[min(stop, end) - 1], scope, spaces, owner, access)
                k = start = stop
                continue
            if t.text == ";":
                self._declared(start, k, t, scope, spaces, owner, access)
                template = ""
            elif t.text in _OPENS:
                k = close(toks, k) + 1
                continue
            k += 1
            if t.text in ";}":
                start = k

    def _callable(self, start: int, k: int):
        """Name and kind of the function whose parameters begin at k, if one may."""
        toks, at = self.toks, k - 1
        if toks[at].text in (">", ")", "]") or toks[at].kind != "name":
            if toks[at - 1].text == "operator" and at - 1 >= start:
                name, at = "operator" + toks[at].text, at - 1
            else:
                return None
        elif toks[at].text in KEYWORDS:
            return None
        else:
            name = toks[at].text
            if at - 1 >= start and toks[at - 1].text == "operator":
                name, at = "operator " + name, at - 1
            elif at - 1 >= start and toks[at - 1].text == "~":
                name, at = "~" + name, at - 1
        while at - 2 >= start and toks[at - 1].text == "::" and toks[at - 2].kind == "name":
            name, at = f"{toks[at - 2].text}::{name}", at - 2
        return name, "METHOD" if "::" in name else "FUNCTION"

    def _after_params(self, j: int, end: int) -> int:
        """Index of what follows a parameter list and its qualifiers, trailing type and member initializers."""
        toks = self.toks
        while j < end and (toks[j].text in ("const", "override", "noexcept", "final", "volatile", "&", "&&")):
            j += 1
            if j < end and toks[j - 1].text == "noexcept" and toks[j].text == "(":
                j = close(toks, j) + 1
        if j < end and toks[j].text == "->":
            while j < end and toks[j].text not in "{;":
                j += 1
        if j + 1 < end and toks[j].text == "=" and toks[j + 1].text in ("0", "default", "delete"):
            j += 2
        if j < end and toks[j].text == ":":
            j += 1
            while j < end:
                while j < end and toks[j].text not in ("(", "{", ";"):
                    j += 1
                if j >= end or toks[j].text == ";":
                    break
                j = close(toks, j) + 1
                if j < end and toks[j].text == ",":
                    j += 1
                else:
                    break
        return j

    def _declared(self, start: int, k: int, last, scope: str, spaces: str, owner: str, access: str):
        """Typedefs, aliases and variables of a statement without a body; its initializer, if any, begins at k."""
        part = self.toks[start:k]
        if not part or part[0].text in ("friend", "return", "goto", "static_assert") or part[0].text in _ACCESS:
            return
        text = text_of(part)
        inner = re.search(r"\(\s*\*\s*(\w+)\s*(?:\[[^\]]*\])*\s*\)", text)
        if part[0].text == "typedef":
            names = [t.text for t in part if t.kind == "name" and t.text not in KEYWORDS]
            if inner or names:
                self._symbol(inner[1] if inner else names[-1], scope, "TYPEDEF", part, last, True, spaces, access)
        elif part[0].text == "using":
            if len(part) > 3 and part[2].text == "=":
                self._symbol(part[1].text, scope, "TYPE_ALIAS", part, last, True, spaces, access)
        elif (not owner or any(t.text == "static" for t in part)) and (inner or "(" not in [t.text for t in part]):
            for n, piece in enumerate([part] if inner else split_args(part)):
                cut = next((j for j, t in enumerate(piece) if t.text in "[:" and t.text != "::"), len(piece))
                names = [t for t in piece[:cut] if t.kind == "name"]
                if inner or names and (n or len(names) > 1) and names[-1].text not in KEYWORDS:
                    name = inner[1] if inner else names[-1].text
                    self._symbol(name, scope, "VARIABLE", part, last, part[0].text != "extern", spaces, access)
                    self._instance("", [t.text for t in part], name, part[0].line)

    def _instance(self, function: str, words, name: str, line: int):
        """A variable whose type names a union of this file."""
        if "union" in words or any(w in self.unions for w in words if w != name):
            self.add("union_vars", function=function, name=name, line=line)

    def _body(self, k: int, end: int) -> bool:
        j, toks = k + 1, self.toks
        while j < end and (toks[j].kind in ("name", "number") or toks[j].text in (":", ",", "::")):
            j += 1
            if j < end and toks[j].text == "<":
                j = max(self._angle(j, end), j) + 1
        return j < end and toks[j].text == "{"

    def _type(self, start: int, k: int, end: int, scope: str, spaces: str, owner: str, access: str, template: str) -> int:
        toks, what, first = self.toks, self.toks[k].text, k
        while toks[k].text != "{":
            k += 1
        head = toks[first + 1 : k]
        colon = next((j for j, t in enumerate(head) if t.text == ":"), len(head))
        names = [t.text for t in head[:colon] if t.kind == "name" and t.text not in KEYWORDS and t.text != "final"]
        partial = any(t.text == "<" for t in head[:colon])
        tag = names[0] if partial and names else names[-1] if names else ""
        shut = close(toks, k)
        after = shut + 1
        while after < end and toks[after].text != ";" and (toks[after].kind == "name" or toks[after].text in ("*", ",", "[", "]", "=") or toks[after].kind == "number"):
            after += 1
        behind = toks[shut + 1 : after]
        typedef = toks[start].text == "typedef"
        alias = next((t.text for t in behind if t.kind == "name"), "")
        name = tag or alias
        for part in split_args(head[colon + 1 :]) if what != "enum" else ():
            words = [t.text for t in part]
            base = text_of([t for t in part if t.text not in (*_ACCESS, "virtual")])
            if base:
                self.add("bases", class_name=scope + name, base=base, access=next((x for x in words if x in _ACCESS), "private" if what == "class" else "public"), is_virtual="virtual" in words)
        if what == "enum":
            self._symbol(name or "(anonymous)", scope, "ENUM", toks[first : first + 1], toks[shut], True, spaces, access, signature=f"enum {name}".strip())
            value = 0
            for part in split_args(toks[k + 1 : shut]):
                if not part:
                    continue
                given = text_of(part[2:]) if len(part) > 2 else ""
                try:
                    value = int(given.rstrip("uUlL"), 0) if given else value
                    number = value
                except ValueError:
                    number = None
                self.add("enum_values", enum=name, value=part[0].text, text=given or str(value), number=number, line=part[0].line)
                value += 1
        else:
            kind = ("CLASS_TEMPLATE_PARTIAL_SPECIALIZATION" if partial else "CLASS_TEMPLATE") if template else what.upper()
            self._symbol(name or "(anonymous)", scope, kind, toks[first : first + 1], toks[shut], True, spaces, access, template, signature=f"{what} {name}".strip())
            if what == "union":
                self.unions |= {n for n in (tag, alias if typedef else "") if n}
                self.add("unions", name=name, line=toks[first].line)
            self._fields(k + 1, shut, name, f"{scope}{name or '(anonymous)'}::", spaces, "private" if what == "class" else "public")
            self.top(k + 1, shut, f"{scope}{name or '(anonymous)'}::", spaces, name, "private" if what == "class" else "public")
        if behind and not (what == "enum" and owner):
            for piece in split_args(behind):
                named = [t for t in piece if t.kind == "name"]
                if named and typedef:
                    self._symbol(named[0].text, scope, "TYPEDEF", toks[start : start + 1], toks[min(after, end - 1)], True, spaces, access, signature=f"typedef {what} {named[0].text}")
                elif named and not owner:
                    self._symbol(named[0].text, scope, "VARIABLE", toks[start : first + 1], toks[min(after, end - 1)], True, spaces, access, signature=f"{what} {tag} {named[0].text}".replace("  ", " "))
                    if what == "union":
                        self.add("union_vars", function="", name=named[0].text, line=named[0].line)
        return after

    def _fields(self, k: int, end: int, owner: str, scope: str, spaces: str, access: str):
        toks, start = self.toks, k
        while k < end:
            if toks[k].text == "{":
                k = close(toks, k) + 1
                if k < end and toks[k].text != ";" and toks[start].text in ("struct", "union"):
                    start = k  # a member whose type is written here
                    while k < end and toks[k].text != ";":
                        k += 1
                    for piece in split_args(toks[start:k]):
                        named = [t for t in piece if t.kind == "name"]
                        if named:
                            self._field(owner, named[0].text, "struct", named[0].line, toks[k].line, scope, spaces, access)
                start = k
                continue
            if toks[k].text == ":" and toks[k - 1].text in _ACCESS:
                access, start = toks[k - 1].text, k + 1
            if toks[k].text == ";":
                part = toks[start:k]
                inner = re.search(r"\(\s*\*\s*(\w+)\s*\)", text_of(part))
                if part and part[0].text not in ("typedef", "using", "friend", "static", "template") and (inner or "(" not in [t.text for t in part]):
                    pieces = split_args(part) if not inner else [part]
                    base = [t for t in pieces[0] if t.kind == "name"][:-1]
                    for piece in pieces:
                        cut = next((j for j, t in enumerate(piece) if t.text in ("[", ":", "=")), len(piece))
                        named = [t for t in piece[:cut] if t.kind == "name"]
                        if named and (inner or base):
                            kind = " ".join(t.text for t in base) + " *" * sum(t.text == "*" for t in piece[:cut] if not inner)
                            self._field(owner, inner[1] if inner else named[-1].text, kind, named[-1].line, toks[k].line, scope, spaces, access)
                start = k + 1
            k += 1

    def _field(self, owner, name, kind, line, last, scope, spaces, access):
        self.add("fields", struct=owner, field=name, type=kind, line=line, comment=self.comments.get(last, ""))
        self.add("symbols", name=name, qualified_name=scope + name, kind="FIELD", signature=f"{kind} {name}", line_start=line, line_end=line, is_definition=True, namespace=spaces, visibility=access, template_params="", is_static=False)

    def _initializer(self, start: int, k: int, end: int) -> int:
        """A file-scope initializer: function tables."""
        toks = self.toks
        name = next((t.text for t in toks[start:k] if t.kind == "name" and t.text not in KEYWORDS and toks[toks.index(t) + 1].text in "[="), "")
        stop = k
        while stop < end and toks[stop].text != ";":
            stop = close(toks, stop) + 1 if toks[stop].text in _OPENS else stop + 1
        if k + 1 < end and toks[k + 1].text == "{":
            for part in split_args(toks[k + 2 : close(toks, k + 1)]):
                words = [t.text for t in part]
                if words and part[-1].kind == "name":
                    member = words[1] if words[0] == "." else ""
                    if len(words) == 1 or "=" in words:
                        self.add("tables", array_name=name, member=member, callee=words[-1])
        return stop + 1

    def _function(self, name, kind, scope, spaces, access, template, start, k, shut, j, last):
        toks = self.toks
        self._symbol(name, scope, kind, toks[start : shut + 1], toks[last], True, spaces, access, template)
        params = list(_params(toks[k + 1 : shut], name, toks[k].line))
        self.rows["params"] += params
        self.known = {p["name"] for p in params}
        for p in params:
            self._instance(name, p["type"].split(), p["name"], p["line"])
        body = toks[j + 1 : last]
        self._locals(body, name)
        for callee, args, line in calls(body):
            short = callee.split("->")[-1].split(".")[-1]
            indirect = callee != short or "[" in callee or callee in self.known
            self.add("calls", function=name, callee=callee, args=[text_of(a) for a in args], arg_vars=[variables(a) for a in args], line=line, is_indirect=indirect, snippet=self.lines[line - 1].strip()[:200])
            if short in COPIES and len(args) >= 2:
                dst, src = (args[1], args[0]) if short == "bcopy" else (args[0], args[1])
                self.add("assignments", function=name, lhs=text_of(dst).lstrip("&"), rhs=text_of(src).lstrip("&"), rhs_vars=variables(src), rhs_call="", operator="=", transform=short, line=line)
            if short in CLAMPS and len(args) == 3:
                for a, side in ((args[1], "min"), (args[2], "max")):
                    self.add("ranges", function=name, variable=text_of(args[0]), side=side, bound=text_of(a), line=line)
        self._block(body, name, ())

    def _locals(self, body, name):
        """Declarations of a body: a type (a name, or keywords), perhaps pointers, and a name at the beginning of a statement."""
        k, n = 0, len(body)
        while k < n:
            if k == 0 or body[k - 1].text in (";", "{", "}", "(", ":") or body[k - 1].text == ")" and body[k].kind == "name":
                j, words = k, []
                while j < n and (body[j].kind == "name" or body[j].text in ("*", "&", "::")) and body[j].text not in ("return", "goto", "case", "else", "sizeof", "new", "delete", "do", "if", "for", "while", "switch"):
                    words.append(body[j])
                    j += 1
                named = [t for t in words if t.kind == "name"]
                if len(named) >= 2 and words[-1].kind == "name" and named[-1].text not in KEYWORDS and j < n and body[j].text in ("=", ";", "[", ",", "{"):
                    stop = j
                    while stop < n and body[stop].text not in (";", "}", ")"):
                        stop = close(body, stop) + 1 if body[stop].text in _OPENS else stop + 1
                    kind = text_of(words[:-1])
                    for m, piece in enumerate(split_args(body[k:stop])):
                        plain = piece[: next((i for i, t in enumerate(piece) if t.text in ("=", "[", "{")), len(piece))]
                        own = [t for t in plain if t.kind == "name" and t.text not in KEYWORDS]
                        if own:
                            self.add("locals", function=name, name=own[-1].text, type=kind, line=own[-1].line)
                            self._instance(name, [t.text for t in words[:-1]], own[-1].text, own[-1].line)
                    k = j
                    continue
            k += 1

    def _block(self, body, name, gates):
        k = 0
        while k < len(body):
            t = body[k]
            if t.text in ("if", "while", "switch", "for") and k + 1 < len(body) and body[k + 1].text == "(":
                shut = close(body, k + 1)
                inside = body[k + 2 : shut]
                if t.text == "for":
                    for part in text_split(inside, ";"):
                        self._statement(part, name, gates)
                stop = self._extent(body, shut + 1)
                inner = body[shut + 1 : stop]
                now = gates
                if t.text == "if":
                    fields = [v for v in variables(inside) if "->" in v or "." in v]
                    now = (*gates, *fields)
                    self._range(inside, inner, name)
                inner = inner[1:-1] if inner and inner[0].text == "{" else inner
                before = len(self.rows["assignments"])
                if t.text == "switch":
                    self._switch(inside, inner, name, now)
                else:
                    self._block(inner, name, now)
                if t.text == "if":
                    self._guarded(inside, self.rows["assignments"][before:], name)
                k = stop
            elif t.text == "{" and (k == 0 or body[k - 1].text != "="):
                shut = close(body, k)
                self._block(body[k + 1 : shut], name, gates)
                k = shut + 1
            elif t.text in ("else", "do", ";", "}") or t.text in ("case", "default") or t.kind == "name" and k + 1 < len(body) and body[k + 1].text == ":" and (k == 0 or body[k - 1].text in ";{}"):
                if t.text in ("case", "default"):
                    while k < len(body) and body[k].text != ":":
                        k += 1
                k += 1
            else:
                stop = k
                while stop < len(body) and body[stop].text != ";":
                    stop = close(body, stop) + 1 if body[stop].text in _OPENS else stop + 1
                self._statement(body[k:stop], name, gates)
                k = stop + 1

    def _guarded(self, condition, assigned, name):
        """Fields assigned under a condition; and under a comparison with a command-line flag."""
        fields = [v for v in variables(condition) if "->" in v or "." in v]
        flags = []
        for callee, args, _ in calls(condition):
            texts = [a[0].text[1:-1] for a in args if len(a) == 1 and a[0].kind == "string"]
            if callee == "keymatch" and texts:
                flags.append("-" + texts[0].lstrip("-"))
            elif re.fullmatch(r"str\w*cmp", callee) and any(x.startswith("-") for x in texts):
                flags += [x for x in texts if x.startswith("-")]
        for a in assigned:
            if "->" in a["lhs"] or "." in a["lhs"]:
                self.add("guarded", function=name, field=a["lhs"], value=a["rhs"], condition=text_of(condition)[:200], condition_fields=fields, line=a["line"])
                for flag in flags:
                    self.add("cli", function=name, flag=flag, field=a["lhs"], line=a["line"])

    def _switch(self, on, body, name, gates):
        """Fields that three or more cases of a switch over a field assign."""
        cuts = [k for k, t in enumerate(body) if t.text in ("case", "default")]
        found, cases = [], 0
        self._block(body[: cuts[0]] if cuts else body, name, gates)
        for i, j in zip(cuts, [*cuts[1:], len(body)], strict=True):
            before = len(self.rows["assignments"])
            self._block(body[i:j], name, gates)
            colon = next((k for k in range(i, j) if body[k].text == ":"), i)
            new = [a for a in self.rows["assignments"][before:] if "->" in a["lhs"] or "." in a["lhs"]]
            cases += bool(new)
            found += [(text_of(body[i + 1 : colon]) or "default", a) for a in new]
        over = variables(on)
        if cases >= 3 and over and ("->" in over[0] or "." in over[0]):
            for value, a in found:
                self.add("cascades", function=name, source=over[0], case_value=value, target=a["lhs"], value=a["rhs"], line=a["line"])

    def _extent(self, body, k: int) -> int:
        """End of the statement at k."""
        if k < len(body) and body[k].text == "{":
            return close(body, k) + 1
        if k < len(body) and body[k].text in ("if", "while", "for", "switch") and k + 1 < len(body):
            return self._extent(body, close(body, k + 1) + 1)
        while k < len(body) and body[k].text != ";":
            k = close(body, k) + 1 if body[k].text in _OPENS else k + 1
        return k + 1

    def _range(self, condition, inner, name):
        """if (x > most) x = most;"""
        flat = [t for t in inner if t.text not in "{};"]
        eq = [k for k, t in enumerate(flat) if t.text == "="]
        found = _compared(condition)
        if found and len(eq) == 1:
            a, side, b = found
            if text_of(flat[: eq[0]]) == a and text_of(flat[eq[0] + 1 :]) == b:
                self.add("ranges", function=name, variable=a, side=side, bound=b, line=condition[0].line)

    def _clamped(self, left, right, name):
        """x = (x > most) ? most : x; x = MIN(x, most); x = MAX(x, least);"""
        lhs, line = text_of(left), left[0].line
        ask = _at_depth(right, "?")
        if ask is not None:
            other = _at_depth(right[ask + 1 :], ":")
            found = _compared(right[:ask])
            if found and other is not None and found[0] == lhs and text_of(right[ask + 1 : ask + 1 + other]) == found[2] and text_of(right[ask + 2 + other :]) == lhs:
                self.add("ranges", function=name, variable=lhs, side=found[1], bound=found[2], line=line)
        elif len(right) > 3 and right[0].text in ("MIN", "min", "MAX", "max") and right[1].text == "(" and close(right, 1) == len(right) - 1:
            args = [text_of(a) for a in split_args(right[2:-1])]
            if len(args) == 2 and lhs in args:
                self.add("ranges", function=name, variable=lhs, side="max" if right[0].text.lower() == "min" else "min", bound=args[1] if args[0] == lhs else args[0], line=line)

    def _statement(self, part, name, gates):
        if not part:
            return
        if part[0].text == "return":
            if part[1:]:
                self.add("returns", function=name, expr=text_of(part[1:]), vars=variables(part[1:]), line=part[0].line)
            return
        for piece in split_args(part):
            depth = 0
            for k, t in enumerate(piece):
                depth += (t.text in _OPENS) - (t.text in _SHUTS)
                if t.text in ASSIGN and depth == 0 and k:
                    left, right = piece[:k], piece[k + 1 :]
                    names = [j for j, x in enumerate(left) if x.kind == "name" and x.text not in KEYWORDS]
                    if not names:
                        break
                    head = names[0]
                    while len(names) > 1 and head != names[-1] and path_at(left, head)[1] < len(left) and left[path_at(left, head)[1]].text not in ("=",):
                        names = names[1:]
                        head = names[0]
                    lhs, _ = path_at(left, head)
                    if head == 0 and len(left) > 1 and path_at(left, 0)[1] < len(left):
                        lhs = text_of(left)
                    if left[0].text == "*" and head == 1:
                        lhs = "*" + lhs
                    if t.text == "=":
                        self._clamped(left, right, name)
                    whole = _whole_call(right)
                    used = variables(right)
                    if t.text != "=":
                        used = [lhs, *used]
                    self.add("assignments", function=name, lhs=lhs, rhs=text_of(right), rhs_vars=list(dict.fromkeys(used)), rhs_call=whole, operator=t.text, transform=next((x.text for x in right if x.text in ("+", "-", "*", "/", "<<", ">>", "&", "|", "?")), ""), line=left[0].line)
                    for g in dict.fromkeys(gates):
                        for v in dict.fromkeys([lhs, *used]):
                            if ("->" in v or "." in v) and v != g:
                                self.add("gates", function=name, gating=g, gated=v, line=left[0].line)
                    break
        if gates:
            for _, args, line in calls(part):
                for v in dict.fromkeys(v for a in args for v in variables(a)):
                    for g in dict.fromkeys(gates):
                        if ("->" in v or "." in v) and v != g:
                            self.add("gates", function=name, gating=g, gated=v, line=line)


def _unwrapped(toks):
    """An expression without parentheses around it and casts before it."""
    while toks and toks[0].text == "(":
        shut = close(toks, 0)
        if shut == len(toks) - 1:
            toks = toks[1:-1]
        elif all(t.kind == "name" or t.text in ("*", "::", "&") for t in toks[1:shut]) and shut > 1 and (toks[shut + 1].kind in ("name", "number") or toks[shut + 1].text in "(*&"):
            toks = toks[shut + 1 :]
        else:
            break
    return toks


def _whole_call(toks) -> str:
    """The callee where an expression is one call, behind parentheses, casts and signs."""
    toks = _unwrapped(toks)
    while len(toks) > 1 and toks[0].text in ("-", "+", "!", "~", "*", "&"):
        toks = _unwrapped(toks[1:])
    if not toks or toks[0].kind != "name" or toks[0].text in KEYWORDS:
        return ""
    path, end = path_at(toks, 0)
    return path if end < len(toks) and toks[end].text == "(" and close(toks, end) == len(toks) - 1 else ""


def _at_depth(toks, text: str):
    """Index of the first such token outside brackets."""
    depth = 0
    for k, t in enumerate(toks):
        if t.text == text and depth == 0:
            return k
        depth += (t.text in _OPENS) - (t.text in _SHUTS)
    return None


def _compared(toks):
    """(left, side, right) of a condition that is one comparison: side max for > and >=, min for < and <=."""
    toks = _unwrapped(toks)
    ops = [k for k, t in enumerate(toks) if t.text in ("<", ">", "<=", ">=")]
    if len(ops) != 1 or any(t.text in ("&&", "||", "==", "!=") for t in toks):
        return None
    return text_of(toks[: ops[0]]), "max" if toks[ops[0]].text[0] == ">" else "min", text_of(toks[ops[0] + 1 :])


def text_split(toks, sep: str):
    out, cur = [], []
    for t in toks:
        if t.text == sep:
            out.append(cur)
            cur = []
        else:
            cur.append(t)
    return [*out, cur]


#: Spark schemas of the entity rows.
ENTITIES = {
    "symbols": "name string, qualified_name string, kind string, signature string, line_start int, line_end int, is_definition boolean, namespace string, visibility string, template_params string, is_static boolean",
    "includes": "included string, line int, is_system boolean",
    "bases": "class_name string, base string, access string, is_virtual boolean",
    "macros": "macro string, params string, body string, line int, writes boolean",
    "fields": "struct string, field string, type string, line int, comment string",
    "enum_values": "enum string, value string, text string, number bigint, line int",
    "unions": "name string, line int",
    "union_vars": "function string, name string, line int",
    "locals": "function string, name string, type string, line int",
    "diagnostics": "severity string, message string, line int",
    "tables": "array_name string, member string, callee string",
    "params": "function string, idx int, name string, type string, line int",
    "calls": "function string, callee string, args array<string>, arg_vars array<array<string>>, line int, is_indirect boolean, snippet string",
    "assignments": "function string, lhs string, rhs string, rhs_vars array<string>, rhs_call string, operator string, transform string, line int",
    "returns": "function string, expr string, vars array<string>, line int",
    "ranges": "function string, variable string, side string, bound string, line int",
    "gates": "function string, gating string, gated string, line int",
    "guarded": "function string, field string, value string, condition string, condition_fields array<string>, line int",
    "cli": "function string, flag string, field string, line int",
    "cascades": "function string, source string, case_value string, target string, value string, line int",
}


def extract(source: str) -> dict[str, list]:
    """Entity rows of one file; empty lists where nothing is understood."""
    return _File(source).rows

"""Personal data: fixed base rules, and a skip-chain conditional random field over each document.

Base rules find emails, IP addresses, cards and phone numbers. The field's nodes are these entities and the free tokens that
hold a digit or an at sign, and those without that repeat what comes before the at sign of one of the document's emails
(jane.doe beside jane.doe@x.org). Entities keep their label; free tokens take one of five: a kind, or none. A free token has a
potential for its shape, neighbours share a chain potential, and tokens that are repeated or similar anywhere in the document
(same normal form, same last seven digits, same local part of an email) a skip potential; loopy sum-product passes labels
along both. So a number or name which is personal data once is so throughout its document. A token's shape never makes it personal
data alone: it takes messages, from neighbours or from repeated or similar tokens, that speak for the label by themselves. A token
that is written as a kind but fails its check (a card number whose checksum is wrong, an address with a part over 255) has that against it.

Training is piecewise and in closed form, over all documents, never a sample: by shape (4096 classes) the logarithm of the odds
that a token of that shape lies within an entity of a kind rather than in none, at most even; by kind the logarithm of the share of its
entities that would fail its check, of which the base rules have seen none; by pair of neighbouring labels the logarithm of
how much more often they meet than by chance; by sort of skip key the logarithm of the odds that two entities which share one
are of the same kind. No weight is set by hand; counts are smoothed so that few documents decide little (PRIOR) and many no
more than an error in a thousand allows (FLOOR). What is gathered is bounded by the number of classes.

Edge cases: null and empty texts have no spans; positions are code points; runs of any length are scanned in linear time;
repeated rows are handled each by itself; of equally likely labels none comes before kinds, and kinds in the order of KINDS;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import map_text, quoted, table, tune
from ._text import buffers

KINDS = ("email", "ip", "card", "phone")
SHAPES = 4096
PASSES = 8
#: Counts that stand for what is known before any document: pairs of neighbours that meet by chance, agreeing entities of a key.
PRIOR_CHAIN, PRIOR_SKIP = 20.0, 30.0
#: Share of errors that counts never rule out: of a shape's label, of a skip key's agreement.
FLOOR_SHAPE, FLOOR_SKIP = 1e-3, 5e-4
#: Sorts of skip keys: repeated normal form, same last seven digits, same local part.
SORTS = "tdl"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_FOUR = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_TRIM = "\"'`.,;:!?<>[]{}()"
_MARK = re.compile(r"[0-9@]")
_BREAK = re.compile(r"\s|\Z")
_WORD = re.compile(r"\S+")


def emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def addresses(text: str):
    for m in _DOTTED.finditer(text):
        if text.find(".", m.start(), m.end()) < 0:
            continue
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str):
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), by start and kind."""
    if not _MARK.search(text):
        return []
    return sorted((a, k, b) for k, find in enumerate((emails, addresses, cards, phones)) for a, b in find(text))


def _shape(token: str) -> int:
    low = re.sub(r"[a-z]+", "a", re.sub(r"[^\x00-\x7f]", "a", token.lower()))
    runs = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", low)
    return zlib.crc32(runs[:200].encode()) % SHAPES


def failed(token: str) -> list[int]:
    """Numbers of the kinds that a free token is written as, and whose check it therefore fails."""
    out = [0] if "@" in token else []
    if _FOUR.fullmatch(token):
        out.append(1)
    if _CARD.fullmatch(token) and 12 <= len(_digits(token)) <= 19 and not luhn(_digits(token)):
        out.append(2)
    if _PHONE.fullmatch(token):
        out.append(3)
    return out


def tokens(text: str, spans):
    """Tokens that hold a digit or an at sign, or share a skip key with an entity that does: start, end, string, the kind of the first base span that each meets (-1: free), and that span's number (-1)."""
    out, k, end = [], 0, 0
    while m := _MARK.search(text, end):
        a, last = m.start(), end
        while a > last and not text[a - 1].isspace():
            a -= 1
        end = _BREAK.search(text, m.end()).start()
        s = text[a:end]
        a += len(s) - len(s.lstrip(_TRIM))
        s = s.strip(_TRIM)
        if not s or not _MARK.search(s):
            continue
        b = a + len(s)
        while k < len(spans) and spans[k][2] <= a:
            k += 1
        j = k
        while j < len(spans) and spans[j][0] < b and spans[j][2] <= a:
            j += 1
        met = j < len(spans) and spans[j][0] < b
        out.append((a, b, s, spans[j][1] if met else -1, j if met else -1))
    # a token without digit or at sign can only share keys that have none either
    names = {key[2:] for t in out if t[3] >= 0 for key in _skip_keys(t[2]) if not _MARK.search(key)}
    if not names:
        return out
    for m in _WORD.finditer(text):
        s = m[0].strip(_TRIM)
        if s.lower() in names and not _MARK.search(s):
            a = m.start() + len(m[0]) - len(m[0].lstrip(_TRIM))
            out.append((a, a + len(s), s, -1, -1))
    return sorted(out)


def _skip_keys(s: str):
    """What tokens share that count as repeated or similar; too short ones repeat by chance."""
    if len(s) >= 6:
        yield "t:" + s.lower()
    d = _digits(s)
    if len(d) >= 7:
        yield "d:" + d[-7:]
    local = s.lower().split("@")[0]
    if len(local) >= 5:
        yield "l:" + local


def nodes(toks):
    """The tokens as nodes, those of one base span joined: start, end, kind, its tokens' strings."""
    out = []
    for a, b, s, kind, span in toks:
        if span >= 0 and out and out[-1][4] == span:
            out[-1][1] = b
            out[-1][3].append(s)
        else:
            out.append([a, b, kind, [s], span])
    return out


def _node_keys(node):
    """An entity of several tokens (a phone number in groups) shares keys as a whole too."""
    whole = "".join(node[3])
    return dict.fromkeys(key for s in ([*node[3], whole] if len(node[3]) > 1 else node[3]) for key in _skip_keys(s))


def _chained(a, b) -> bool:
    """Nodes count as neighbours where at most one short word lies between them."""
    return b[0] - a[1] <= 12


CHAIN_AT, SKIP_AT, COUNTS = 5 * SHAPES, 5 * SHAPES + 25, 5 * SHAPES + 25 + 2 * len(SORTS)


def counted(text: str, total: np.ndarray) -> None:
    """Add a document's counts: labels by shape, pairs of neighbouring labels, and by sort of key pairs of entities of one kind and of two."""
    toks = tokens(text, base_spans(text))
    known = {key for t in toks if t[3] >= 0 for key in _skip_keys(t[2])}
    for t in toks:
        if t[3] < 0 and known and not known.isdisjoint(_skip_keys(t[2])):
            continue  # what repeats an entity is no example of a free token
        total[(t[3] + 1) * SHAPES + _shape(t[2])] += 1
    last, first = None, {}
    for node in nodes(toks):
        if last and _chained(last, node):
            total[CHAIN_AT + 5 * (last[2] + 1) + node[2] + 1] += 1
        last = node
        if node[2] >= 0:
            for key in _node_keys(node):
                kind = first.setdefault(key, node)
                if kind is not node:
                    total[SKIP_AT + 2 * SORTS.index(key[0]) + (kind[2] != node[2])] += 1


def potentials(total: np.ndarray):
    """Shape (SHAPES, 5), chain (5, 5), skip (a sort each, 5, 5) and failed check (5) potentials from counts. Label 0 is no entity."""
    by_shape = total[:CHAIN_AT].reshape(5, SHAPES).T.astype(float)
    free = by_shape[:, :1]
    shape = np.log((by_shape + 0.1 + FLOOR_SHAPE * free) / (free + 0.9 + FLOOR_SHAPE * by_shape))
    shape = np.minimum(shape, 0)  # what the base rules left free is no likelier an entity than not
    shape[:, 0] = 0
    check = np.concatenate([[0], np.log(np.maximum(0.5 / (by_shape.sum(axis=0)[1:] + 1), FLOOR_SHAPE))])
    near = total[CHAIN_AT:SKIP_AT].reshape(5, 5).astype(float)
    rows, cols = near.sum(axis=1) + 1, near.sum(axis=0) + 1
    chance = rows[:, None] * cols[None, :] / (rows.sum() * cols.sum())
    near = near + PRIOR_CHAIN * chance
    chain = np.log(near / (near.sum() * chance))
    same, other = total[SKIP_AT:COUNTS].reshape(len(SORTS), 2).T.astype(float)
    agree = np.log((same + PRIOR_SKIP) / (other + 0.5 + FLOOR_SKIP * same))
    skip = agree[:, None, None] * np.diag([0.0, 1, 1, 1, 1])[None]
    return shape, chain, skip, check


def train(docs: DataFrame, text: str = "text"):
    """The potentials, from counts over all documents."""
    tune(docs.sparkSession)

    def count(batches):
        total = np.zeros(COUNTS, np.int64)
        for b in batches:
            data, offs = buffers(b.column(0))
            raw = data.tobytes()
            for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                t = raw[i:j].decode("utf-8", "replace")
                if _MARK.search(t):
                    counted(t, total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    found = docs.select(quoted(text).cast("binary").alias("text")).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(COUNTS, np.int64)
    total[found["k"].to_numpy(np.int64)] = found["n"].to_numpy()
    return potentials(total)


def marginals(unary: np.ndarray, edges: np.ndarray, kinds: np.ndarray, potentials: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Loopy sum-product: label probabilities of the nodes. edges (m, 2), kinds (m,) choose among potentials (k, labels, labels)."""
    n, labels = unary.shape
    m = len(edges)
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    back = np.concatenate([np.arange(m) + m, np.arange(m)])
    table_ = np.concatenate([potentials[kinds], potentials[kinds].transpose(0, 2, 1)]) if m else np.zeros((0, labels, labels))
    message = np.zeros((2 * m, labels))
    for _ in range(passes if m else 0):
        belief = unary.copy()
        np.add.at(belief, dst, message)
        inner = (belief[src] - message[back])[:, :, None] + table_
        top = inner.max(axis=1)
        new = top + np.log(np.exp(inner - top[:, None, :]).sum(axis=1))
        message = new - new.max(axis=1, keepdims=True)
    belief = unary.copy()
    np.add.at(belief, dst, message)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def field(toks, model):
    """A document's nodes, their unary potentials, edges, and each edge's table: 0 chain, then a sort of skip key each."""
    shape, check = model[0], model[3]
    found = nodes(toks)
    unary = np.zeros((len(found), 5))
    for k, node in enumerate(found):
        if node[2] < 0:
            unary[k] = shape[_shape(node[3][0])]
            for kind in failed(node[3][0]):
                unary[k, kind + 1] += check[kind + 1]
        else:
            unary[k] = -1e3
            unary[k, node[2] + 1] = 0
    hub: dict[str, int] = {}
    keys = [_node_keys(node) for node in found]
    for k, node in enumerate(found):  # an entity is the hub of its keys, else the first node
        for key in keys[k]:
            if key not in hub or node[2] >= 0 > found[hub[key]][2]:
                hub[key] = k
    skip: dict[tuple[int, int], int] = {}  # two nodes share one potential, that of their first key's sort
    for k, node in enumerate(found):
        if node[2] < 0:
            for key in keys[k]:
                if (h := hub[key]) != k:
                    skip.setdefault((min(k, h), max(k, h)), 1 + SORTS.index(key[0]))
    near = [(k, k + 1) for k in range(len(found) - 1) if _chained(found[k], found[k + 1])]
    edges = np.array([*skip, *near], np.int64).reshape(-1, 2)
    return found, unary, edges, np.array([*skip.values(), *[0] * len(near)], np.int64)


def label(toks, model):
    """Spans that the field adds to a document's base spans: (start, kind, end)."""
    if all(t[3] >= 0 for t in toks):
        return []
    found, unary, edges, kinds = field(toks, model)
    free = [k for k, node in enumerate(found) if node[2] < 0]
    most = max(0.0, model[1].max() - model[1].min())
    if not (kinds > 0).any() and unary[free, 1:].max() + 2 * most < 0:
        return []  # no message could turn a node
    p = marginals(unary, edges, kinds, np.concatenate([model[1][None], model[2]]))
    best = p.argmax(axis=1)
    # what messages add to a node's own evidence
    told = np.log(np.maximum(p, 1e-300))
    told = told - told[:, :1] - unary + unary[:, :1]
    return [(found[k][0], int(best[k]) - 1, found[k][1]) for k in free if best[k] and p[k, best[k]] >= 0.5 and told[k, best[k]] > 1e-9]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _all_spans(text: str, model):
    if not _MARK.search(text):
        return [], []
    base = base_spans(text)
    return base, sorted(base + label(tokens(text, base), model))


def masked(text: str, spans) -> str:
    """The text with each span (merged where they meet) replaced by its kind, as <EMAIL>."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model, text: str = "text", keep=("doc_id",), flat: bool = True, mask: bool = False) -> DataFrame:
    """The columns of keep, and out: counts of base spans, base_sha256, spans, and (with mask) masked, null where nothing is to mask."""

    def run(data, offs):
        raw = data.tobytes()
        cols: list[list] = [[] for _ in range(7)]
        for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            t = raw[i:j].decode("utf-8", "replace")
            base, spans = _all_spans(t, model)
            counts = [sum(s[1] == k for s in base) for k in range(4)]
            for c, x in zip(cols, [*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), masked(t, spans) if mask and spans else None], strict=True):
                c.append(x)
        return cols

    return map_text(docs, run, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked string", text, keep, flat)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs)).select("doc_id", "out.n_email", "out.n_ip", "out.n_card", "out.n_phone", "out.base_sha256", "out.spans")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; n_chars follows the text where the table has it.

    Null and empty texts stay as they are; repeated rows are masked alike; spans that meet are masked as one; an empty table
    stays empty. Columns of any name come out as they were.
    """
    names = docs.columns
    made = find(docs, train(docs), keep=names, flat=False, mask=True)
    column = {c: F.col(f"keep.c{i}") for i, c in enumerate(names)}
    text = F.coalesce(F.col("out.masked"), column["text"])
    if "n_chars" in names:
        column["n_chars"] = F.when(F.col("out.masked").isNull(), column["n_chars"]).otherwise(F.length("out.masked").cast(docs.schema["n_chars"].dataType))
    return made.select(*[(text if c == "text" else column[c]).alias(c) for c in names])

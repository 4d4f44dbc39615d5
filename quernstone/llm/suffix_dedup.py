"""Suffix-array dedup: bytes of 50-byte strings that a document with a smaller key holds too are removed.

The suffixes of a corpus can't be sorted in one place, nor sent around by their prefixes. So:

1. Documents are dealt to groups of about GROUP bytes and travel once, compressed.
2. Every 50-byte window belongs to its smallest 20-byte substring by hash (its minimizer), so
   equal windows belong alike. Each group sends its distinct minimizers, five bytes each, to
   buckets, and learns which of them other documents hold too.
3. Runs of windows with such a minimizer (segments, about 66 bytes) go to that minimizer's
   bucket: within a group equal segments collapse first, and those of a later document are
   decided on the spot, so a passage of a third of the rows costs one segment a group.
4. A bucket sorts the suffixes of its segments (to depth 50), takes common prefixes of
   50 or more as intervals, and within each finds the earlier match of every suffix: a
   previous or next smaller owner in suffix order exists unless its owner is the smallest.
5. Spans go back to the groups, which cut their documents.

``previous_factors`` is the same on texts that fit in memory: suffix array, common prefixes,
and longest previous factors by previous and next smaller positions.

Edge cases: null and empty texts lose nothing; a null key is larger than all others; rows that
share a key don't match each other; matches never cross documents; a text shorter than the
length stays. Keys must be integers.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import arrow_schema, quoted, table, tune
from ._text import MIX1, blocks, buffers, mix, spans_hash

GROUP = 6 << 20
LENGTH, GRAM = 50, 20
#: Places of segments whose spans are told at once.
PLACES = 1 << 18
LAST = np.iinfo(np.int64).max
FIVE = np.uint64(2**40 - 1)


# --- in memory


def suffix_array(data: bytes) -> np.ndarray:
    """Starts of the suffixes of data in order, by prefix doubling."""
    rank = np.frombuffer(data, np.uint8).astype(np.int64) + 1
    n, step = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while step < n:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:]
        order = np.lexsort((second, rank))
        new = np.concatenate([[True], (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])])
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n:
            break
        step *= 2
    return order


def previous_factors(data: bytes) -> np.ndarray:
    """For each position: the length of the longest string that starts here and at an earlier position too."""
    n, order = len(data), suffix_array(data)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    common, h = np.zeros(n + 1, np.int64), 0  # of order[k - 1] and order[k]
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + h < n and j + h < n and data[i + h] == data[j + h]:
                h += 1
            common[rank[i]] = h
            h = max(h - 1, 0)
        else:
            h = 0
    out, stack = np.zeros(n, np.int64), []
    for k in range(n + 1):  # the stack holds (position, common prefix with its previous smaller position)
        at, width = (order[k] if k < n else -1), common[k] if k < n else 0
        while stack and stack[-1][0] > at:
            position, before = stack.pop()
            out[position] = max(before, width)  # width: with the next smaller position
            width = min(width, before)
        stack.append((at, width))
    return out


# --- minimizers


def gram_hash(data: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hash of each k bytes, by joining hashes of halves."""
    cur, out, used, bit = mix(data.astype(np.uint64) + np.uint64(1)), None, 0, 1
    while bit <= k:
        if k & bit:
            out = cur if out is None else (out[: len(cur) - used] * MIX1 + cur[used:]) ^ (out[: len(cur) - used] >> np.uint64(29))
            used += bit
        if 2 * bit <= k:
            cur = (cur[:-bit] * MIX1 + cur[bit:]) ^ (cur[:-bit] >> np.uint64(31))
        bit *= 2
    return mix(out)


def segments(data: np.ndarray, offs: np.ndarray):
    """Runs of windows with one minimizer: document, start, bytes, minimizer."""
    parts = []
    wide = LENGTH - GRAM + 1
    for i, j in blocks(offs, 1 << 17):
        block = data[offs[i] : offs[j]]
        if len(block) < LENGTH:
            continue
        low, size = gram_hash(block), 1
        while 2 * size <= wide:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
        borders = offs[i : j + 1] - offs[i]
        doc = np.searchsorted(borders, np.arange(len(low)), side="right") - 1 if j - i > 1 else np.zeros(len(low), np.int64)
        good = np.arange(len(low)) + LENGTH <= borders[doc + 1]
        start = np.flatnonzero(good & np.concatenate([[True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])]))
        if len(start):
            last = np.append(start[1:], len(low)) - 1
            last = np.minimum(last, borders[doc[start] + 1] - LENGTH)
            parts.append((doc[start] + i, start + offs[i], last - start + LENGTH, low[start]))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def _pack(*arrays) -> bytes:
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(r) for r in raw], np.int64).tobytes() + b"".join(raw))


def _unpack(raw: bytes, *kinds) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(data, np.int64, len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


SPAN = (np.uint32, np.uint32, np.uint32)
PIECE = (np.uint32, np.int64, np.uint32, np.uint32, np.uint32, np.uint8)


# --- groups of documents


def _chunks(docs: DataFrame, groups: int, text: str, keep) -> DataFrame:
    """g, docs, sizes, texts: the documents of a batch that go to one group, texts compressed together."""
    row = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)])
    source = docs.select(row.alias("keep"), F.coalesce(quoted(text).cast("binary"), F.lit(b"")).alias("text"), F.xxhash64(F.to_json(F.struct(*[quoted(c) for c in keep if c != text])), quoted(text)).alias("h"))
    schema = T.StructType([T.StructField("g", T.IntegerType()), T.StructField("docs", T.ArrayType(source.schema["keep"].dataType)), T.StructField("sizes", T.BinaryType()), T.StructField("texts", T.BinaryType())])
    want = arrow_schema(schema)

    def run(batches):
        seen: Counter = Counter()
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            data, offs = buffers(b.column(1))
            h = b.column(2).to_numpy(zero_copy_only=False).copy()
            for k, x in enumerate(h.tolist()):  # repeated rows are dealt out one by one
                if seen[x]:
                    h[k] += seen[x]
                seen[x] += 1
            g = h % groups
            order = np.argsort(g, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], g[order][1:] != g[order][:-1]])) if len(g) else []
            raw = memoryview(data)
            for at in np.split(order, cuts[1:]) if len(g) else []:
                cell = b.column(0).take(pa.array(at)).cast(want.field("docs").type.value_type)
                texts = b"".join(raw[offs[k] : offs[k + 1]] for k in at)
                yield pa.RecordBatch.from_arrays([pa.array([g[at[0]]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), cell).cast(want.field("docs").type), pa.array([np.diff(offs)[at].astype(np.int32).tobytes()]), pa.array([pack.compress(texts)])], schema=want)

    return source.mapInArrow(run, schema)


# --- a bucket's minimizers and suffixes


def shared_by(one: list[np.ndarray], more: list[np.ndarray]) -> list[np.ndarray]:
    """Of each group's minimizers (of one document, of several) those that are not of one document alone.

    A bucket has as many groups as there are, so what a group costs goes by its own minimizers: they are looked up, not sorted along with all.
    """
    v = np.sort(np.concatenate([*one, *more, *more]))
    shared = np.unique(v[1:][v[1:] == v[:-1]])
    if not len(shared):
        return more
    return [np.concatenate([m, x[shared[np.minimum(np.searchsorted(shared, x), len(shared) - 1)] == x]]) for x, m in zip(one, more, strict=True)]


def earlier(data: np.ndarray, begin: np.ndarray, size: np.ndarray, owner: np.ndarray):
    """Which windows of the pieces data[begin : begin + size] start with LENGTH bytes that a piece of a smaller owner holds too.

    Returns a flag for each window, pieces one after the other. Suffixes are sorted by eight bytes at a time;
    only those still tied are sorted on.
    """
    counts = size - LENGTH + 1
    piece = np.repeat(np.arange(len(size), dtype=np.int32), counts)
    at = begin[piece] + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    if len(data) < 2**31:
        at = at.astype(np.int32)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        eight[: len(data)] |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(56 - 8 * k)
    order = np.arange(len(at), dtype=np.int32)
    group = np.zeros(len(at), np.int32)
    for depth in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        key = eight[at[order] + depth]
        inner = np.argsort(key) if depth == 0 else np.lexsort((key, group))
        order, key, group = order[inner], key[inner], group[inner]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])]) if len(key) else np.zeros(0, bool)
        group = np.cumsum(new, dtype=np.int32)
        tied = np.bincount(group, minlength=1)[group] > 1
        order, group = order[tied], group[tied]
    out = np.zeros(len(at), bool)
    if len(order):
        # common prefixes of LENGTH: intervals of the suffix order, within which ties go by owner
        own = owner[piece[order]]
        least = np.minimum.reduceat(own, np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])))
        out[order] = own > least[np.unique(group, return_inverse=True)[1]]
    return out, piece


def _group_documents(part: pa.Table):
    """A group's documents in an order that doesn't depend on how they arrived: their rows, keys, bytes and borders."""
    rows = pa.concat_arrays([c.flatten() for c in part.column("docs").chunks])
    unpack = zstandard.ZstdDecompressor()
    raw = [unpack.decompress(x) for x in part.column("texts").to_pylist()]
    sizes = [np.frombuffer(x, np.int32).astype(np.int64) for x in part.column("sizes").to_pylist()]
    data = np.frombuffer(b"".join(raw), np.uint8)
    size = np.concatenate(sizes)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    key = rows.field(0).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((spans_hash(data, begin, begin + size) if len(data) else begin, key))
    flat = data.tobytes()
    joined = b"".join([flat[a : a + n] for a, n in zip(begin[order].tolist(), size[order].tolist(), strict=True)])
    return rows.take(pa.array(order)), key[order], np.frombuffer(joined, np.uint8), np.concatenate([[0], np.cumsum(size[order])])


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """keep (struct; its first field is the key) and out: n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    tune(docs.sparkSession)
    total = docs.select(F.coalesce(F.sum(F.octet_length(quoted(text)).cast("long")), F.lit(0))).first()[0]
    groups = max(1, -(-total // GROUP))
    chunks = _chunks(docs, groups, text, (key,))
    bucket_of = lambda h: ((h >> np.uint64(40)) % np.uint64(groups)).astype(np.int64)

    def name(part: pa.Table) -> pa.Table:
        """A group's distinct minimizers by bucket: those of one document, and those of several."""
        _, keys, data, offs = _group_documents(part)
        doc, _, _, h = segments(data, offs)
        who = np.unique(keys, return_inverse=True)[1][doc]
        order = np.lexsort((who, h & FIVE, bucket_of(h)))
        b, v, w = bucket_of(h)[order], (h & FIVE)[order], who[order]
        new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (b[1:] != b[:-1])])) if len(v) else np.zeros(0, np.int64)
        several = np.maximum.reduceat(w, new) != np.minimum.reduceat(w, new) if len(new) else np.zeros(0, bool)
        b, v = b[new], v[new]
        there = np.unique(b)
        cut = np.searchsorted(b, [*there.tolist(), groups])
        ranges = list(zip(cut[:-1], cut[1:], strict=True))
        return pa.table({"bucket": pa.array(there, pa.int32()), "g": pa.array([part.column("g")[0].as_py()] * len(there), pa.int32()), "one": pa.array([_five(v[i:j][~several[i:j]]) for i, j in ranges], pa.binary()), "more": pa.array([_five(v[i:j][several[i:j]]) for i, j in ranges], pa.binary())})

    def share(part: pa.Table) -> pa.Table:
        """Which minimizers of a bucket are not of one document alone, told to each group that holds them."""
        held = shared_by([_from_five(x) for x in part.column("one").to_pylist()], [_from_five(x) for x in part.column("more").to_pylist()])
        some = [k for k, x in enumerate(held) if len(x)]
        return pa.table({"g": part.column("g").take(pa.array(some, pa.int64())), "bucket": part.column("bucket").take(pa.array(some, pa.int64())), "shared": pa.array([_five(held[k]) for k in some], pa.binary())})

    def cut(part: pa.Table, told: pa.Table) -> pa.Table:
        """A group's segments with shared minimizers, by bucket; at bucket -1 - g what the group itself decides."""
        g = part.column("g")[0].as_py() if part.num_rows else -1
        empty = pa.table({"bucket": pa.array([], pa.int32()), "g": pa.array([], pa.int32()), "pieces": pa.array([], pa.binary())})
        if not part.num_rows or not told.num_rows:
            return empty
        _, keys, data, offs = _group_documents(part)
        doc, start, size, h = segments(data, offs)
        shared = np.sort(np.concatenate([_from_five(x) | np.uint64(b) << np.uint64(40) for b, x in zip(told.column("bucket").to_pylist(), told.column("shared").to_pylist(), strict=True)]))
        full = h & FIVE | bucket_of(h).astype(np.uint64) << np.uint64(40)
        ok = shared[np.minimum(np.searchsorted(shared, full), len(shared) - 1)] == full
        doc, start, size, h = doc[ok], start[ok], size[ok], h[ok]
        same = spans_hash(data, start, start + size)
        own = keys[doc]
        order = np.lexsort((own, same))
        lead = np.concatenate([[True], same[order][1:] != same[order][:-1]])
        first = order[lead][np.cumsum(lead) - 1]  # of equal segments, that of the smallest key
        mine = own[order] == own[first]
        late = order[~mine]
        out_bucket, out = [-1 - g], [_pack(doc[late].astype(np.uint32), (start - offs[doc])[late].astype(np.uint32), size[late].astype(np.uint32))]
        # a row for each place where the smallest key holds a segment; its bytes once
        rows, heads = order[mine], lead[mine]
        number = np.cumsum(heads) - 1
        bucket = bucket_of(h[rows])
        flat = data.tobytes()
        by = np.lexsort((number, bucket))
        rows, heads, bucket = rows[by], heads[by], bucket[by]
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(rows) else np.zeros(0, np.int64)
        for i, j in zip(edges, np.append(edges[1:], len(rows)), strict=True):
            r, lead_ = rows[i:j], heads[i:j]
            content = b"".join([flat[a : a + n] for a, n in zip(start[r][lead_].tolist(), size[r][lead_].tolist(), strict=True)])
            out_bucket.append(int(bucket[i]))
            out.append(_pack(size[r][lead_].astype(np.uint32), own[r][lead_], (np.cumsum(lead_) - 1).astype(np.uint32), doc[r].astype(np.uint32), (start - offs[doc])[r].astype(np.uint32), np.frombuffer(content, np.uint8)))
        return pa.table({"bucket": pa.array(out_bucket, pa.int32()), "g": pa.array([g] * len(out), pa.int32()), "pieces": pa.array(out, pa.binary())})

    def match(part: pa.Table) -> pa.Table:
        """Spans of a bucket's segments that start in a smaller document too, by group."""
        bucket = part.column("bucket")[0].as_py()
        if bucket < 0:
            return pa.table({"g": part.column("g"), "spans": part.column("pieces")})
        got, part_g = [_unpack(x, *PIECE) for x in part.column("pieces").to_pylist()], part.column("g").to_pylist()
        size = np.concatenate([x[0] for x in got]).astype(np.int64)
        own = np.concatenate([x[1] for x in got])
        data = np.concatenate([x[5] for x in got])
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        # equal segments of several groups: the smallest owner's stands for them
        same = spans_hash(data, begin, begin + size)
        order = np.lexsort((own, same))
        lead = np.concatenate([[True], same[order][1:] != same[order][:-1]])
        stands = np.empty(len(size), np.int64)
        stands[order] = order[lead][np.cumsum(lead) - 1]
        heads = order[lead]
        flags, piece = earlier(data, begin[heads], size[heads], own[heads])
        # runs of flagged windows of each standing segment
        edge = np.concatenate([[True], (flags[1:] != flags[:-1]) | (piece[1:] != piece[:-1])]) if len(flags) else np.zeros(0, bool)
        run = np.flatnonzero(edge)
        stop = np.append(run[1:], len(flags))
        keep = flags[run] if len(run) else np.zeros(0, bool)
        run, stop = run[keep], stop[keep]
        head = piece[run]
        zero = np.concatenate([[0], np.cumsum(size[heads] - LENGTH + 1)])[:-1]
        off, width = run - zero[head], stop - run + LENGTH - 1
        run_of = np.full(len(size), -1, np.int64)
        run_of[heads] = np.arange(len(heads))
        many = np.bincount(head, minlength=len(heads))
        where = np.concatenate([[0], np.cumsum(many)])
        out_g, out, base = [], [], np.concatenate([[0], np.cumsum([len(x[0]) for x in got])])
        ends = np.cumsum([len(x[2]) for x in got])
        i = 0
        while i < len(got):  # runs of groups, of PLACES places or so
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PLACES, side="right")))
            some = got[i:j]
            r = np.concatenate([x[2] + b for x, b in zip(some, base[i:j], strict=True)])  # the segment of each place
            late = own[r] > own[stands[r]]
            k = run_of[stands[r]]
            n = np.where(late, 1, many[k])
            place = np.repeat(np.arange(len(r)), n)
            nth = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
            pick = np.minimum(where[k[place]] + nth, max(len(off) - 1, 0))
            o = np.where(late[place], 0, off[pick] if len(off) else 0)
            w = np.where(late[place], size[r[place]], width[pick] if len(off) else 0).astype(np.uint32)
            doc, start = np.concatenate([x[3] for x in some])[place], (np.concatenate([x[4] for x in some])[place] + o).astype(np.uint32)
            cuts = np.searchsorted(place, np.concatenate([[0], np.cumsum([len(x[2]) for x in some])]))
            for q in np.flatnonzero(np.diff(cuts)).tolist():
                of = slice(cuts[q], cuts[q + 1])
                out_g.append(part_g[i + q])
                out.append(_pack(doc[of], start[of], w[of]))
            i = j
        return pa.table({"g": pa.array(out_g, pa.int32()), "spans": pa.array(out, pa.binary())})

    kept = chunks.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("keep", kept), T.StructField("out", T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))])
    want = arrow_schema(schema)

    def remove(part: pa.Table, spans: pa.Table) -> pa.Table:
        if not part.num_rows:
            return want.empty_table()
        rows, _, data, offs = _group_documents(part)
        cover = np.zeros(len(data) + 1, np.int32)
        for raw in spans.column("spans").to_pylist():
            doc, start, size = (x.astype(np.int64) for x in _unpack(raw, *SPAN))
            np.add.at(cover, offs[doc] + start, 1)
            np.add.at(cover, offs[doc] + start + size, -1)
        gone = np.cumsum(cover[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        inner = np.zeros(len(data) + 1, bool)
        inner[offs] = True
        begins = gone & (inner[:-1] | np.concatenate([[True], ~gone[:-1]])) if len(data) else gone
        runs = np.concatenate([[0], np.cumsum(begins)])
        cols: list[list] = [[], [], [], [], []]
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            left = data[a:b][~gone[a:b]].tobytes()
            for c, x in zip(cols, (b - a, int(total[b] - total[a]), int(runs[b] - runs[a]), hashlib.sha256(left).hexdigest(), left), strict=True):
                c.append(x)
        return pa.Table.from_arrays([rows.cast(want.field("keep").type), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, want.field("out").type, strict=True)], fields=list(want.field("out").type))], schema=want)

    named = chunks.groupBy("g").applyInArrow(name, "bucket int, g int, one binary, more binary")
    told = named.groupBy("bucket").applyInArrow(share, "g int, bucket int, shared binary")
    pieces = chunks.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(cut, "bucket int, g int, pieces binary")
    spans = pieces.groupBy("bucket").applyInArrow(match, "g int, spans binary")
    return chunks.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(remove, schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = deduplicate(table(spark, sf_dir, "documents"))
    return made.select(F.col("keep.c0").alias("doc_id"), "out.n_bytes", "out.n_removed", "out.n_spans", "out.kept_sha256")


#: Windows as substrings of the hexadecimal bytes: exact, and affordable on small tables.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, len(h) // 2 AS n FROM d),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS x FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM n WHERE n >= 50)),
m AS (SELECT x, min(doc_id) AS first FROM w GROUP BY x),
s AS (SELECT w.doc_id, i FROM w JOIN m ON w.x = m.x AND m.first < w.doc_id),
g AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, -1) AS fresh FROM s),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
c AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM r),
k AS (SELECT c.doc_id, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS body, max(b) AS tail FROM c JOIN n USING (doc_id) GROUP BY c.doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(body, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN k ON k.doc_id = n.doc_id
"""

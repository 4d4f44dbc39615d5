"""Byte-level BPE: ranked merges folded in Spark over the byte arrays of distinct words.

1. Each task gathers its documents to groups of about GROUP bytes. A group's texts are cut where white
   space begins (no piece of the split pattern crosses such a place), its distinct segments are
   split into words, and the documents become arrays of word numbers. Words that are pieces of the
   vocabulary have their rank as number; the others are listed once a group and dealt to buckets by hash.
2. Each bucket's distinct words become one row, and Spark's higher-order functions fold the ranked
   merges over each word, an array of byte ids: the neighbours of lowest rank merge until
   none has a rank. The ranks of pairs of ids are literals, a sparse table in three arrays.
3. Each group gets the ids of its listed words back, replaces numbers by ids, and joins the binary
   pieces of the vocabulary again to decode.

Groups and their cells of words travel compressed, once. There are never more cells than words that
groups list, so what is moved grows with the corpus; frequent words are mostly pieces of the
vocabulary and don't travel. A word that all groups list costs its bucket a number a group.

Nothing but the rank table (a fixed file) is known to all executors. Words of more than
LONG bytes (a run of letters without a break, say) would cost the fold quadratic time; they
are merged with a heap instead, with the same result.

Edge cases: null and empty texts have no ids; repeated rows are encoded each by itself; a document
larger than a group is a group of its own; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import arrow_schema, quoted, release, table, tune
from ._text import SPACE, blocks, buffers, spans_hash

#: Bytes of text that share one list of words, that are numbered at once, and that a bucket of words stands for.
GROUP, BLOCK, BUCKET = 8 << 20, 2 << 20, 8 << 20
LONG = 200
#: More than the places in a word; a power of two.
SCALE = 256
#: Stands before and after a word's byte ids; no id and no part of a pair that merges.
EDGE = 65_535
RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

_PIECES = regex.compile(public_tokenizers.PATTERN)
#: The same for ASCII text, where the faster standard module can tell the classes.
_ASCII_PIECES = re.compile(public_tokenizers.PATTERN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace("?A-Za-z+", "?[A-Za-z]+").replace("?0-9+", "?[0-9]+").encode())


def pieces(text: bytes) -> list[bytes]:
    """The words of a text, as public_tokenizers.PATTERN finds them."""
    return _ASCII_PIECES.findall(text) if text.isascii() else [p.encode() for p in _PIECES.findall(text.decode("utf-8", "replace"))]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


# --- the fold


@lru_cache(1)
def rank_tables(path: str) -> tuple[str, str, str]:
    """The ranks of pairs of ids as three JSON arrays: where a left id's row begins, and at begin + right id the left id whose row has the place, and SCALE times the rank.

    Rows are laid over one another where their places don't meet (first fit, longest rows first).
    """
    ranks, rows = read_ranks(path), {}
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
            if a is not None and b is not None:
                rows.setdefault(a, {})[b] = rank
    taken, low, begin = np.zeros(1 << 20, bool), 0, [None] * (max(rows) + 1)
    for a, row in sorted(rows.items(), key=lambda x: -len(x[1])):
        rights = np.sort(np.fromiter(row, np.int64))
        away = rights - rights[0]
        while taken[low]:
            low += 1
        at, some = low, 32
        while True:
            free = ~taken[at : at + some]
            for x in away[1:].tolist():
                free &= ~taken[at + x : at + x + some]
            if free.any():
                at += int(free.argmax())
                break
            at, some = at + some, min(2 * some, 8192)
        taken[at + away] = True
        begin[a] = at - int(rights[0])
    size = int(np.flatnonzero(taken)[-1]) + 1
    owner, scaled = [None] * size, [None] * size
    for a, row in rows.items():
        for b, rank in row.items():
            owner[begin[a] + b], scaled[begin[a] + b] = a, SCALE * rank
    return json.dumps(begin), json.dumps(owner), json.dumps(scaled)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(words: Column, rank_file: str = RANK_FILE) -> Column:
    """Ids of each word: words are arrays of the ids of two to LONG bytes, between two EDGEs; a piece's id is its rank."""
    begin, owner, scaled = (F.from_json(F.lit(x), "array<int>") for x in rank_tables(rank_file))  # literals, by the optimizer

    def ids(begin: Column, owner: Column, scaled: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            at = F.get(begin, a) + b
            return F.when(F.get(owner, at) == a, F.get(scaled, at))

        def merged(s: Column, best: Column, at: Column) -> Column:
            """The pieces at and at + 1 joined to one; the pairs at - 1 and at are new, those behind move up."""
            p, r, rest = s["p"], s["r"], F.lit(LONG + 2)
            new = F.array(rank(F.get(p, at - 1), best) + (at - 1), rank(best, F.get(p, at + 2)) + at)
            behind = F.transform(F.slice(r, at + 3, rest), lambda x: x - 1)
            pieces_ = F.flatten(F.array(F.slice(p, F.lit(1), at), F.array(best), F.slice(p, at + 3, rest)))
            return F.struct(pieces_.alias("p"), F.flatten(F.array(F.slice(r, F.lit(1), at - 1), new, behind)).alias("r"))

        def step(s: Column, _: Column) -> Column:
            # the least of ranks and, among equal ones, of places; aggregates over one element bind names without a copy
            join = lambda s, low: F.aggregate(F.array(low.bitwiseAND(SCALE - 1)), s, lambda s, at: merged(s, F.shiftright(low, SCALE.bit_length() - 1), at))
            return F.aggregate(F.array(F.array_min(s["r"])), s, lambda s, low: F.when(low.isNull(), s).otherwise(join(s, low)))

        def whole(w: Column) -> Column:
            # p: pieces; r: for each pair SCALE * rank + place, null where it doesn't merge
            start = F.struct(w.alias("p"), F.transform(w, lambda a, i: rank(a, F.get(w, i + 1)) + i).alias("r"))
            return F.aggregate(F.sequence(F.lit(1), F.size(w) - 3), start, step, lambda s: F.slice(s["p"], F.lit(2), F.size(s["p"]) - 2))

        return F.transform(words, whole)

    return _let(begin, lambda a: _let(owner, lambda b: _let(scaled, lambda c: ids(a, b, c))))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap, for words too long for the fold."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that starts here: its end, and the start before it
    alive = [True] * n
    heap = []

    def offer(i):
        j = end[i]
        if i >= 0 and j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != e or e == end[i]:
            continue
        j = end[i]
        alive[j], end[i] = False, e
        if e < n:
            before[e] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


# --- blocks of documents


@lru_cache(1)
def _vocabulary(path: str):
    """Ranks by piece, pieces by rank, and the id of each byte."""
    ranks = read_ranks(path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        by_id[rank] = piece
    return ranks, by_id, np.array([ranks[bytes([b])] for b in range(256)], np.int32)


#: White space of more than one byte, as the pattern's class has it.
_WIDE = {c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"}


def segments(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of segments: at each document, and wherever ASCII white space follows something else."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = SPACE[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = space[1:] & ~space[:-1]
    after = np.flatnonzero(cut[1:] & (data[:-1] >= 128)) + 1  # what ends there may be white space too
    if len(after):
        raw = data.tobytes()
        cut[[k for k in after.tolist() if raw[max(k - 2, 0) : k] in _WIDE or raw[max(k - 3, 0) : k] in _WIDE]] = False
    cut[offs[:-1][np.diff(offs) > 0]] = True
    return np.flatnonzero(cut)


def split_all(found: pa.Array):
    """(numbers, words, words in each) for classes of segments: the words of all that the class holds, in order.

    Segments from ASCII white space to something else are split as one text, as no word crosses the place where two of them
    meet. Lengths say where each ends; should a word cross after all, or a text be no UTF-8, its class is split one by one.
    """
    if not len(found):
        return
    data, offs = buffers(found)
    first, last = data[offs[:-1]], data[offs[1:] - 1]
    plain = np.add.reduceat(data >= 128, offs[:-1], dtype=np.int64) == 0
    whole = SPACE[first] & ~SPACE[last]
    doubtful = np.flatnonzero(whole & (last >= 128))
    wide = tuple(_WIDE)
    whole[[k for k in doubtful.tolist() if found[k].as_py().endswith(wide)]] = False
    for mask, joined in ((whole & plain, True), (whole & ~plain, True), (~whole, False)):
        which = np.flatnonzero(mask)
        if not len(which):
            continue
        part = found.take(pa.array(which))
        if joined:
            raw, ends = buffers(part)
            words = pieces(raw.tobytes())
            borders = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
            at = np.searchsorted(borders, ends[1:])
            if borders[-1] == ends[-1] and (borders[at] == ends[1:]).all():
                yield which, words, np.diff(at, prepend=-1)
                continue
        each = [pieces(x) for x in part.to_pylist()]
        yield which, [w for x in each for w in x], np.array([len(x) for x in each], np.int64)


def numbered(data: np.ndarray, offs: np.ndarray, path: str, listed: dict[bytes, int]):
    """Word numbers of all documents and each document's first; words beyond the vocabulary are numbered on in listed."""
    ranks, by_id, _ = _vocabulary(path)
    cut = segments(data, offs)
    borders = np.append(cut, len(data)).astype(np.int64 if len(data) >= 2**31 else np.int32)
    kind = pa.large_binary() if borders.dtype == np.int64 else pa.binary()
    found = pa.Array.from_buffers(kind, len(cut), [None, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    numbers, starts, size = [], np.zeros(len(found.dictionary), np.int64), np.zeros(len(found.dictionary), np.int64)
    before, base = 0, len(by_id)
    for which, words, count in split_all(found.dictionary):
        flat = list(map(ranks.get, words))
        long = []
        for k, number in enumerate(flat):
            if number is None:
                if len(words[k]) > LONG:
                    long.append(k)
                else:
                    flat[k] = base + listed.setdefault(words[k], len(listed))
        if long:
            per = np.ones(len(words), np.int64)
            for k in long:
                flat[k] = merge_long(words[k], ranks)
                per[k] = len(flat[k])
            flat = [x for y in flat for x in (y if isinstance(y, list) else (y,))]
            count = np.diff(np.append(0, np.cumsum(per))[np.append(0, np.cumsum(count))])
        starts[which], size[which] = before + np.cumsum(count) - count, count
        numbers.append(np.array(flat, np.int32))
        before += len(flat)
    numbers = np.concatenate([np.zeros(0, np.int32), *numbers])
    out, total = gathered(found.indices.to_numpy(), numbers, starts, size)
    return out, total[np.searchsorted(cut, offs)]


def gathered(which: np.ndarray, values: np.ndarray, starts: np.ndarray, size: np.ndarray):
    """The ranges of values that which names, joined, and the borders between them."""
    n = size[which]
    borders = np.concatenate([[0], np.cumsum(n)])
    return values[np.repeat(starts[which] - borders[:-1], n) + np.arange(borders[-1])], borders


def _packed(*arrays: np.ndarray) -> bytes:
    raw = [np.ascontiguousarray(x).tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(r) for r in raw], np.int64).tobytes() + b"".join(raw))


def _unpacked(raw: bytes, *kinds) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(raw), 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(data, np.int64, len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def _binary(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    borders = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _edged(words: pa.Array, byte_ids: np.ndarray) -> pa.ListArray:
    """The byte ids of each word between two EDGEs."""
    data, offs = buffers(words)
    size = np.diff(offs)
    ends = np.cumsum(size + 2)
    ids = np.full(int(ends[-1]) if len(ends) else 0, EDGE, np.int32)
    inner = np.ones(len(ids), bool)
    inner[ends - 1] = inner[ends - size - 2] = False
    ids[inner] = byte_ids[data]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))


def encode(docs: DataFrame, rank_file: str = RANK_FILE, text: str = "text", keep=("doc_id",), with_ids: bool = True) -> DataFrame:
    """keep (struct of fields c0, c1, ..) and out: n_tokens, ids (little-endian unsigned 32-bit, null unless with_ids), ids_sha256, decoded_sha256."""
    tune(docs.sparkSession)
    total = docs.select(F.coalesce(F.sum(F.octet_length(quoted(text)).cast("long")), F.lit(0))).first()[0]
    buckets = 1 + total // BUCKET
    row = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)])
    source = docs.select(row.alias("keep"), F.coalesce(quoted(text).cast("binary"), F.lit(b"")).alias("text"))
    kept = source.schema["keep"].dataType
    cells = T._parse_datatype_string("array<struct<bucket bigint, words binary>>")
    schema = T.StructType([T.StructField("g", T.LongType()), T.StructField("docs", T.ArrayType(kept)), T.StructField("numbers", T.BinaryType()), T.StructField("cells", cells)])
    want = arrow_schema(schema)
    kind = np.dtype(np.uint16 if len(read_ranks(rank_file)) <= 65536 else np.uint32)

    def group(g, held):
        listed: dict[bytes, int] = {}
        parts, firsts, before = [], [np.zeros(1, np.int64)], 0
        for _, data, offs in held:
            numbers, first = numbered(data, offs, rank_file, listed)
            parts.append(numbers)
            firsts.append(first[1:] + before)
            before += len(numbers)
        numbers = np.concatenate(parts)
        words = pa.array(list(listed), pa.binary())
        data, offs = buffers(words)
        bucket = (spans_hash(data, offs[:-1], offs[1:]) % np.uint64(buckets)).astype(np.int64) if len(words) else np.zeros(0, np.int64)
        order = np.argsort(bucket, kind="stable")  # words are numbered by bucket
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        base = len(_vocabulary(rank_file)[1])
        beyond = numbers >= base
        numbers[beyond] = place[numbers[beyond] - base] + base
        words = words.take(pa.array(order))
        data, offs = buffers(words)
        there, cut = np.unique(bucket[order], return_index=True)
        cut = [*cut.tolist(), len(order)]
        packed = [_packed(np.diff(offs[i : j + 1]).astype(np.uint8), data[offs[i] : offs[j]]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        rows = pa.concat_arrays([r for r, _, _ in held]).cast(want.field("docs").type.value_type)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        told = pa.StructArray.from_arrays([pa.array(there, pa.int64()), pa.array(packed, pa.binary())], fields=list(want.field("cells").type.value_type))
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), one(rows).cast(want.field("docs").type), pa.array([_packed(np.concatenate(firsts), numbers.view(np.uint8).reshape(-1, 4).T)], pa.binary()), one(told).cast(want.field("cells").type)], schema=want)

    def split(batches):
        g = TaskContext.get().partitionId() << 32  # of one stage, so no two groups share a number
        held, size = [], 0
        for b in batches:
            data, offs = buffers(b.column(1))
            for i, j in blocks(offs, BLOCK):
                held.append((b.column(0).slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                size += int(offs[j] - offs[i])
                if size >= GROUP:
                    yield group(g, held)
                    g, held, size = g + 1, [], 0
                    release()
        if held:
            yield group(g, held)
        del held
        release()

    groups = source.mapInArrow(split, schema)

    def tell(part: pa.Table) -> pa.Table:
        found = part.column("cells").combine_chunks().flatten()
        g = part.column("g")[0].as_py()
        return pa.table({"bucket": found.field(0), "g": pa.array([g] * len(found), pa.int64()), "words": found.field(1)})

    def distinct(part: pa.Table) -> pa.Table:
        """A bucket as one row: its distinct words, and which of them each group asked for."""
        cells_ = [_unpacked(x, np.uint8, np.uint8) for x in part.column("words").to_pylist()]
        found = pa.concat_arrays([_binary(n, data) for n, data in cells_]).dictionary_encode()
        at = np.split(found.indices.to_numpy().astype(np.int32), np.cumsum([len(n) for n, _ in cells_])[:-1])
        asks = pa.StructArray.from_arrays([part.column("g").combine_chunks(), pa.array([x.tobytes() for x in at], pa.binary())], names=["g", "at"])
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        release()
        return pa.table({"bucket": part.column("bucket").slice(0, 1), "asks": one(asks), "words": one(_edged(found.dictionary, _vocabulary(rank_file)[2]))})

    def answer(batches):
        for b in batches:
            for r in range(b.num_rows):
                lists = b.column(2)[r].values
                ids, borders = lists.flatten().to_numpy().astype(kind), lists.offsets.to_numpy().astype(np.int64)
                starts, size = borders[:-1] - borders[0], np.diff(borders)
                asks = b.column(1)[r].values
                packed = []
                for raw in asks.field(1):
                    at = np.frombuffer(raw.as_buffer(), np.int32)
                    packed.append(_packed(size[at].astype(np.uint8), gathered(at, ids, starts, size)[0]))
                bucket = b.column(0)[r].as_py()
                yield pa.RecordBatch.from_arrays([asks.field(0), pa.array([bucket] * len(packed), pa.int64()), pa.array(packed, pa.binary())], names=["g", "bucket", "ids"])
        release()

    told = groups.groupBy("g").applyInArrow(tell, "bucket bigint, g bigint, words binary")
    folded = told.groupBy("bucket").applyInArrow(distinct, "bucket bigint, asks array<struct<g bigint, at binary>>, words array<array<int>>").select("bucket", "asks", fold(F.col("words"), rank_file).alias("ids"))
    answers = folded.mapInArrow(answer, "g bigint, bucket bigint, ids binary")

    out = T._parse_datatype_string("n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
    made = T.StructType([T.StructField("keep", kept), T.StructField("out", out)])
    target = arrow_schema(made)

    def write(part: pa.Table, got: pa.Table) -> pa.Table:
        if not part.num_rows:
            return target.empty_table()
        by_id = _vocabulary(rank_file)[1]
        own = np.arange(len(by_id), dtype=kind)
        cells_ = [_unpacked(x, np.uint8, kind) for x in got.sort_by("bucket").column("ids").to_pylist()]
        values = np.concatenate([own, *[x for _, x in cells_]])
        size = np.concatenate([np.ones(len(own), np.int64), *[n.astype(np.int64) for n, _ in cells_]])
        starts = np.cumsum(size) - size
        first, planes = _unpacked(part.column("numbers")[0].as_py(), np.int64, np.uint8)
        numbers = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.int32).reshape(-1)
        cols: list[list] = [[], [], [], []]
        for i, j in blocks(first, 1 << 16):
            tokens, at = gathered(numbers[first[i] : first[j]], values, starts, size)
            raw, words = tokens.astype("<u4"), tokens.tolist()
            for p, q in zip(at[first[i:j] - first[i]].tolist(), at[first[i + 1 : j + 1] - first[i]].tolist(), strict=True):
                ids = raw[p:q].tobytes()
                back = b"".join(map(by_id.__getitem__, words[p:q]))
                for c, x in zip(cols, (q - p, ids if with_ids else None, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()), strict=True):
                    c.append(x)
        del values, numbers
        release()
        rows = part.column("docs").combine_chunks().flatten().cast(target.field("keep").type)
        return pa.Table.from_arrays([rows, pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target.field("out").type, strict=True)], fields=list(target.field("out").type))], schema=target)

    return groups.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(write, made)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode(table(spark, sf_dir, "documents"), with_ids=False)
    return made.select(F.col("keep.c0").alias("doc_id"), "out.n_tokens", "out.ids_sha256", "out.decoded_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns but for text, with n_tokens, ids (binary), ids_sha256 and decoded_sha256.

    Null and empty texts have no ids and stay; repeated rows are encoded each by itself; an empty table gives none. A column of the
    documents keeps its name, and what is made under that name gets _of_tokens behind it.
    """
    names = [c for c in docs.columns if c != "text"]
    made = encode(docs, keep=names)
    out = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    clash = {c: f"{c}_of_tokens" for c in out if c in names}
    return made.select(*[F.col(f"keep.c{i}").alias(c) for i, c in enumerate(names)], *[F.col(f"out.{c}").alias(clash.get(c, c)) for c in out])

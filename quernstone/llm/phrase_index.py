"""Benchmark decontamination over a distributed positional inverted index.

``build`` cuts the corpus into blocks of whole documents and writes each block's index as one
row of a Parquet table in the shared folder: its documents, its sorted terms (64-bit word
hashes, cut to make room for a position in one sort key) and their postings (word
positions, ascending; one number is left free between documents, so that no phrase
crosses them). ``search`` takes a set of test windows to every block: it looks up all
test terms, orders each window's terms from the rarest in the block, and intersects their
offset-adjusted postings; ``near`` finds windows whose words lie close together in any order.
The corpus is never shuffled. Test windows are sent to the executors in chunks of a
bounded size; beyond one chunk the index is searched again, and the hits are united by
document: its block's number and its number in the block.

Edge cases: null and empty texts have no words; items without words have no windows;
repeated items count once, by item_id; a window that occurs in several items hits all.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import arrow_schema, lean, quoted, shared_dir, table, tune, unpacked
from ._text import LOWER, NOT_ALNUM, blocks, buffers, shingles, spans_hash, word_spans

BLOCK = 1 << 20
#: Distinct windows of one chunk, and so the bound of what is broadcast (about 100 bytes each).
CHUNK = 250_000


def words_of(data: np.ndarray, offs: np.ndarray):
    starts, ends, first = word_spans(data, offs, NOT_ALNUM)
    return spans_hash(data, starts, ends, LOWER), first


def build(docs: DataFrame, path: str, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Write the index of docs to path and read it again. keep: the columns held with each document."""
    tune(docs.sparkSession)
    source = docs.select(F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("keep"), F.coalesce(quoted(text).cast("binary"), F.lit(b"")).alias("text"))
    schema = T.StructType([T.StructField("docs", T.ArrayType(source.schema["keep"].dataType))] + [T.StructField(k, T.BinaryType()) for k in ("first", "terms", "starts", "postings")] + [T.StructField("bits", T.IntegerType()), T.StructField("block", T.LongType())])
    want = arrow_schema(schema)

    def run(batches):
        block = TaskContext.get().partitionId() << 32  # of one stage, so no two blocks share a number
        for b in batches:
            data, offs = buffers(b.column(1))
            for i, j in blocks(offs, BLOCK):
                words, first = words_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                first = first + np.arange(len(first))  # one position is free after each document
                at = np.arange(len(words)) + np.repeat(np.arange(j - i), np.diff(first) - 1)
                bits = max(1, int(first[-1]).bit_length())
                low = np.uint64((1 << bits) - 1)
                keys = np.sort((words & ~low) | at.astype(np.uint64))
                terms, postings = keys >> np.uint64(bits), (keys & low).astype(np.uint32)
                starts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
                row = [b.column(0).slice(i, j - i), first.astype(np.uint32), terms[starts], starts.astype(np.uint32), postings]
                cell = row[0].cast(want.field("docs").type.value_type)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), cell).cast(want.field("docs").type), *[pa.array([x.tobytes()], f.type) for x, f in zip(row[1:], list(want)[1:5], strict=True)], pa.array([bits], pa.int32()), pa.array([block], pa.int64())], schema=want)
                block += 1

    source.mapInArrow(lean(run), schema).write.parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def windows(items: DataFrame, k: int, text: str = "text", key: str = "item_id") -> DataFrame:
    """Each distinct window of k consecutive item words (a shorter item is one): window (its hash), terms, items that have it."""
    tune(items.sparkSession)
    source = items.select(quoted(key).cast("string").alias("item"), F.coalesce(quoted(text).cast("binary"), F.lit(b"")).alias("text"))

    def run(batches):
        for b in batches:
            data, offs = buffers(b.column(1))
            for i, j in blocks(offs, BLOCK):
                words, first = words_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                h, at, pos = shingles(words, first, k)
                own = np.repeat(np.arange(j - i), np.diff(at))
                size = np.minimum(k, first[own + 1] - pos)
                terms = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(words[np.repeat(pos, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(own)), pa.array(h.view(np.int64)), terms], names=["item", "window", "terms"])

    return source.mapInArrow(lean(run), "item string, window long, terms array<long>").groupBy("window").agg(F.first("terms").alias("terms"), F.array_sort(F.collect_set("item")).alias("items"))


class Query:
    """Windows made ready for the blocks: distinct terms, and for each window its terms' numbers, places and length."""

    def __init__(self, rows):
        self.items = sorted({x for r in rows for x in r["items"]})
        number = {x: k for k, x in enumerate(self.items)}
        self.length = np.array([len(r["terms"]) for r in rows], np.int64)
        widest = int(self.length.max(initial=1))
        table_ = np.zeros((len(rows), widest), np.int64)
        for n, r in enumerate(rows):
            table_[n, : len(r["terms"])] = r["terms"]
        self.used = np.arange(widest) < self.length[:, None]
        self.terms, inverse = np.unique(table_.view(np.uint64), return_inverse=True)
        self.number = inverse.reshape(table_.shape)
        held = [[number[x] for x in r["items"]] for r in rows]
        self.item_at = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
        self.item_no = np.array([x for h in held for x in h], np.int64)

    def lists(self, terms, starts, total, bits):
        """Of each test term: the first of its postings in the block, and their number."""
        want = self.terms >> np.uint64(bits)
        at = np.minimum(np.searchsorted(terms, want), max(len(terms) - 1, 0))
        found = terms[at] == want if len(terms) else np.zeros(len(want), bool)
        ends = np.append(starts[1:], total)
        return np.where(found, starts[at] if len(terms) else 0, 0), np.where(found, ends[at] - starts[at] if len(terms) else 0, 0)


def expand(counts: np.ndarray):
    """Owner and place in it of each of counts' elements."""
    own = np.repeat(np.arange(len(counts)), counts)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)


def exact(q: Query, terms, starts, postings, bits):
    """Windows and positions of all exact occurrences: postings are intersected from each window's rarest term on."""
    begin, df = q.lists(terms, starts, len(postings), bits)
    counts = np.where(q.used, df[q.number], np.iinfo(np.int64).max)
    alive = np.flatnonzero((counts > 0).all(axis=1))
    if not len(alive):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(counts[alive], axis=1, kind="stable")
    rare = order[:, 0]
    own, place = expand(counts[alive, rare])
    window = alive[own]
    start = postings[begin[q.number[window, rare[own]]] + place].astype(np.int64) - rare[own]
    # postings as one ascending array of (list, position), in which an intersection is a search
    keys = (np.cumsum(np.bincount(starts, minlength=len(postings) + 1))[: len(postings)] - 1) << 32 | postings
    rank = np.searchsorted(starts, begin, side="right") - 1
    for j in range(1, order.shape[1]):
        col = order[own, j]
        inside = q.used[window, col]
        want = rank[q.number[window, col]] << 32 | np.maximum(start + col, 0)
        hit = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want
        ok = (hit & (start >= 0)) | ~inside
        own, window, start = own[ok], window[ok], start[ok]
    ok = start >= 0
    return window[ok], start[ok]


def near(q: Query, terms, starts, postings, bits, first, slop: int):
    """Windows and positions of their rarest term where every other term lies within slop words, in one document and any order."""
    begin, df = q.lists(terms, starts, len(postings), bits)
    counts = np.where(q.used, df[q.number], np.iinfo(np.int64).max)
    alive = np.flatnonzero((counts > 0).all(axis=1))
    if not len(alive):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(counts[alive], axis=1, kind="stable")
    own, place = expand(counts[alive, order[:, 0]])
    window = alive[own]
    anchor = postings[begin[q.number[window, order[own, 0]]] + place].astype(np.int64)
    doc = np.searchsorted(first, anchor, side="right") - 1
    low, high = np.maximum(anchor - slop, first[doc]), np.minimum(anchor + slop, first[doc + 1] - 2)
    keys = (np.cumsum(np.bincount(starts, minlength=len(postings) + 1))[: len(postings)] - 1) << 32 | postings
    rank = np.searchsorted(starts, begin, side="right") - 1
    ok = np.ones(len(own), bool)
    for j in range(1, order.shape[1]):
        col = order[own, j]
        term = rank[q.number[window, col]] << 32
        ok &= (np.searchsorted(keys, term | high, side="right") > np.searchsorted(keys, term | low)) | ~q.used[window, col]
    return window[ok], anchor[ok]


def _chunks(found: DataFrame):
    """Queries of at most CHUNK windows each; most test sets are one."""
    n = found.count()
    parts = max(1, -(-n // CHUNK))
    for k in range(parts):
        part = found if parts == 1 else found.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == k)
        yield Query(part.orderBy("window").collect())


def search(index: DataFrame, found: DataFrame, slop: int | None = None) -> DataFrame:
    """For each document of the index: keep (struct of the columns c0.. kept with it) and out (n_words, n_hit, items, contaminated).

    slop None: words inside exact occurrences are hit; else the anchors of proximity matches.
    """
    spark = index.sparkSession
    kept = index.schema["docs"].dataType.elementType
    raw = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("keep", kept), T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
    want = arrow_schema(raw)

    def over(shared, whole):
        """whole: all documents with their keep, else those that are hit, without it."""

        def run(batches):
            q = shared.value
            for b in batches:
                for r in range(b.num_rows):
                    first, terms, starts, postings = (np.frombuffer(b.column(k)[r].as_py(), t) for k, t in ((1, np.uint32), (2, np.uint64), (3, np.uint32), (4, np.uint32)))
                    first, starts, postings, bits = first.astype(np.int64), starts.astype(np.int64), postings.astype(np.int64), b.column(5)[r].as_py()
                    n = len(first) - 1
                    window, start = exact(q, terms, starts, postings, bits) if slop is None else near(q, terms, starts, postings, bits, first, slop)
                    doc = np.searchsorted(first, start, side="right") - 1
                    size = q.length[window] if slop is None else np.ones(len(window), np.int64)
                    own, place = expand(size)
                    hit = np.unique(np.stack([doc[own], start[own] + place - first[doc[own]]]), axis=1) if len(own) else np.zeros((2, 0), np.int64)
                    own, place = expand(q.item_at[window + 1] - q.item_at[window])
                    pair = np.unique(doc[own] * max(1, len(q.items)) + q.item_no[q.item_at[window[own]] + place]) if len(own) else np.zeros(0, np.int64)
                    who, what = pair // max(1, len(q.items)), pair % max(1, len(q.items))
                    ragged = lambda d, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(n + 1)), pa.int32()), values)
                    names = pa.array(q.items, pa.string()).take(pa.array(what)) if len(what) else pa.array([], pa.string())
                    keep = b.column(0)[r].values.cast(want.field("keep").type)
                    cols = [pa.array(np.full(n, b.column(6)[r].as_py())), pa.array(np.arange(n)), keep if whole else pa.nulls(n, keep.type), pa.array(np.diff(first) - 1), ragged(hit[0], pa.array(hit[1])), ragged(who, names)]
                    made = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, want, strict=True)], schema=want)
                    yield made if whole else made.take(pa.array(np.unique(hit[0])))

        return run

    frames = [index.mapInArrow(over(spark.sparkContext.broadcast(q), k == 0), raw) for k, q in enumerate(_chunks(found))]
    if len(frames) > 1:
        whole = reduce(DataFrame.unionByName, frames)
        made = whole.groupBy("block", "doc").agg(F.first("keep", ignorenulls=True).alias("keep"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    else:
        made = frames[0]
    return made.select("keep", F.struct(F.col("n_words"), F.size("hits").cast("long").alias("n_hit"), F.array_sort("items").alias("items"), (F.size("hits") > 0).alias("contaminated")).alias("out"))


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10, keep=("doc_id",)) -> DataFrame:
    return search(build(docs, shared_dir(spark, "postings"), keep=keep), windows(items, k))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("keep.c0").alias("doc_id"), "out.n_words", "out.n_hit", F.size("out.items").cast("long").alias("n_items"), F.sha2(F.array_join("out.items", ",").cast("binary"), 256).alias("items_sha256"), "out.contaminated")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts have no words and stay; items without words match nothing; repeated rows are judged alike, and a null doc_id like any
    other; an empty table gives none. Columns of any name come out as they were.
    """
    names = docs.columns
    found = decontaminate(spark, docs, table(spark, sf_dir, "benchmark"), keep=names)
    return unpacked(found.where("NOT out.contaminated"), names)


OP8_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(list_slice(ws, i, i + 9), ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit ON w.doc_id = hit.doc_id LEFT JOIN it ON w.doc_id = it.doc_id
"""

"""Ranked lexical search with block-max pruning over a distributed forward index.

``build`` writes the corpus as rows of whole documents in the shared folder, a shard each: its documents, its distinct
terms (64-bit hashes), the forward index (each document's terms and their occurrences, in document order), and for
every block of BLOCK documents and every term of it the maxima: the pairs (occurrences, document length) that no other
document of the block beats in both, so that the greatest share of a score is known exactly whatever the corpus'
totals turn out to be.

``search`` gets totals and document frequencies from the index, then

1. bounds every block for every query by its maxima alone, takes each query's SEED blocks of greatest bound in the whole
   corpus, scores them from the forward index, and so knows a score that the last result reaches at least;
2. takes all queries to every shard: its blocks are sorted by the query's bound and scored until the bound drops below
   the threshold, the greater of that score and of the task's own last result so far. A block whose bound equals the
   threshold is scored, as ties go by document number.

Each task keeps ``top`` results a query, so copies of one document that fill a third of the corpus make no larger groups; these
rows are cut again by salted groups, then by query. The corpus is never shuffled. Queries are sent in chunks of CHUNK
terms, which bounds what is collected and broadcast (a longer query is a chunk of its own); chunks search the same index
one after another.

Terms are named by hashes; with a million query terms and a thousand million in the corpus two meet by
chance with probability 1 in 10,000.

Edge cases: null and empty texts have no terms, count in no total and are never found; items without terms or
without a hit give no rows; rows of one item id are one query with all their terms; each document row is ranked by itself,
so repeated rows take neighbouring ranks; null document ids come last among equal scores; empty tables give no rows.
Ids of documents are integers.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import BIG_ROWS, arrow_schema, quoted, release, shared_dir, table, tune
from ._text import LOWER, NOT_ALNUM, blocks, buffers, spans_hash, sums, word_spans

#: Bytes of text of a shard, and documents of a block.
SHARD, BLOCK = 4 << 20, 64
#: Pairs of query and term that are sent to the executors at once.
CHUNK = 250_000
#: Blocks of greatest bound that set a query's first threshold.
SEED = 8
#: Groups of a query's results that are cut before they meet.
SALTS = 64
TOP = 50

FORWARD = ("keys", "lengths", "doc_at", "post_term", "post_tf")
MAXIMA = ("shard", "terms", "block_at", "max_term", "max_tf", "max_len")
SCHEMA = "shard long, keys array<long>, lengths binary, terms binary, df binary, doc_at binary, post_term binary, post_tf binary, block_at binary, max_term binary, max_tf binary, max_len binary, n_docs long, n_terms long"


def terms_of(data: np.ndarray, offs: np.ndarray):
    """Term hashes in order, and each document's first one's number."""
    starts, ends, first = word_spans(data, offs, NOT_ALNUM)
    return spans_hash(data, starts, ends, LOWER), first


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys."""
    change = np.ones(len(keys[0]), bool)
    if len(change):
        change[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(change)


def fronts(group: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of postings: the places of those that no other of their group beats with as many occurrences or more in as short a document or shorter, in order of group."""
    order = np.lexsort((-tf, length, group))
    first = runs(group[order])
    rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    best = np.maximum.accumulate(rank << 32 | tf[order])  # of this group, as later groups are greater
    new = np.ones(len(order), bool)
    new[1:] = best[1:] > best[:-1]
    return order[new]


def shard_of(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Forward index and block maxima of some documents."""
    words, first = terms_of(data, offs)
    n = len(offs) - 1
    terms, number = np.unique(words, return_inverse=True)
    key = np.sort(np.repeat(np.arange(n), np.diff(first)) << 32 | number)
    start = runs(key)
    doc, term, tf = key[start] >> 32, key[start] & 0xFFFFFFFF, np.diff(np.append(start, len(key)))
    lengths = np.diff(first)
    best = fronts((doc // BLOCK) << 32 | term, tf, lengths[doc])
    return {
        "lengths": lengths, "terms": terms, "df": np.bincount(term, minlength=len(terms)), "doc_at": np.searchsorted(doc, np.arange(n + 1)), "post_term": term, "post_tf": tf,
        "block_at": np.searchsorted(doc[best] // BLOCK, np.arange(-(-n // BLOCK) + 1)), "max_term": term[best], "max_tf": tf[best], "max_len": lengths[doc[best]],
    }


def build(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write the index of docs to path and read it again."""
    tune(docs.sparkSession)
    source = docs.select(quoted(key).cast("long").alias("key"), F.coalesce(quoted(text).cast("binary"), F.lit(b"")).alias("text"))
    schema = T._parse_datatype_string(SCHEMA)
    want = arrow_schema(schema)

    def run(batches):
        shard = TaskContext.get().partitionId() << 32  # of one stage, so no two shards share a number
        for b in batches:
            data, offs = buffers(b.column(1))
            for i, j in blocks(offs, SHARD):
                made = shard_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                cells = {k: pa.array([(x if k == "terms" else x.astype(np.uint32)).tobytes()], pa.binary()) for k, x in made.items()}
                cells |= {"shard": pa.array([shard]), "keys": pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column(0).slice(i, j - i))}
                cells |= {"n_docs": pa.array([int((made["lengths"] > 0).sum())]), "n_terms": pa.array([int(made["lengths"].sum())])}
                yield pa.RecordBatch.from_arrays([cells[f.name].cast(f.type) for f in want], schema=want)
                shard += 1
        release()

    source.mapInArrow(run, schema).write.options(compression="zstd", **BIG_ROWS).parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


class Queries:
    """A chunk of queries: their items, their terms' numbers and weights, and the corpus' totals."""

    def __init__(self, items: list, item_of: np.ndarray, terms: np.ndarray):
        self.items, order = items, np.argsort(item_of, kind="stable")
        self.terms, number = np.unique(terms, return_inverse=True)
        self.number, self.at = number[order], np.searchsorted(item_of[order], np.arange(len(items) + 1))

    def weigh(self, n: int, total: int, df: dict[int, int]) -> None:
        """n: documents with a term; total: their terms; df: documents that hold a term, by hash. A term of no document weighs nothing."""
        of_term = [math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) if d else 0 for d in (df.get(int(t), 0) for t in self.terms.view(np.int64))]
        self.weight, self.n, self.total = np.array(of_term, np.int64)[self.number], n, total

    def share(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a term of weight 1 adds to the score of a document of this length."""
        sizes, number = np.unique(length, return_inverse=True)
        m = np.array([50 + 50 * x * self.n // self.total for x in sizes.tolist()], np.int64)[number]
        return 1_000_000_000 * tf // (1000 * tf + 20 * m)

    def here(self, terms: np.ndarray) -> np.ndarray:
        """For each of a shard's terms its number here, or -1."""
        found = np.full(len(terms), -1, np.int64)
        if len(terms):
            at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
            hit = np.flatnonzero(terms[at] == self.terms)
            found[at[hit]] = hit
        return found

    def bounds(self, row: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, blocks and bounds over zero of a shard, by query, then from the greatest bound."""
        number = self.here(row["terms"])[row["max_term"]]
        block = np.repeat(np.arange(len(row["block_at"]) - 1), np.diff(row["block_at"]))
        keep = np.flatnonzero(number >= 0)
        if not len(keep):
            return (np.zeros(0, np.int64),) * 3
        number, block = number[keep], block[keep]
        share = self.share(row["max_tf"][keep], row["max_len"][keep])
        start = runs(number, block)
        number, block, share = number[start], block[start], np.maximum.reduceat(share, start)
        order = np.argsort(number, kind="stable")
        lists = np.searchsorted(number[order], np.arange(len(self.terms) + 1))
        n_blocks, out = len(row["block_at"]) - 1, []
        for q in range(len(self.items)):
            of = slice(self.at[q], self.at[q + 1])
            a, b = lists[self.number[of]], lists[self.number[of] + 1]
            size = b - a
            if not size.any():
                continue
            entry = order[np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())]
            total = np.zeros(n_blocks, np.int64)
            np.add.at(total, block[entry], np.repeat(self.weight[of], size) * share[entry])
            by = np.lexsort((np.arange(n_blocks), -total))[: int((total > 0).sum())]
            out.append((np.full(len(by), q), by, total[by]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


class Forward:
    """The postings of a shard whose terms are in some query, in order of document."""

    def __init__(self, queries: Queries, row: dict[str, np.ndarray]):
        self.queries, self.keys = queries, row["keys"]
        number = queries.here(row["terms"])[row["post_term"]]
        keep = np.flatnonzero(number >= 0)
        doc = np.repeat(np.arange(len(row["lengths"])), np.diff(row["doc_at"]))[keep]
        self.number, self.share = number[keep], queries.share(row["post_tf"][keep], row["lengths"][doc])
        self.at = np.searchsorted(doc, np.arange(len(row["lengths"]) + 1))
        self.weight = np.zeros(len(queries.terms), np.int64)

    def scores(self, q: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents' numbers in the shard and scores of a block for the query."""
        of = slice(self.queries.at[q], self.queries.at[q + 1])
        self.weight[self.queries.number[of]] = self.queries.weight[of]
        at = self.at[block * BLOCK : (block + 1) * BLOCK + 1]
        part = slice(at[0], at[-1])
        score = sums(self.weight[self.number[part]] * self.share[part], at - at[0])
        self.weight[self.queries.number[of]] = 0
        return np.arange(block * BLOCK, block * BLOCK + len(score)), score


class Best:
    """The best results of each query so far: scores and keys (null keys as the greatest number), the best first."""

    def __init__(self, n: int, top: int, least: np.ndarray):
        self.top, self.least = top, least.copy()
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(n)]

    def add(self, q: int, score: np.ndarray, key: np.ndarray) -> None:
        good = (score > 0) & (score >= self.least[q])
        if not good.any():
            return
        score, key = np.concatenate([self.held[q][0], score[good]]), np.concatenate([self.held[q][1], key[good]])
        order = np.lexsort((key, -score))[: self.top]
        self.held[q] = score[order], key[order]
        if len(order) == self.top:
            self.least[q] = max(self.least[q], score[order[-1]])


NULL_KEY = np.iinfo(np.int64).max


def search_shard(queries: Queries, row: dict[str, np.ndarray], best: Best) -> int:
    """Scores a shard's blocks, each query's from its greatest bound until that drops below its threshold; returns how many were scored."""
    who, block, bound = queries.bounds(row)
    if not len(who):
        return 0
    forward, scored = Forward(queries, row), 0
    for a, b in zip(start := runs(who), np.append(start[1:], len(who)), strict=True):
        q = int(who[a])
        for k in range(a, b):
            if bound[k] < best.least[q]:
                break
            doc, score = forward.scores(q, int(block[k]))
            best.add(q, score, forward.keys[doc])
            scored += 1
    return scored


def _rows(batches):
    """Index rows as arrays by column."""
    for b in batches:
        for r in range(b.num_rows):
            row = {}
            for name, column in zip(b.schema.names, b.columns, strict=True):
                x = column[r]
                if name == "keys":
                    row[name] = x.values.fill_null(NULL_KEY).to_numpy(zero_copy_only=False)
                elif isinstance(x, pa.BinaryScalar):
                    row[name] = np.frombuffer(x.as_py(), np.uint64 if name == "terms" else np.uint32)
                    row[name] = row[name] if name == "terms" else row[name].astype(np.int64)
                else:
                    row[name] = x.as_py()
            yield row


def query_terms(items: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """Distinct pairs of item and term hash."""
    tune(items.sparkSession)
    source = items.select(quoted(key).alias("item"), F.coalesce(quoted(text).cast("binary"), F.lit(b"")).alias("text"))
    schema = T.StructType([source.schema["item"], T.StructField("term", T.LongType())])

    def run(batches):
        for b in batches:
            data, offs = buffers(b.column(1))
            for i, j in blocks(offs, SHARD):
                words, first = terms_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                own = np.repeat(np.arange(j - i), np.diff(first))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(own)), pa.array(words.view(np.int64))], schema=arrow_schema(schema))

    return source.mapInArrow(run, schema).distinct()


def _chunks(pairs: DataFrame):
    """Queries of about CHUNK pairs each; items stay whole."""
    parts = max(1, -(-pairs.count() // CHUNK))
    for k in range(parts):
        part = pairs if parts == 1 else pairs.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k)
        got = part.orderBy("item", "term").toArrow()
        items = got.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
        yield Queries(items.dictionary, items.indices.to_numpy(), got.column("term").to_numpy().view(np.uint64))


def frequencies(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Documents that hold each of the terms (a chunk's, and so bounded), by hash."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        want = shared.value
        total = np.zeros(len(want), np.int64)
        for row in _rows(batches):
            if len(row["terms"]):
                at = np.minimum(np.searchsorted(row["terms"], want), len(row["terms"]) - 1)
                total += np.where(row["terms"][at] == want, row["df"][at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(want[some].view(np.int64)), pa.array(total[some])], names=["term", "df"])

    found = index.select("terms", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    return dict(zip(found.column("term").to_pylist(), found.column("df").to_pylist(), strict=True))


def thresholds(index: DataFrame, shared, n: int, top: int) -> np.ndarray:
    """For each query a score that its last result reaches at least, from the SEED blocks of greatest bound; 0 where these hold fewer results."""

    def bounded(batches):
        queries, kept = shared.value, np.zeros((4, 0), np.int64)
        for row in _rows(batches):
            who, block, bound = queries.bounds(row)
            kept = np.concatenate([kept, np.stack([who, bound, np.full(len(who), row["shard"]), block])], axis=1)
            order = np.lexsort((kept[3], kept[2], -kept[1], kept[0]))
            kept = kept[:, order]
            place = np.arange(len(order)) - np.searchsorted(kept[0], kept[0])
            kept = kept[:, place < SEED]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], names=["query", "bound", "shard", "block"])

    def scored(batches):
        queries, best = shared.value, Best(n, top, np.zeros(n, np.int64))
        for b in batches:
            wanted = b.column(b.schema.get_field_index("wanted"))
            for r, row in enumerate(_rows([b.drop_columns(["wanted"])])):
                forward = Forward(queries, row)
                for w in wanted[r].as_py():
                    doc, score = forward.scores(w["query"], w["block"])
                    best.add(w["query"], score, forward.keys[doc])
        scores = [s for s, _ in best.held]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n), [len(s) for s in scores])), pa.array(np.concatenate([np.zeros(0, np.int64), *scores]))], names=["query", "score"])

    by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), "shard", "block")
    seeds = index.select(*MAXIMA).mapInArrow(bounded, "query long, bound long, shard long, block long").withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= SEED)
    wanted = seeds.groupBy("shard").agg(F.collect_list(F.struct("query", "block")).alias("wanted"))  # SEED blocks a query of one chunk
    joined = index.select("shard", "terms", *FORWARD).join(F.broadcast(wanted), "shard").drop("shard")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"))
    last = joined.mapInArrow(scored, "query long, score long").withColumn("place", F.row_number().over(by_score)).where(F.col("place") == top).toArrow()
    least = np.zeros(n, np.int64)
    least[last.column("query").to_numpy()] = last.column("score").to_numpy()
    return least


def search(index: DataFrame, items: DataFrame, top: int = TOP, text: str = "text", key: str = "item_id") -> DataFrame:
    """Each item's best documents: item, rank (from 1), doc (the document's key) and score."""
    spark, pairs = index.sparkSession, query_terms(items, text, key)
    totals = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    schema = T.StructType([pairs.schema["item"], T.StructField("score", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("salt", T.IntegerType())])
    want, frames = arrow_schema(schema), []

    def over(shared, least):
        def run(batches):
            queries = shared.value
            best = Best(len(queries.items), top, least.value)
            for row in _rows(batches):
                search_shard(queries, row, best)
            size = [len(s) for s, _ in best.held]
            score, doc = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*best.held, strict=True)) if best.held else (np.zeros(0, np.int64),) * 2
            who = queries.items.take(pa.array(np.repeat(np.arange(len(size)), size).astype(np.int64)))
            salt = pa.array(np.full(len(score), TaskContext.get().partitionId() % SALTS, np.int32))
            yield pa.RecordBatch.from_arrays([who.cast(want.field("item").type), pa.array(score), pa.array(doc, mask=doc == NULL_KEY), salt], schema=want)
            release()

        return run

    for queries in _chunks(pairs):
        queries.weigh(*totals, frequencies(index, queries.terms))
        shared = spark.sparkContext.broadcast(queries)
        least = spark.sparkContext.broadcast(thresholds(index, shared, len(queries.items), top))
        frames.append(index.select("terms", *FORWARD, *MAXIMA[2:]).mapInArrow(over(shared, least), schema))
    made = reduce(DataFrame.unionByName, frames)
    order = (F.desc("score"), F.asc_nulls_last("doc"))
    for by in (("item", "salt"), ("item",)):
        made = made.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return made.select("item", "rank", "doc", "score")


def op13_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(table(spark, sf_dir, "documents"), shared_dir(spark, "forward"))
    return search(index, table(spark, sf_dir, "benchmark")).select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


OP13_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM t WHERE len(ws) > 0),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(ws)::BIGINT AS n, unnest(ws) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
s AS (SELECT q.item_id, tf.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (100 - 50 + (50 * tf.n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), total GROUP BY q.item_id, tf.doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""

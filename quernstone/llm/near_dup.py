"""MinHash near-dedup with HyperMinHash sketches, exact verification and components.

A document's set of word shingles is hashed; each of 1024 buckets keeps the position of the
first one bit of its smallest hash and the four bits after it (a byte a register). Empty
buckets borrow from a filled one by a fixed probing order. Bands of six registers
retrieve candidates; the share of equal registers, corrected for chance collisions of
the compressed registers, must come near the threshold before full sets are compared.

Plan, from all rows to the few that matter:

1. rows with equal sets become one class (pre-aggregated, so copies of a third of the
   rows cost one row a task);
2. each band bucket links its members to its smallest one (never all pairs); links are
   confirmed on full sets and components found;
3. only buckets that still hold several components are searched again, between their
   components and in blocks of bounded size; what the estimate leaves is confirmed.

No partner or candidate is capped. With threshold 0.8 a link escapes all 42 bands with
probability below (1 - 0.8**6)**42 = 3e-6, and the estimate with that of 4.5 standard deviations.

Edge cases: null and empty texts have no shingles and stay alone; a text of fewer words is
one shingle; a null doc_id counts as larger than all others; rows that share a
doc_id are documents of their own.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import discard, lean, map_text, quoted, recorded, stored, table, tune, unpacked
from ._text import LOWER, SPACE, blocks, mix, shingles, spans_hash, word_spans

REGISTERS, BITS = 1024, 10
BANDS, ROWS = 42, 6
#: A register is a byte: leading zeros (15 at most) and mantissa bits.
ZEROS, MANTISSA = 15, 4
#: Members of a bucket that are compared in one piece.
PIECE = 2000
#: Classes whose keys are broadcast to fetch their sets; beyond it they are joined.
BROADCAST_ROWS = 1_000_000


def _sets(data, offs, k: int):
    """Distinct shingle hashes of each document, ascending, and their borders."""
    starts, ends, first = word_spans(data, offs, SPACE)
    h, at, _ = shingles(spans_hash(data, starts, ends, LOWER), first, k)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[i:j].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[at[:-1][np.diff(at) > 0]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[at]


def _names(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A 128-bit name of each set."""
    sums = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(seed)))])
        sums.append(mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)))
    both = np.stack(sums, axis=1)
    return [row.tobytes() for row in both]


@lru_cache(256)
def _probe(step: int) -> np.ndarray:
    """For each bucket the one that it borrows from at a step, if that is filled."""
    return (mix(np.arange(REGISTERS, dtype=np.uint64) * np.uint64(1000003) + np.uint64(step)) % np.uint64(REGISTERS)).astype(np.int64)


def registers(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of each set, one row a document; those of empty sets are 0."""
    n = len(at) - 1
    own = np.repeat(np.arange(n), np.diff(at))
    cell = own * REGISTERS + (h >> np.uint64(64 - BITS)).astype(np.int64)
    first = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(h) else np.zeros(0, bool)
    # the rest of the hash, of which 52 bits are read
    value = (h[first] << np.uint64(BITS)) >> np.uint64(12)
    exponent = np.frexp(value.astype(np.float64))[1]
    mantissa = np.where(exponent > MANTISSA, (value >> np.maximum(exponent - 1 - MANTISSA, 0).astype(np.uint64)) & np.uint64(2**MANTISSA - 1), value & np.uint64(2**MANTISSA - 1))
    out = np.zeros(n * REGISTERS, np.uint8)
    full = np.zeros(n * REGISTERS, bool)
    out[cell[first]] = (np.minimum(52 - exponent, ZEROS).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint8)
    full[cell[first]] = True
    todo = np.flatnonzero(~full & np.repeat(np.diff(at) > 0, REGISTERS))
    step = 1
    while len(todo):
        ask = (todo & ~(REGISTERS - 1)) + _probe(step)[todo & (REGISTERS - 1)]
        ok = full[ask]
        out[todo[ok]] = out[ask[ok]]
        todo = todo[~ok]
        step += 1
    return out.reshape(n, REGISTERS)


def chance(n_a, n_b) -> np.ndarray:
    """Probability that registers of unrelated sets of these sizes are equal."""
    k = np.arange(1, ZEROS + 2)
    reach = lambda n: 1 - (1 - np.append(2.0 ** -np.arange(0, ZEROS + 1), 0)) ** np.maximum(np.asarray(n, float)[:, None] / REGISTERS, 1)
    a, b = reach(n_a), reach(n_b)
    return ((a[:, k - 1] - a[:, k]) * (b[:, k - 1] - b[:, k])).sum(axis=1) * 2.0**-MANTISSA


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for collisions."""
    c = chance(n_a, n_b)
    return (equal - c) / (1 - c)


def _slack(threshold: float) -> float:
    return threshold - 4.5 * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def _plausible(regs_a, regs_b, n_a, n_b, threshold: float) -> np.ndarray:
    size = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9
    out = np.zeros(len(size), bool)
    at = np.flatnonzero(size)
    for i in range(0, len(at), 4096):
        p = at[i : i + 4096]
        out[p] = estimate((regs_a[p] == regs_b[p]).mean(axis=1), n_a[p], n_b[p]) >= _slack(threshold)
    return out


def sketch(docs: DataFrame, k: int = 4, text: str = "text", keep=("doc_id",), flat: bool = True) -> DataFrame:
    """The columns of keep, and out: name (of the shingle set), n_shingles, registers."""

    def run(data, offs):
        names, sizes, regs = [], [], []
        for i, j in blocks(offs, 1 << 18):
            h, at = _sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
            names += _names(h, at)
            sizes.append(np.diff(at))
            r = registers(h, at)
            regs += [x.tobytes() for x in r]
        return [pa.array(names, pa.binary()), np.concatenate(sizes), pa.array(regs, pa.binary())]

    return map_text(docs, run, "name binary, n_shingles long, registers binary", text, keep, flat)


def named(docs: DataFrame, k: int, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """keep (struct), and out: the name of each document's shingle set, and n, its size, as sketch() has them."""

    def run(data, offs):
        names, sizes = [], []
        for i, j in blocks(offs, 1 << 18):
            h, at = _sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
            names += _names(h, at)
            sizes.append(np.diff(at))
        return [pa.array(names, pa.binary()), np.concatenate(sizes)]

    return map_text(docs, run, "name binary, n long", text, keep, flat=False)


def _matrix(column) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(-1, REGISTERS)


def bands(classes: DataFrame) -> DataFrame:
    """key, id: a row for each class and band."""

    def run(batches):
        from ._text import BASE, powers

        for b in batches:
            m = _matrix(b.column(1))[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = mix((m * powers(ROWS, BASE)).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))], names=["key", "id"])

    return classes.select("id", "registers").mapInArrow(lean(run), "key long, id long")


def _passing(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of class ids whose sizes and estimate allow the threshold."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("registers").alias(f"r_{c}"), F.col("n_shingles").alias(f"n_{c}"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                t = dict(zip(b.schema.names, b.columns, strict=True))
                ok = _plausible(_matrix(t["r_a"]), _matrix(t["r_b"]), t["n_a"].to_numpy(), t["n_b"].to_numpy(), threshold)
                yield pa.RecordBatch.from_arrays([t["a"], t["b"]], names=["a", "b"]).filter(pa.array(ok))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lean(run), "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("members").alias(f"s_{c}"))
    percent = round(100 * threshold)

    def run(batches):
        for b in batches:
            t = dict(zip(b.schema.names, b.columns, strict=True))
            ok = np.zeros(b.num_rows, bool)
            for k in range(b.num_rows):
                x, y = (np.frombuffer(t[c][k].as_buffer(), np.uint64) for c in ("s_a", "s_b"))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok[k] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([t["a"], t["b"]], names=["a", "b"]).filter(pa.array(ok))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lean(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, label: the smallest id of each linked id's component.

    Each round every vertex points to its smallest neighbour, pointers are jumped, and edges are drawn anew
    between what they point to; edges within a component vanish, so each round has fewer.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("to")), "points")
        for _ in range(3):
            jump = points.select(F.col("id").alias("to"), F.col("to").alias("far"))
            points = points.join(jump, "to").select("id", F.col("far").alias("to"))
        points = stored(points, "points")
        if labels is None:
            labels = points.select("id", F.col("to").alias("label"))
        else:
            labels = labels.join(points.select(F.col("id").alias("label"), "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        labels = stored(labels, "labels")
        end = lambda c: points.select(F.col("id").alias(c), F.col("to").alias(f"to_{c}"))  # noqa: E731,B023
        drawn = edges.join(end("a"), "a").join(end("b"), "b").where("to_a <> to_b")
        edges = stored(drawn.select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("label"))


def _between(members: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Plausible pairs (a, b) of members (key, id, label) that share a bucket but no label; each pair once.

    A bucket of more than PIECE members is cut into pieces, and each pair of pieces compared by itself.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces"))
    rows = members.join(sizes, "key").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    pairs_of = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda j: F.struct(F.least(j, F.col("piece")).alias("p"), F.greatest(j, F.col("piece")).alias("q")))
    rows = rows.select("key", "id", "label", "piece", F.explode(pairs_of).alias("cell")).select("key", "cell.p", "cell.q", "piece", "id", "label")
    rows = rows.join(classes.select("id", "n_shingles", "registers"), "id").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "piece", "id").select("key", "p", "q", "piece", "id", "label", "n_shingles", "registers")

    def run(batches):
        rest = None
        for b in _last(batches):
            if b is not None:
                rest = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if rest is None or not rest.num_rows:
                continue
            keys = np.stack([rest.column(c).to_numpy() for c in ("key", "p", "q")])
            new = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            if b is not None and len(new) == 1:
                continue
            upto = len(new) - (b is not None)
            borders = np.append(new, rest.num_rows)
            out_a, out_b = [], []
            for g in range(upto):
                part = rest.slice(borders[g], borders[g + 1] - borders[g])
                p, q = part.column("p")[0].as_py(), part.column("q")[0].as_py()
                piece, ids, label, n = (part.column(c).to_numpy() for c in ("piece", "id", "label", "n_shingles"))
                m = _matrix(part.column("registers").combine_chunks())
                split = int((piece == p).sum()) if p != q else len(ids)
                for i in range(split):
                    other = np.arange(split, len(ids)) if p != q else np.arange(i + 1, len(ids))
                    other = other[label[other] != label[i]]
                    if not len(other):
                        continue
                    other = other[_plausible(np.broadcast_to(m[i], (len(other), REGISTERS)), m[other], np.full(len(other), n[i]), n[other], threshold)]
                    if len(other):
                        # of the bands that two classes share, the first one gives the pair
                        same = (m[other][:, : BANDS * ROWS] == m[i][: BANDS * ROWS]).reshape(-1, BANDS, ROWS).all(axis=2)
                        lead = same.argmax(axis=1)
                        other = other[_keys(m[i], lead) == part.column("key")[0].as_py()]
                        out_a.append(np.minimum(ids[i], ids[other]))
                        out_b.append(np.maximum(ids[i], ids[other]))
            rest = rest.slice(borders[upto]) if upto < len(new) else None
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return rows.mapInArrow(lean(run), "a long, b long")


def _last(batches):
    yield from batches
    yield None


def _keys(regs: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Bucket keys of a class in the given bands, as bands() makes them."""
    from ._text import BASE, powers

    m = regs[: BANDS * ROWS].reshape(BANDS, ROWS)[band].astype(np.uint64)
    return mix((m * powers(ROWS, BASE)).sum(axis=1, dtype=np.uint64) + band.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int, text: str, key: str) -> DataFrame:
    """id, members (ascending 64-bit shingle hashes) of the classes wanted (id, name, doc)."""
    small = wanted.count() <= BROADCAST_ROWS
    doc = F.coalesce(quoted(key).cast("string"), F.lit("null"))
    keys = wanted.select(F.coalesce(F.col("doc").cast("string"), F.lit("null")).alias("doc")).distinct()
    some = docs.select(doc.alias("doc"), quoted(text).alias("text")).join(F.broadcast(keys) if small else keys, "doc", "left_semi")

    def run(data, offs):
        names, sets = [], []
        for i, j in blocks(offs, 1 << 18):
            h, at = _sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
            names += _names(h, at)
            sets += [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        return [pa.array(names, pa.binary()), pa.array(sets, pa.binary())]

    made = map_text(some, run, "name binary, members binary", keep=("doc",))
    return made.select("out.*").join(wanted.select("id", "name"), "name").groupBy("id").agg(F.first("members").alias("members"))


def grouped(spark: SparkSession, docs: DataFrame, k: int = 4, threshold: float = 0.8, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """rows (key as c0, name, n_shingles: one a document) and classes (name, doc: smallest key, id, component: smallest key of its component, stands: name of the class that stands for the component). What else is written on the way is removed."""
    tune(spark)
    with recorded() as made:
        rows, classes = _grouped(docs, k, threshold, text, key)
    rows, classes = stored(rows, "names"), stored(classes, "components")
    discard(spark, *made)
    return rows, classes


def _grouped(docs: DataFrame, k: int, threshold: float, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    rows = stored(sketch(docs, k, text, (key,)).select(quoted(key).alias("c0"), "out.*"), "sketches")
    classes = stored(
        rows.where("n_shingles > 0").groupBy("name").agg(F.min("c0").alias("doc"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")).withColumn("id", F.monotonically_increasing_id()), "classes"
    )
    cells = bands(classes)
    shared = cells.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = stored(cells.join(shared, "key"), "members")
    few = classes.join(members.select("id").distinct(), "id", "left_semi")
    few = stored(few, "members")
    sets = stored(_full_sets(docs, few.select("id", "name", "doc"), k, text, key), "sets")
    stars = members.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    links = stored(_confirmed(_passing(stars, few, threshold), sets, threshold), "links")
    labels = components(links)
    placed = stored(members.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label")), "placed")
    more = _confirmed(_between(placed, few, threshold), sets, threshold)
    labels = components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(more))
    full = classes.select("name", "doc", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    joint = full.join(labels.select("label").distinct(), "label", "left_semi").groupBy("label").agg(F.min("doc").alias("component"), F.min_by("name", F.struct(F.col("doc").isNull(), "doc", "name")).alias("stands"))
    return rows.drop("registers"), full.join(joint, "label", "left").select("name", "doc", "id", F.when(F.col("stands").isNull(), F.col("doc")).otherwise(F.col("component")).alias("component"), F.coalesce("stands", "name").alias("stands"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, classes = grouped(spark, table(spark, sf_dir, "documents"))
    whole = rows.join(classes.select("name", "component"), "name", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("c0"))
    return whole.select(F.col("c0").alias("doc_id"), "n_shingles", component.alias("component_id"), F.col("c0").eqNullSafe(component).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest doc_id (and of rows that repeat it, one).

    Documents without words, null texts among them, all stay; a null doc_id counts as larger than others; an empty table stays
    empty. Columns of any name come out as they were.
    """
    names = docs.columns
    _, classes = grouped(spark, docs, k=5)
    stay = classes.where(F.col("name") == F.col("stands")).select(F.col("name").alias("stay_name"), F.col("doc").alias("stay_doc"))
    own = named(docs, 5, keep=names).select("keep", F.col("out.name").alias("name"), F.col("out.n").alias("n"))
    doc = F.col(f"keep.c{names.index('doc_id')}")
    found = own.where("n > 0").join(stay, (F.col("name") == F.col("stay_name")) & doc.eqNullSafe(F.col("stay_doc")))
    one = found.groupBy("name").agg(F.first("keep").alias("keep")).select("keep").unionByName(own.where("n = 0").select("keep"))
    return unpacked(one, names)


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = w.doc_id
"""

"""Centroid clustering of whole-number vectors with Exponion search.

Vectors are written once, in blocks, as a table bucketed by block; each round writes what it knows of them (the number
of the centroid, an upper bound of the distance to it and a lower bound of the distance to any other) as a second,
small table bucketed alike, so that the next round joins the two bucket by bucket: no vector is shuffled or written again, and a lost
executor's bucket is read anew. Folders of rounds gone by are removed.

A round moves the bounds by how far the centroids went. A vector whose upper bound lies under its lower bound, or under half the
distance from its centroid to the nearest other one, keeps it. The others measure the distance to their own centroid
and, unless that settles it, to the centroids within the ball of radius twice this distance plus the distance to the nearest
other centroid around their own: it holds the nearest and the second nearest. A list of the other centroids by distance
gives the ball as a prefix. The radius is inclusive and bounds have some slack, so ties are seen; they go to the smaller number.
Squared distances are exact 64-bit integers.

Blocks report the sums of the vectors that changed centroid; the driver holds sums and counts, and broadcasts centroids and
their distances, which the number of centroids bounds, whatever the corpus. Centroids become exact floors of sum by count.

Edge cases: rows whose vector is null, of another length, or holds a null or no finite number are left out; components
beyond 2**26 after scaling raise; repeated rows are vectors of their own; with fewer vectors than centroids there are as many centroids
as vectors; an empty table gives no rows; a null key is named as an empty text when the first centroids are chosen.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import arrow_schema, discard, quoted, release, shared_dir, stored, table, tune

#: Vectors of a bucket, and Spark's bound of buckets.
PER_BUCKET, MOST_BUCKETS = 1 << 18, 100_000
#: Greatest component: squared distances of up to 64 components stay within 64 bits.
GREATEST = 1 << 26
FAR = np.iinfo(np.int64).max
CLUSTERS, ROUNDS, COMPONENTS, SCALE = 8, 10, 64, 1024


def slack(x):
    """More than rounding can take from a bound of this size."""
    return 1e-12 * x + 1e-6


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Centers:
    """Centroids, for each the others by distance, and how far each came in the last round."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        k = len(at)
        self.at = at
        apart = np.sqrt(np.array([squared(np.broadcast_to(c, at.shape), at) for c in at], np.float64))
        np.fill_diagonal(apart, np.inf)
        self.order = np.argsort(apart, axis=1, kind="stable")[:, : k - 1]
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.nearest = self.apart[:, 0] if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else np.sqrt(squared(before, at).astype(np.float64))
        by = np.argsort(-self.moved, kind="stable")
        self.most_of_others = np.full(k, self.moved[by[0]])
        self.most_of_others[by[0]] = self.moved[by[1]] if k > 1 else 0.0


def assign(x: np.ndarray, centers: Centers, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """One round for vectors x: changes own, upper and lower in place; returns how many distances were measured."""
    upper += centers.moved[own] + slack(upper)
    lower -= centers.most_of_others[own] + slack(np.abs(lower))
    todo = np.flatnonzero(upper >= np.maximum(lower, centers.nearest[own] / 2))
    if not len(todo):
        return 0
    exact = squared(x[todo], centers.at[own[todo]])
    upper[todo] = np.sqrt(exact) + slack(np.sqrt(exact))
    left = upper[todo] >= np.maximum(lower[todo], centers.nearest[own[todo]] / 2)
    measured, todo, exact = len(todo), todo[left], exact[left]
    radius = 2 * upper[todo] + centers.nearest[own[todo]]
    radius += slack(radius)
    order = np.argsort(own[todo], kind="stable")
    there, cut = np.unique(own[todo][order], return_index=True)
    for j, part in zip(there.tolist(), np.split(order, cut[1:]) if len(order) else [], strict=True):
        reach = np.searchsorted(centers.apart[j], radius[part], side="right")
        part = part[np.argsort(-reach, kind="stable")]
        reach = np.sort(reach)  # ascending, to count those that go on
        rows, best, second, to = todo[part], exact[part].copy(), np.full(len(part), FAR), np.full(len(part), j)
        for t in range(int(reach[-1])):
            n = len(part) - int(np.searchsorted(reach, t, side="right"))
            c = int(centers.order[j, t])
            d = squared(x[rows[:n]], centers.at[c])
            nearer = (d < best[:n]) | ((d == best[:n]) & (c < to[:n]))
            second[:n] = np.where(nearer, best[:n], np.minimum(second[:n], d))
            best[:n], to[:n] = np.where(nearer, d, best[:n]), np.where(nearer, c, to[:n])
            measured += n
        own[rows] = to
        upper[rows] = np.sqrt(best) + slack(np.sqrt(best))
        lower[rows] = np.sqrt(second) - slack(np.sqrt(second))
    return measured


def changes(x: np.ndarray, own: np.ndarray, before: np.ndarray | None):
    """Centroids that gained or lost vectors, and for each the change of its components' sums and of its count."""
    moved = np.ones(len(own), bool) if before is None else own != before
    x = np.column_stack([x[moved], np.ones(int(moved.sum()), np.int64)])
    who, x = (own[moved], x) if before is None else (np.concatenate([own[moved], before[moved]]), np.concatenate([x, -x]))
    if not len(who):
        return who, x
    order = np.argsort(who, kind="stable")
    there, cut = np.unique(who[order], return_index=True)
    return there, np.add.reduceat(x[order], cut, axis=0)


def kept(vectors: DataFrame, vec: str, components: int) -> DataFrame:
    v = quoted(vec)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) == components) & good)


class Rounds:
    """The tables of one run: vectors by block, and what is known of them, bucketed alike."""

    def __init__(self, vectors: DataFrame, key: str, vec: str, components: int, scale: int):
        spark = self.spark = tune(vectors.sparkSession)
        n, least = vectors.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets, self.tables = min(MOST_BUCKETS, max(least, n // PER_BUCKET)), {}
        source = kept(vectors, vec, components).select(quoted(key).alias("key"), quoted(vec).alias("vec"))
        schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(source.schema["key"].dataType)), T.StructField("vectors", T.BinaryType()), T.StructField("width", T.IntegerType())])
        want = arrow_schema(schema)

        def pack(batches):
            block = TaskContext.get().partitionId() << 32  # of one stage, so no two blocks share a number
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.floor(scale * b.column(1).flatten().to_numpy().astype(np.float64))
                most = np.abs(x).max()
                if most > GREATEST:
                    raise ValueError(f"a component is {most:.6g} times 1/{scale}; {GREATEST} is the greatest")
                width = 2 if most < 1 << 15 else 4
                keys = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
                cells = [pa.array([block]), keys, pa.array([x.astype(f"<i{width}").tobytes()], pa.binary()), pa.array([width])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cells, want, strict=True)], schema=want)
                block += 1
            release()

        self.vectors = self.write(source.mapInArrow(pack, schema).repartition(self.buckets, "block"), "vectors")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table in the shared folder, bucketed by block."""
        held, path = self.tables[name] = f"quernstone_{name}_{uuid.uuid4().hex}", shared_dir(self.spark, name)
        df.write.bucketBy(self.buckets, "block").option("path", path).saveAsTable(held)
        return self.spark.table(held)

    def drop(self, name: str) -> None:
        """The table and its folder."""
        held, path = self.tables.pop(name)
        self.spark.sql(f"DROP TABLE {held}")
        discard(self.spark, path)

    def blocks(self, known: DataFrame | None) -> DataFrame:
        """Blocks with what is known of them; equal buckets meet, and the vectors pass by a table of the small side."""
        return self.vectors if known is None else self.vectors.join(known.select("block", "known").hint("shuffle_hash"), "block")


def _vectors(row, components: int) -> np.ndarray:
    return np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(-1, components).astype(np.int64)


def _round(x: np.ndarray, centers: Centers, known: bytes | None):
    """own, upper and lower after a round, and own before (None in the first round)."""
    n = len(x)
    if known is None:
        own, lower = np.zeros(n, np.int64), np.zeros(n)
        upper = np.sqrt(squared(x, centers.at[own]).astype(np.float64))
        before = None
    else:
        before = np.frombuffer(known, np.int32, n).astype(np.int64)
        own, upper, lower = before.copy(), np.frombuffer(known, np.float64, n, 4 * n).copy(), np.frombuffer(known, np.float64, n, 12 * n).copy()
    assign(x, centers, own, upper, lower)
    return own, upper, lower, before


def first_centroids(vectors: DataFrame, key: str, vec: str, components: int, scale: int, k: int, seed: str) -> np.ndarray:
    """The k kept vectors of least SHA-256 of seed and key; equal ones by key, then by components."""
    whole = F.transform(quoted(vec), lambda x: F.floor(x.cast("double") * scale))
    name = F.sha2(F.concat(F.lit(seed), F.coalesce(quoted(key).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept(vectors, vec, components).select(name.alias("name"), quoted(key).cast("string").alias("key"), whole.alias("whole")).orderBy("name", "key", "whole").limit(k).collect()
    return np.array([r.whole for r in rows], np.int64).reshape(-1, components)


def cluster(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "3:") -> tuple[DataFrame, np.ndarray]:
    """Each kept row's key, cluster and squared distance, and the centroids."""
    spark, at = vectors.sparkSession, first_centroids(vectors, key, vec, components, scale, k, seed)
    made = T.StructType([T.StructField("key", vectors.schema[key].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not len(at):
        return spark.createDataFrame([], made), at
    tables = Rounds(vectors, key, vec, components, scale)
    names = ["block", "vectors", "width"]

    def over(shared):
        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    x = _vectors(row, components)
                    own, upper, lower, before = _round(x, shared.value, row.get("known"))
                    who, change = changes(x, own, before)
                    known = own.astype(np.int32).tobytes() + upper.tobytes() + lower.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([known], pa.binary()), pa.array([who.astype(np.int32).tobytes()], pa.binary()), pa.array([change.tobytes()], pa.binary())], names=["block", "known", "who", "change"])
            release()

        return run

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for who, change in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for c, x in zip(np.frombuffer(who, np.int32).tolist(), np.frombuffer(change, np.int64).reshape(-1, components + 1), strict=True):
                    sums[c] = sums[c] + x if c in sums else x
        cells = [(c, d, n) for c, x in sums.items() for d, n in enumerate(x.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*cells, strict=True) if cells else ((), (), ()))], names=["c", "d", "n"])

    def last(shared):
        want = arrow_schema(made)

        def run(batches):
            for b in batches:
                keys = b.column(b.schema.get_field_index("keys"))
                for r, row in enumerate(b.drop_columns(["keys"]).to_pylist()):
                    x = _vectors(row, components)
                    own = _round(x, shared.value, row.get("known"))[0]
                    cells = [keys[r].values, pa.array(own), pa.array(squared(x, shared.value.at[own]))]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cells, want, strict=True)], schema=want)
            release()

        return run

    sums, known, before = [[0] * (components + 1) for _ in at], None, None
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(Centers(at, before))
        new = tables.write(tables.blocks(known).select(*names, *["known"] * (known is not None)).mapInArrow(over(shared), "block long, known binary, who binary, change binary"), f"round{r}")
        if known is not None:
            tables.drop(f"round{r - 1}")
        cells = new.select("who", "change").mapInArrow(total, "c long, d long, n long").groupBy("c", "d").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        for c, d, n in cells.collect():  # at most k * (components + 1)
            sums[c][d] += int(n)
        known, before = new, at
        at = np.array([[x // s[-1] for x in s[:-1]] if s[-1] else c for s, c in zip(sums, at.tolist(), strict=True)], np.int64)
        shared.unpersist()
    shared = spark.sparkContext.broadcast(Centers(at, before))
    found = stored(tables.blocks(known).select("keys", *names, *["known"] * (known is not None)).mapInArrow(last(shared), made), "clusters")
    for name in list(tables.tables):
        tables.drop(name)
    return found, at


def op11_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, at = cluster(table(spark, sf_dir, "embeddings"))
    named = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(at.tolist())], "cluster int, centroid_sha256 string")
    sizes = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = sizes.agg(F.sum("cluster_inertia").alias("inertia"))
    per = sizes.join(F.broadcast(whole)).join(F.broadcast(named), "cluster")  # a row a centroid
    return found.join(F.broadcast(per), "cluster").select(F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The rounds written out one after another."""
    parts = [
        """v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, e FROM v QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= 8)",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v.e, c, list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c{r}.e[i]) * (v.e[i] - c{r}.e[i])))::BIGINT AS d FROM v, c{r}
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if r < ROUNDS:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, list(m ORDER BY i) AS e FROM (SELECT c, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
  FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(e) AS x FROM a{r}) GROUP BY c, i) GROUP BY c UNION ALL SELECT c, e FROM c{r} WHERE c NOT IN (SELECT c FROM a{r}))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string((SELECT e FROM c{ROUNDS} WHERE c{ROUNDS}.c = a{ROUNDS}.c), ',')) AS centroid_sha256 FROM a{ROUNDS}
"""


OP11_SQL = _sql()

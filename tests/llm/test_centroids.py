"""Exponion search against plain rounds, and SQL."""

import hashlib

import duckdb
import numpy as np
import pytest
from quernstone.llm import centroids
from quernstone.llm._frames import table

NAN, INF = float("nan"), float("inf")


def whole(v):
    return np.floor(1024 * np.array(v, np.float64)).astype(np.int64)


def brute(rows, k=8, rounds=10, width=64):
    rows = [(i, whole(v)) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    at = [v for _, v in sorted(rows, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), str(r[0]), r[1].tolist()))[:k]]
    nearest = lambda v: min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in rows]
        for j in range(len(at)):
            of = [v for (_, v), o in zip(rows, own, strict=True) if o == j]
            if of:
                at[j] = np.array([sum(int(v[d]) for v in of) // len(of) for d in range(width)], np.int64)
    found = [(i, *nearest(v)) for i, v in rows]
    per = {j: sum(d for _, d, o in found if o == j) for j in range(len(at))}
    return sorted(({"vec_id": i, "cluster": j, "distance": d, "cluster_inertia": per[j], "inertia": sum(per.values()), "centroid_sha256": hashlib.sha256(",".join(map(str, at[j].tolist())).encode()).hexdigest()} for i, d, j in found), key=repr)


def sample(n=400, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 0.4, (6, 64))
    rows = [(i, [float(np.float32(x)) for x in centers[rng.integers(6)] + rng.normal(0, 0.2, 64)]) for i in range(n)]
    same = rows[0][1]
    rows += [(1000 + i, same) for i in range(200)] + [(2000 + i, [0.0] * 64) for i in range(40)] + [(2100 + i, [0.0] * 63 + [2.0 / 1024 * (-1) ** i]) for i in range(40)]
    return rows


def written(spark, tmp_path, rows):
    rows = [(i, v, 3, "x") for i, v in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cluster string").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_against_plain_rounds(spark, rows, tmp_path):
    held = sample() + [(5000, None), (5001, []), (5002, [1.0] * 63), (5003, [1.0] * 65), (5004, [None] + [0.5] * 63), (5005, [NAN] * 64), (5006, [0.1] * 63 + [INF]), (5007, [-INF] + [0.1] * 63), (7, [0.25] * 64), (None, [0.3] * 64)]
    assert rows(centroids.op11_exponion(spark, written(spark, tmp_path, held))) == brute(held)


def test_sql(spark, rows, tmp_path):
    path = written(spark, tmp_path, sample(150, 3))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    got = con.sql(centroids.OP11_SQL)
    assert rows(centroids.op11_exponion(spark, path)) == sorted((dict(zip(got.columns, r, strict=True)) for r in got.fetchall()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 3, 8])
def test_few_vectors(spark, rows, tmp_path, n):
    held = [(i, [float(i % 3)] * 64) for i in range(n)]
    assert rows(centroids.op11_exponion(spark, written(spark, tmp_path, held))) == brute(held)


def test_large_components_raise(spark, tmp_path):
    path = written(spark, tmp_path, [(i, [1e9] * 64) for i in range(3)])
    with pytest.raises(Exception, match="is the greatest"):
        centroids.cluster(table(spark, path, "embeddings"))


@pytest.mark.parametrize("k", [2, 5, 30])
def test_bounds_save_distances_and_change_nothing(k):
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.integers(-40, 40, (600, 3)) + rng.integers(-3, 3, (1, 3)) * 200 * i for i in range(5)] + [np.zeros((50, 3), np.int64)])
    at, before, measured = x[rng.choice(len(x), k, replace=False)], None, 0
    own, lower = np.zeros(len(x), np.int64), np.zeros(len(x))
    upper = np.sqrt(centroids.squared(x, at[own]).astype(float))
    for _ in range(12):
        measured += centroids.assign(x, centroids.Centers(at, before), own, upper, lower)
        d = np.array([((x - c) ** 2).sum(axis=1) for c in at])
        assert (own == d.argmin(axis=0)).all()
        assert (upper**2 >= d.min(axis=0)).all()
        before, at = at, np.array([x[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else at[j] for j in range(k)])
    assert measured < 12 * len(x) * k * (0.5 if k > 2 else 0.9)


def test_equal_buckets_meet_without_a_shuffle(spark, tmp_path):
    vectors = table(spark, written(spark, tmp_path, sample(50)), "embeddings")
    tables = centroids.Rounds(vectors, "vec_id", "embedding", 64, 1024)
    known = tables.write(tables.vectors.select("block", "vectors").withColumnRenamed("vectors", "known"), "known")
    plan = tables.blocks(known)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan

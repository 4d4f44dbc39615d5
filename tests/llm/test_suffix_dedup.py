import hashlib
import random
import time

import numpy as np
from quernstone.llm import suffix_dedup as S


def brute(docs):
    first = {}
    for k, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, S.LAST), S.LAST if k is None else k)
    out = []
    for k, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (S.LAST if k is None else k):
                gone[i : i + 50] = [True] * 50
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone[:-1]], strict=True)) if gone else 0
        out.append({"doc_id": k, "n_bytes": len(b), "n_removed": sum(gone), "n_spans": spans, "kept_sha256": hashlib.sha256(left).hexdigest()})
    return sorted(out, key=repr)


def sample():
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [text(rng.randint(30, 200)) for _ in range(8)] + ["a" * 300, "ab" * 150]
    docs = []
    for i in range(80):
        t = text(rng.randint(0, 80))
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            t += rng.choice([p, p[a:b]]) + text(rng.randint(0, 30))
        docs.append((i, t))
    docs += [(90, None), (91, ""), (92, docs[3][1]), (93, docs[3][1]), (93, docs[3][1]), (None, docs[4][1]), (None, docs[5][1] + "x"), (5, passages[0] + "same key"), (95, "z" * 49), (96, "z" * 50), (97, "z" * 51)]
    rng.shuffle(docs)
    return docs


def test_against_brute_force(spark, folder, rows, monkeypatch):
    docs = sample()
    path = folder(docs)
    assert rows(S.op1_suffix_dedup(spark, path)) == brute(docs)
    monkeypatch.setattr(S, "GROUP", 2000)  # several groups and buckets
    assert rows(S.op1_suffix_dedup(spark, path)) == brute(docs)


def test_sql_says_the_same(spark, folder, rows, duck):
    docs = [d for d in sample() if d[0] not in (5, 93, None)]
    path = folder(docs)
    assert rows(S.op1_suffix_dedup(spark, path)) == duck(S.OP1_SQL, path)


def test_empty_table(spark, folder):
    assert S.op1_suffix_dedup(spark, folder()).count() == 0


def test_previous_factors():
    rng = random.Random(0)
    for _ in range(40):
        b = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60)))
        want = [max((next((h for h in range(len(b)) if i + h >= len(b) or b[j + h] != b[i + h]), 0) for j in range(i)), default=0) for i in range(len(b))]
        assert S.previous_factors(b).tolist() == want
        assert S.suffix_array(b).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_minimizers_of_a_bucket():
    rng = np.random.default_rng(2)
    one = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (40, 0, 25, 60)]
    more = [np.setdiff1d(rng.integers(0, 300, n).astype(np.uint64), x) for n, x in zip((5, 3, 0, 9), one, strict=True)]
    several = set(np.concatenate(more).tolist())
    held = [set(x.tolist()) for x in one]
    got = S.shared_by(one, more)
    for k, x in enumerate(one):
        want = [*more[k].tolist(), *[v for v in x.tolist() if v in several or any(v in y for j, y in enumerate(held) if j != k)]]
        assert got[k].tolist() == want
    assert [x.tolist() for x in S.shared_by([one[0]], [one[1]])] == [[]]


def test_minimizers_of_many_groups_are_looked_up():
    """A bucket of 6 GB has a thousand groups: 0.1 s or so; sorting all for each group took 40 s and more."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**40, 300_000, dtype=np.uint64)
    one = [np.unique(pool[rng.integers(0, len(pool), 400)]) for _ in range(1000)]
    began = time.perf_counter()
    S.shared_by(one, [np.zeros(0, np.uint64)] * len(one))
    assert time.perf_counter() - began < 8

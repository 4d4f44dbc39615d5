import random
import re

import numpy as np
import pytest

from quernstone.llm import near_dup


def shingle_set(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs):
    sets = [shingle_set(t) for _, t in docs]
    label = list(range(len(docs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(docs):
        comp = min((d for j, (d, _) in enumerate(docs) if find(j) == find(i) and d is not None), default=None)
        out.append({"doc_id": doc, "n_shingles": len(sets[i]), "component_id": comp, "kept": doc == comp})
    return sorted(out, key=repr)


def sample():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    docs, i = [], 0
    for n in (3, 4, 5, 8, 12, 30, 80, 200):
        base = [word() for _ in range(n)]
        for copies in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                w[rng.randrange(n)] = word()
            docs.append((i, " ".join(w) if copies % 5 else "\n".join(x.upper() if x.isascii() else x for x in w)))
            i += 1
    chain = [word() for _ in range(120)]  # each is near the next, the ends are far apart
    for _ in range(20):
        docs.append((i, " ".join(chain)))
        chain = chain[6:] + [word() for _ in range(6)]
        i += 1
    docs += [(i, None), (i + 1, ""), (i + 2, "one"), (i + 3, "ONE"), (i + 4, " "), (0, docs[0][1]), (7, "shares a key with another text of its own")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("piece", [2000, 4])
def test_against_brute_force(spark, folder, rows, monkeypatch, piece):
    monkeypatch.setattr(near_dup, "PIECE", piece)
    docs = sample()
    assert rows(near_dup.op9_near_dup(spark, folder(docs))) == brute(docs)


def test_buckets_alone_find_what_the_stars_miss(spark, folder, rows, monkeypatch):
    """With the first links withheld, the search between components must find all of them."""
    docs = [d for d in sample() if d[0] not in (0, 7)]
    real, calls = near_dup._passing, []

    def withheld(pairs, classes, threshold):
        calls.append(1)
        return real(pairs, classes, threshold).limit(0)

    monkeypatch.setattr(near_dup, "_passing", withheld)
    assert rows(near_dup.op9_near_dup(spark, folder(docs))) == brute(docs) and calls


def test_no_rows_and_no_copies(spark, folder, rows):
    assert near_dup.op9_near_dup(spark, folder([])).count() == 0


def test_stage_keeps_one_of_each(spark, folder):
    text = " ".join(f"w{i}" for i in range(50))
    path = folder([(5, text), (3, text.upper()), (3, text.upper()), (None, text), (9, "other words are here in this one"), (1, ""), (2, None)])
    kept = near_dup.stage(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 9]
    assert kept.columns == spark.read.parquet(f"{path}/documents.parquet").columns


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8, 0.95):
        n = 3000
        common = int(2 * n * share / (1 + share))
        pool = np.sort(rng.integers(0, 2**64, 2 * n, dtype=np.uint64))
        pick = rng.permutation(2 * n)
        a, b = np.sort(pool[pick[:n]]), np.sort(pool[pick[n - common : 2 * n - common]])
        r = near_dup.registers(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        got = near_dup.estimate(np.array([(r[0] == r[1]).mean()]), np.array([n]), np.array([n]))[0]
        assert abs(got - share) < 0.1

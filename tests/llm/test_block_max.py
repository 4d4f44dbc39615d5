"""Ranked search against brute force and SQL; blocks that are left out change nothing."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from quernstone.llm import block_max


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, top):
    held = [(k, Counter(w), len(w)) for k, w in ((k, terms(t)) for k, t in docs) if w]
    n, total = len(held), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    queries = {}
    for k, t in items:
        queries.setdefault(k, set()).update(terms(t))
    out = []
    for item, ts in queries.items():
        found = []
        for key, count, length in held:
            m = 100 - 50 + (50 * length * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * count[t] // (1000 * count[t] + 20 * m)) for t in ts if count[t])
            if score > 0:
                found.append((-score, key is None, key))
        out += [{"item_id": item, "rank": r + 1, "doc_id": key, "score": -score} for r, (score, _, key) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


def sample(n=300):
    rng = random.Random(9)
    vocabulary = ["w%d" % i for i in range(60)] + ["The", "É", "naïve", "中文"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda k: "".join(rng.choices(vocabulary, weights)[0] + rng.choice([" ", ", ", "\n", "--"]) for _ in range(k))
    items = [(i, text(rng.randint(1, 12))) for i in range(15)] + [(20, None), (21, ""), (22, "..."), (23, "unseen"), (3, "more terms of three")]
    docs = [(i, text(rng.choice([0, 1, 5, 40]))) for i in range(n)]
    same = text(20)
    docs += [(1000 - i, same) for i in range(90)] + [(400, None), (401, ""), (402, "The"), (402, "The"), (None, "w1 w2 w3"), (None, same), (403, text(40000))]
    return docs, items


@pytest.mark.parametrize(("shard", "block", "chunk", "seed"), [(4 << 20, 64, 250_000, 8), (500, 4, 250_000, 2), (2000, 3, 20, 1)])
def test_against_brute_force(spark, folder, rows, monkeypatch, shard, block, chunk, seed):
    for name, value in (("SHARD", shard), ("BLOCK", block), ("CHUNK", chunk), ("SEED", seed)):
        monkeypatch.setattr(block_max, name, value)
    docs, items = sample()
    assert rows(block_max.op13_block_max(spark, folder(docs, items))) == brute(docs, items, 50)


def test_sql_on_unique_keys(spark, folder, rows, duck):
    docs, items = sample()
    docs = list({k: (k, t) for k, t in docs if k is not None}.values())
    path = folder(docs, items)
    assert rows(block_max.op13_block_max(spark, path)) == duck(block_max.OP13_SQL, path)


def made(docs):
    data = [(t or "").encode() for _, t in docs]
    row = block_max.shard_of(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]))
    return row | {"keys": np.array([k for k, _ in docs], np.int64), "shard": 0}


def test_blocks_are_left_out_by_their_bounds(monkeypatch):
    monkeypatch.setattr(block_max, "BLOCK", 4)
    rng = random.Random(2)
    docs = [(i, " ".join(["common"] * rng.randint(1, 3) + ["w%d" % rng.randint(0, 300) for _ in range(30)])) for i in range(400)]
    docs[200:205] = [(i, "rare common words") for i in range(200, 205)]
    row = made(docs)
    q = [["rare", "common", "w7"], ["common"]]
    hashed = [block_max.terms_of(np.frombuffer(" ".join(x).encode(), np.uint8), np.array([0, len(" ".join(x))]))[0] for x in q]
    queries = block_max.Queries([0, 1], np.repeat([0, 1], [3, 1]), np.concatenate(hashed))
    counts = [set(terms(t)) for _, t in docs]
    queries.weigh(len(docs), sum(len(terms(t)) for _, t in docs), {int(h.view(np.int64)): sum(t in c for c in counts) for ts, hs in zip(q, hashed, strict=True) for t, h in zip(ts, hs, strict=True)})
    best = block_max.Best(2, 5, np.zeros(2, np.int64))
    scored = block_max.search_shard(queries, row, best)
    assert scored < 100  # of 200 pairs of query and block
    want = brute(docs, list(enumerate(" ".join(x) for x in q)), 5)
    assert [(s, k) for q_ in (0, 1) for s, k in zip(*best.held[q_], strict=True)] == [(r["score"], r["doc_id"]) for r in sorted(want, key=lambda r: (r["item_id"], r["rank"]))]
    # bounds are upper bounds, reached by single terms
    forward = block_max.Forward(queries, row)
    for who, block, bound in zip(*queries.bounds(row), strict=True):
        top = forward.scores(int(who), int(block))[1].max()
        assert bound >= top and (who == 0 or bound == top)


def test_empty_tables(spark, folder, tmp_path):
    assert block_max.op13_block_max(spark, folder([], [(1, "a")])).count() == 0


def test_no_items(spark, folder):
    assert block_max.op13_block_max(spark, folder([(1, "a")], [])).count() == 0


def test_all_texts_empty(spark, folder):
    assert block_max.op13_block_max(spark, folder([(1, None), (2, "!")], [(1, "a"), (2, "!")])).count() == 0


def test_row_groups_stay_small(spark, tmp_path):
    """Who writes or reads the index holds a row group: shards of one task don't share one beyond some megabytes."""
    words = F.transform(F.sequence(F.lit(0), F.lit(200_000)), lambda x: F.concat(F.hex(x), F.lit("q"), F.col("id").cast("string")))
    docs = spark.range(0, 4, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.array_join(words, " "), 3).alias("text"))
    block_max.build(docs, f"file://{tmp_path}/index")
    (part,) = (tmp_path / "index").glob("*.parquet")
    found = pq.ParquetFile(part).metadata
    assert found.num_rows == 4 and found.num_row_groups > 1
    assert max(found.row_group(k).total_byte_size for k in range(found.num_row_groups)) < 20 << 20

import hashlib
import random
import re

from quernstone.llm import phrase_index


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9)):
            if w:
                windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for win, who in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= who
        out.append({"doc_id": doc, "n_words": len(w), "n_hit": len(hit), "n_items": len(found), "items_sha256": hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), "contaminated": bool(hit)})
    return sorted(out, key=repr)


def sample():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice(["The", "of", "é", "rare%d" % rng.randint(0, 50), "b-c", "X9"]) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rng.randint(1, 40))) for i in range(12)] + [(20, None), (21, ""), (22, "..."), (3, "of the"), (None, "lone phrase here")]
    docs = [(i, text(rng.randint(0, 60)) + (rng.choice(items)[1] or "") + text(rng.randint(0, 20))) for i in range(50)]
    docs += [(60, None), (61, ""), (62, items[0][1]), (62, items[0][1]), (None, items[1][1])]
    return docs, items


def test_against_brute_force_and_sql(spark, folder, rows, duck):
    docs, items = sample()
    docs, items = docs[:-1], [x for x in items if x[0] is not None]
    path = folder(docs, items)
    assert rows(phrase_index.op8_decontaminate(spark, path)) == brute(docs, items)
    docs = [x for x in docs if x[0] != 62]


def test_chunks_unite(spark, folder, rows, monkeypatch):
    docs, items = sample()
    docs = [d for d in docs if d[0] not in (62, None)]
    items = [x for x in items if x[0] is not None]
    monkeypatch.setattr(phrase_index, "CHUNK", 40)
    assert rows(phrase_index.op8_decontaminate(spark, folder(docs, items))) == brute(docs, items)


def test_chunks_keep_repeated_and_null_keys(spark, folder, rows, monkeypatch):
    docs, items = sample()
    items = [x for x in items if x[0] is not None]
    docs += [(None, "of of of"), (None, "the b c"), (62, "one two"), (62, "X9 é")]
    path = folder(docs, items)
    whole = rows(phrase_index.op8_decontaminate(spark, path))
    monkeypatch.setattr(phrase_index, "CHUNK", 40)
    assert rows(phrase_index.op8_decontaminate(spark, path)) == whole == brute(docs, items)


def test_sql_on_unique_keys(spark, folder, rows, duck):
    docs, items = sample()
    docs = [d for d in docs if d[0] not in (62, None)]
    items = [x for x in items if x[0] is not None]
    path = folder(docs, items)
    assert rows(phrase_index.op8_decontaminate(spark, path)) == duck(phrase_index.OP8_SQL, path)


def test_empty_tables(spark, folder):
    path = folder([(1, "a b c")], [])
    assert [tuple(r)[:4] for r in phrase_index.op8_decontaminate(spark, path).collect()] == [(1, 3, 0, 0)]
    assert phrase_index.stage(spark, spark.read.parquet(f"{path}/documents.parquet").limit(0), path).count() == 0


def test_proximity(spark, folder):
    path = folder([(1, "alpha x beta y gamma"), (2, "gamma beta " + "z " * 30 + "alpha"), (3, "alpha beta"), (4, "gamma")], [(9, "alpha beta gamma")])
    index = phrase_index.build(spark.read.parquet(f"{path}/documents.parquet"), f"{path}/index")
    found = phrase_index.windows(spark.read.parquet(f"{path}/benchmark.parquet"), 3)
    assert {r.keep.c0 for r in phrase_index.search(index, found, slop=5).collect() if r.out.contaminated} == {1}
    assert not any(r.out.contaminated for r in phrase_index.search(index, found).collect())

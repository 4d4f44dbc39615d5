import random

from pyspark.sql import functions as F

from quernstone.llm import license_scan as L


def test_against_sql(spark, folder, rows, duck):
    rng = random.Random(9)
    noise = lambda n: " ".join(rng.choice(["the", "under", "license", "of", "x%d" % rng.randint(0, 99), "software"]) for _ in range(n))
    docs = [(0, None), (1, ""), (2, "license"), (3, noise(300))]
    for i, (name, text) in enumerate(sorted(L.TEMPLATES.items())):
        docs += [(10 + i, f"{noise(40)} {text.upper()} {noise(30)}"), (40 + i, f"{noise(7)}\n// {text.replace(' ', '  ')}\n{text}")]
        words = text.split()
        if len(words) > 60:
            words[len(words) // 2] = "changed"
            docs.append((70 + i, f"{noise(11)} {' '.join(words)} {noise(5)}"))
            docs.append((100 + i, " ".join(words[: len(words) // 2])))
    path = folder(docs)
    got = rows(L.op10_license_scan(spark, path))
    assert got == duck(L.OP10_SQL, path)
    by = {r["doc_id"]: r["licenses"] for r in got}
    for i, name in enumerate(sorted(L.TEMPLATES)):
        assert f"{name}:1000" in by[10 + i].split(",")
    assert by[0] == by[1] == by[2] == by[3] == ""
    assert "MIT:" in by[70 + sorted(L.TEMPLATES).index("MIT")] and by[100 + sorted(L.TEMPLATES).index("MIT")] == ""


def test_plan_has_no_python_and_no_shuffle(spark, folder):
    plan = L.op10_license_scan(spark, folder([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_repeated_rows_empty_table_own_templates(spark, folder):
    path = folder([(1, "one two three"), (1, "one two three"), (None, "one two three four")])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = L.scan(docs, {"short": "One, two; three!"}).select("doc_id", F.size("licenses").alias("n")).collect()
    assert sorted((r.doc_id or 0, r.n) for r in got) == [(0, 0), (1, 1), (1, 1)]
    assert L.scan(docs.limit(0)).count() == 0 and L.scan(docs, {}).count() == 3

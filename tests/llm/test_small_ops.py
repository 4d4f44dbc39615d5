"""Language identification, the WARC archive, and the pipeline as a whole."""

import base64
import random

import corpus_pipeline
import pytest
from quernstone.llm import langid, warc_store


def words(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_rules(spark, folder):
    rng = random.Random(3)
    syllables = {"en": ["th", "ing", "er", "an", "re"], "fr": ["eau", "é", "ment", "que", "oi"], "de": ["sch", "ung", "ä", "keit", "ei"]}
    rows = [(i, words(rng, syllables[lang], rng.randint(5, 60)), lang, "s", 1) for i in range(200) for lang in [rng.choice(list(syllables))]]
    rows += [(900, None, "en", "s", 0), (901, "123 -- !", "fr", "s", 0), (902, "", None, "s", 0), (903, words(rng, syllables["de"], 30).upper(), None, "s", 0), (903, "e", "en", "s", 0)]
    got = langid.op3_langid(spark, folder(rows)).collect()
    truth = {r[0]: r[2] for r in rows[:200]}
    test = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(test) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in test) >= 0.97 * len(test)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert {r.lang_pred for r in got if r.doc_id == 903} >= {"de"}
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)


def test_no_training_rows(spark, folder):
    assert {r.lang_pred for r in langid.op3_langid(spark, folder([(1, "text", None, "s", 4)])).collect()} == {"und"}


def test_language_stage_drops_gibberish_and_unlearned_scripts(spark, folder):
    rng = random.Random(5)
    syllables = {"en": ["th", "ing", "er", "an", "re"], "fr": ["eau", "é", "ment", "que", "oi"], "de": ["sch", "ung", "ä", "keit", "ei"]}
    clean = [(i, words(rng, syllables[lang], rng.choice([3, 8, 40, 200])), lang, "s", 1) for i in range(200) for lang in [rng.choice(list(syllables))]]
    of = lambda letters: lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n // 5))
    kinds = [of("abcdefghijklmnopqrstuvwxyz"), lambda n: base64.b64encode(rng.randbytes(n)).decode(), of([chr(c) for c in range(0x430, 0x450)]), of([chr(c) for c in range(0x4E00, 0x9FFF)])]
    junk = [(1000 + 100 * k + i, kind(rng.choice([60, 300, 1500])), None, "s", 1) for k, kind in enumerate(kinds) for i in range(25)]
    path = folder(clean + junk)
    kept = {r.doc_id for r in langid.stage(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()}
    assert kept >= {r[0] for r in clean} and len(kept) <= len(clean) + 2


def test_archive_round_trip(spark, folder, rows, duck, tmp_path):
    same = "<p>" + "x" * 120
    pages = [(5, "http://a/5", same), (3, "http://a/3", same), (9, "http://a/é\r\nx", same), (1, None, None), (2, "", ""), (4, "u", "short"), (6, "u", "short"), (8, "u", "WARC-Type: revisit\r\n" * 9)]
    path = folder(pages=pages)
    assert rows(warc_store.op4_warc(spark, path)) == duck(warc_store.OP4_SQL, path)
    store = warc_store.write_archive(spark.read.parquet(f"{path}/pages.parquet"), f"file://{tmp_path}/store")
    got = {r.key: bytes(r.record) for r in warc_store.record_bytes(spark, store).collect()}
    assert got[8].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and got[8].endswith(pages[-1][2].encode() + b"\r\n\r\n")
    assert b"WARC-Refers-To: <urn:x-page:3>\r\n" in got[5] and not got[5].count(b"xxxx") and got[3].count(same.encode()) == 1
    for record in got.values():
        head, _, body = record.partition(b"\r\n\r\n")
        length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        assert len(body) == length + 4
    assert spark.read.parquet(f"{store}/payloads").count() == 4


def test_repeated_rows_and_damage(spark, folder, tmp_path):
    body = "y" * 150
    path = folder(pages=[(2, "u", body), (2, "u", body), (None, "u", body), (7, "u", body)])
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc_store.op4_warc(spark, path).collect())
    assert got == [("2", "response", None), ("2", "response", None), ("7", "revisit", 2), ("None", "revisit", 2)]
    store = warc_store.write_archive(spark.read.parquet(f"{path}/pages.parquet"), f"file://{tmp_path}/damaged")
    spark.read.parquet(f"{store}/payloads").selectExpr("digest", "cast('z' as binary) payload").write.parquet(f"file://{tmp_path}/damaged2/payloads")
    spark.read.parquet(f"{store}/headers").write.parquet(f"file://{tmp_path}/damaged2/headers")
    with pytest.raises(Exception, match="digest"):
        warc_store.records(spark, f"file://{tmp_path}/damaged2").collect()
    assert warc_store.op4_warc(spark, folder_of(spark, tmp_path)).count() == 0


def test_missing_payloads_and_other_digests_raise(spark, folder, tmp_path):
    path = folder(pages=[(1, "u", "y" * 150), (2, "u", "y" * 150), (3, "u", "z")])
    store = warc_store.write_archive(spark.read.parquet(f"{path}/pages.parquet"), f"file://{tmp_path}/store")
    payloads, headers = (spark.read.parquet(f"{store}/{t}") for t in ("payloads", "headers"))
    other = "encode(regexp_replace(decode(header, 'UTF-8'), 'sha256:....', 'sha256:zzzz'), 'UTF-8')"
    cases = {"a": (payloads.where("octet_length(payload) > 1"), headers), "b": (payloads.where("octet_length(payload) = 1"), headers.where("key > 1")), "c": (payloads, headers.selectExpr("key", "digest", f"if(key = 2, {other}, header) header"))}
    for name, parts in cases.items():
        for t, part in zip(("payloads", "headers"), parts, strict=True):
            part.write.parquet(f"file://{tmp_path}/{name}/{t}")
        for read in (warc_store.records, warc_store.record_bytes):
            with pytest.raises(Exception, match="no payload of the digest"):
                read(spark, f"file://{tmp_path}/{name}").collect()
    assert warc_store.records(spark, store).count() == 3


def folder_of(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    return f"{tmp_path}/none"


def test_pipeline(spark, folder):
    rng = random.Random(1)
    syllables = ["th", "ing", "er", "an", "re", "on"]
    texts = [words(rng, syllables, 60) for _ in range(12)]
    leak = words(rng, syllables, 30)
    rows = list(enumerate(texts)) + [(20, texts[0]), (21, texts[1].upper()), (22, "12 34 !!"), (23, None), (24, f"{words(rng, syllables, 20)} {leak} {words(rng, syllables, 20)}"), (25, texts[2][: len(texts[2]) // 2] + " write to bosbt.42@mail8.example.com now")]
    out = corpus_pipeline.run(spark, folder(rows, benchmark=[(1, leak)])).collect()
    assert sorted(r.doc_id for r in out) == [*range(12), 25]
    assert all(r.n_tokens > 0 and len(r.ids) == 4 * r.n_tokens for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "personal_data", "tokens"]


def plain_languages(rows):
    """Predictions with dictionaries: vectors by position, n-grams letter by letter."""
    import zlib

    import numpy as np

    base = langid.letters()[0]

    def grams(text):
        s, out = [0], {}
        for c in text or "":
            k = int(langid.classes()[ord(c.lower() if len(c.lower()) == 1 else c)])
            if k or s[-1]:
                s.append(k)
        s += [0] if s[-1] else []
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            if b:
                out[a, b, c] = out.get((a, b, c), 0) + 1
        return out

    def bundle(counts):
        total = np.zeros(langid.DIMENSIONS)
        for (a, b, c), n in counts.items():
            total += n * np.array([base[a][d - 2] * base[b][d - 1] * base[c][d] for d in range(langid.DIMENSIONS)])
        return total

    def held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0

    sums, vectors = {}, [bundle(grams(t)) for _, t, *_ in rows]
    for (i, t, lang, *_), v in zip(rows, vectors, strict=True):
        if lang is not None and t is not None and not held(i):
            sums[lang] = sums.get(lang, 0) + v
    out = []
    for (i, t, *_), v in zip(rows, vectors, strict=True):
        cos = {k: round(float(v @ s) / (np.linalg.norm(v) * np.linalg.norm(s)), 6) for k, s in sums.items() if v.any() and s.any()}
        best = min(cos, key=lambda k: (-cos[k], k)) if cos else "und"
        out.append((i, held(i), best, max(0.0, min(1.0, cos.get(best, 0.0)))))
    return sorted(out, key=repr)


def test_language_against_dictionaries(spark, folder):
    rng = random.Random(7)
    syllables = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéñßдж") for _ in range(rng.randint(1, 3))) for _ in range(12)] for k in ("aa", "bb", "cc")}
    rows = [(i, words(rng, syllables[k], rng.randint(1, 25)) + rng.choice(["", " 12.", "É!", "\nİx"]), rng.choice([k, k, None]), "s", 1) for i in range(60) for k in [rng.choice(list(syllables))]]
    rows += [(70, None, "aa", "s", 0), (71, "12 --", "bb", "s", 0), (72, "", None, "s", 0), (73, "a", None, "s", 0), (None, rows[0][1], None, "s", 1), (3, rows[3][1], "aa", "s", 1)]
    got = sorted(((r.doc_id, r.held_out, r.lang_pred, r.score) for r in langid.op3_langid(spark, folder(rows)).collect()), key=repr)
    want = plain_languages(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-5 for g, w in zip(got, want, strict=True))


def test_empty_and_repeated_rows_of_the_pipeline(spark, folder):
    assert langid.op3_langid(spark, folder()).count() == 0


def test_pipeline_on_nothing_and_on_copies(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder()).count() == 0


def test_pipeline_with_null_keys_and_copies(spark, folder):
    rng = random.Random(3)
    texts = [words(rng, ["th", "ing", "er", "an", "re", "on"], 60) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (None, words(rng, ["th", "ing", "er", "an"], 50)), (9, "long " + " ".join(texts) * 40)]
    out = corpus_pipeline.run(spark, folder(rows)).collect()
    assert sorted((r.doc_id for r in out), key=lambda x: (x is None, x)) == [0, 1, 2, 3, 4, 5, 9, None]

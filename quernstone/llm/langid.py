"""Language identification with hyperdimensional profiles.

Each letter class has a random vector of +1 and -1. An n-gram of three letters is bound
as shift2(a) * shift1(b) * c (element by element), a document or language is the bundle
(sum) of its n-gram vectors, and a document takes the language whose prototype has
the largest cosine with it. Bundling is linear, so a language is gathered as counts of its
n-grams: at most 64**3 of them a language, whatever the corpus holds.

``stage`` drops texts without a recognised language. What a clean text scores grows with its number of
distinct n-grams, so the least score is learned from the labelled documents by that number: a third
of the median score of those with as many or fewer, and never less than four standard deviations
of the cosine of unrelated vectors.

Edge cases: null or letterless text is ``und`` with score 0; one letter makes an n-gram
with the word borders; equal cosines take the smaller language name; rows without
lang don't train; with no training rows every text is ``und``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import map_text, quoted, release, stored, table, tune, unpacked
from ._text import blocks, buffers

SYMBOLS, GRAMS, DIMENSIONS, SEED = 64, 64**3, 1024, 7
#: Languages whose n-gram counts (2 MB each) a task holds at a time.
OPEN = 16
BLOCK = 1 << 20
#: N-grams whose vectors (4 KB each) are held at a time.
CHUNK = 4096
#: Least score: standard deviations of the cosine of unrelated vectors, and share of the median score of labelled documents.
NOISE, MEDIAN_SHARE = 4 / DIMENSIONS**0.5, 1 / 3


@lru_cache(1)
def classes() -> np.ndarray:
    """Letter class of each code point: 0 no letter, 1 to 26 a to z, else one of 37 by a multiplicative hash."""
    of = np.zeros(0x110000, np.uint8)
    points = np.fromiter((i for i in range(0x110000) if chr(i).isalpha()), np.int64)
    of[points] = 27 + ((points * 2654435761) % 2**32 >> 16) % 37
    of[97:123] = np.arange(1, 27)
    return of


@lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The random letter vectors, permuted for the third, second and first place of an n-gram."""
    base = np.random.Generator(np.random.PCG64(SEED)).choice(np.array([-1, 1], np.float32), (SYMBOLS, DIMENSIONS))
    return base, np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)


def bind(grams: np.ndarray) -> np.ndarray:
    c, b, a = letters()
    return a[grams >> 12] * b[grams >> 6 & 63] * c[grams & 63]


def gram_counts(data: np.ndarray, offs: np.ndarray):
    """Document numbers, n-grams and counts of each distinct n-gram of each document."""
    text = bytes(data).decode("utf-8", "replace")
    points = np.frombuffer(text.lower().encode("utf-32-le") if text.isascii() else _lower(text), np.uint32)
    borders = offs if len(points) == len(data) else np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80).astype(np.int64))])[offs]
    s = classes()[points]
    n = len(borders) - 1
    own = np.repeat(np.arange(n), np.diff(borders))
    # a border before and after each document, and runs without letters as one border
    keep = np.flatnonzero((s != 0) | (np.concatenate([[1], s[:-1]]) != 0))
    s, own = s[keep], own[keep]
    at = np.searchsorted(own, np.arange(n + 1))
    s, own = np.insert(s, np.repeat(at, 2)[1:-1], 0), np.insert(own, np.repeat(at, 2)[1:-1], np.repeat(np.arange(n), 2))
    s = s.astype(np.int64)
    code = s[:-2] << 12 | s[1:-1] << 6 | s[2:]
    good = (own[:-2] == own[2:]) & (s[1:-1] != 0)
    keys, counts = np.unique(own[:-2][good] * GRAMS + code[good], return_counts=True)
    return keys // GRAMS, keys % GRAMS, counts


def _lower(text: str) -> bytes:
    """Lower case by code points, so that no character changes its number of them."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return lower_points()[points].tobytes()


@lru_cache(1)
def lower_points() -> np.ndarray:
    to = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isupper() and len(low := c.lower()) == 1:
            to[i] = ord(low)
    return to


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Language prototypes: the bundle of all n-grams of all rows with a language and a text.

    A task counts n-grams of at most OPEN languages at a time and sends each language's bundle, DIMENSIONS integers; the
    driver gets their sums, 8 KB a language.
    """
    tune(docs.sparkSession)
    rows = docs.select(quoted(lang).cast("string").alias("lang"), quoted(text).cast("binary").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def bundled(sums):
        for name, total in sums.items():
            at, vector = np.flatnonzero(total), np.zeros(DIMENSIONS)
            for i in range(0, len(at), CHUNK):
                vector += total[at[i : i + CHUNK]].astype(np.float64) @ bind(at[i : i + CHUNK])
            yield name, np.rint(vector).astype(np.int64)

    def sent(sums):
        for name, vector in bundled(sums):
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS)), pa.array(vector)], names=["lang", "d", "n"])

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            data, offs = buffers(b.column(1))
            names, number = np.unique(np.array(b.column(0).to_pylist(), object).astype(str), return_inverse=True)
            for i, j in blocks(offs, BLOCK):
                doc, gram, n = gram_counts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                k = number[i:j][doc]
                order = np.argsort(k, kind="stable")
                cut = np.flatnonzero(np.diff(k[order], prepend=-1)) if len(k) else []
                for part in np.split(order, cut[1:]) if len(order) else []:
                    name = str(names[k[part[0]]])
                    if name not in sums and len(sums) >= OPEN:
                        yield from sent(sums)
                        sums = {}
                    sums.setdefault(name, np.zeros(GRAMS, np.int64))
                    np.add.at(sums[name], gram[part], n[part])
        yield from sent(sums)
        del sums
        release()

    cells = rows.mapInArrow(count, "lang string, d long, n long").groupBy("lang", "d").agg(F.sum("n").alias("n"))
    found = cells.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "n"))).alias("vector")).select("lang", F.col("vector.n").alias("vector")).toPandas()
    made = {}
    for name, vector in zip(found["lang"], found["vector"], strict=True):
        total = np.asarray(vector, np.float64)
        made[str(name)] = total / (np.linalg.norm(total) or 1.0)
    return made


def classify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep=("doc_id",), flat: bool = True) -> DataFrame:
    """The columns of keep, and out: struct of lang_pred, score (the cosine, 0 at least) and size (of the number of distinct n-grams, the logarithm to base 2, cut)."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in names], np.float32).reshape(len(names), DIMENSIONS).T

    def predict(data, offs):
        langs, scores, sizes = [], [], []
        for i, j in blocks(offs, BLOCK):
            doc, gram, n = gram_counts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            pred, score = np.full(j - i, "und", object), np.zeros(j - i)
            distinct = np.bincount(doc, minlength=j - i)
            if len(doc) and names:
                grams, col = np.unique(gram, return_inverse=True)
                bundle = np.zeros((j - i, DIMENSIONS), np.float32)
                for a in range(0, len(grams), CHUNK):
                    part = (col >= a) & (col < a + CHUNK)
                    vectors, inside, who, count = bind(grams[a : a + CHUNK]), col[part] - a, doc[part], n[part]
                    for d in range(0, j - i, 256):
                        p, q = np.searchsorted(who, (d, d + 256))
                        counts = np.zeros((min(256, j - i - d), len(vectors)), np.float32)
                        counts[who[p:q] - d, inside[p:q]] = count[p:q]
                        bundle[d : d + 256] += counts @ vectors
                length = np.linalg.norm(bundle, axis=1)
                has = distinct > 0
                cos = np.round((bundle @ matrix) / np.maximum(length, 1e-9)[:, None], 6)
                best = cos.argmax(axis=1)
                pred[has] = np.array(names, object)[best[has]]
                score[has] = np.clip(cos[np.arange(j - i), best][has], 0, 1)
            langs.extend(pred)
            scores.append(score)
            sizes.append(np.frexp(np.maximum(distinct, 1))[1] - 1)
        return [pa.array(langs, pa.string()), np.concatenate(scores), np.concatenate(sizes)]

    return map_text(docs, predict, "lang_pred string, score double, size int", text, keep, flat)


def least_scores(made: DataFrame) -> list[float]:
    """The least score of a text with a language, by its size: from the classified rows (out, see classify) of texts that have a language, gathered as counts of size and score in thousandths."""
    found = made.where("out.lang_pred <> 'und'").groupBy(F.col("out.size").alias("size"), F.floor(F.col("out.score") * 1000).alias("score")).count().toPandas()
    by_score = np.zeros((GRAMS.bit_length(), 1001), np.int64)
    np.add.at(by_score, (found["size"].to_numpy(np.int64), found["score"].to_numpy(np.int64)), found["count"].to_numpy(np.int64))
    below = by_score.cumsum(axis=0).cumsum(axis=1)  # of documents of that size or less, those up to that score
    median = (2 * below < below[:, -1:]).sum(axis=1) / 1000
    return np.maximum(NOISE, MEDIAN_SHARE * median).tolist()


def held_out(key: str = "doc_id"):
    return F.crc32(F.coalesce(quoted(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = classify(docs, train(docs.where(~held_out())))
    return made.select("doc_id", held_out().alias("held_out"), "out.lang_pred", "out.score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float | None = None) -> DataFrame:
    """Rows whose text has a language: not ``und``, and a cosine of least (None: by least_scores) or more with its prototype.

    Null, empty and letterless texts go; equal cosines take the smaller name, so ties decide nothing here; repeated rows are
    judged alike; an empty table gives none, one without languages neither. Columns of any name come out as they were.
    """
    names = docs.columns
    made = stored(classify(docs, train(docs), keep=names, flat=False), "classified")
    labelled = made.where(F.col(f"keep.c{names.index('lang')}").isNotNull())
    enough = F.lit(least) if least is not None else F.element_at(F.array(*map(F.lit, least_scores(labelled))), F.col("out.size") + 1)
    return unpacked(made.where((F.col("out.lang_pred") != "und") & (F.col("out.score") >= enough)), names)

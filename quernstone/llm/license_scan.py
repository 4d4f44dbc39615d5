"""License notices by MinHash bands over overlapping windows, verified by exact shingle containment.

DataFrame functions only; no shuffle, row for row. A template of L five-word shingles is
looked for in windows of L shingles that start at every max(1, L // 8)-th one. Windows
and templates have BANDS bands of one row: a window is retrieved when the smallest of its
shingles under one of BANDS hash functions is the template's. A window of Jaccard similarity 0.6 is
missed with probability (1 - 0.6) ** 16 = 4e-7, an aligned copy never.

The bands are evaluated the other way round, which changes no result: only a window that holds
a template's smallest shingle can share its band, so one pass finds those shingles, and
window minima are computed only around them. Verification counts the distinct template shingles
in the window and one stride on either side: CONTAINMENT of them or more is a match.

Edge cases: null and empty texts have no shingles and no match; a template or text of fewer than
five words is one shingle; repeated rows are handled each by itself; of several
matches of a template the fullest, and of these the first, is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import quoted, table

K, BANDS, CONTAINMENT = 5, 16, 0.8

#: Public license notices: names and texts.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body) -> Column:
    """body(value), value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _value(b: int):
    """The hash function of a band."""
    return lambda x: F.xxhash64(x, F.lit(b))


def shingled(text: Column) -> Column:
    """Hashes of the K-word shingles of a text, in order."""
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), lambda w: w != "")

    def hashes(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(K)]))
        return F.when(n >= K, many).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    return let(words, hashes)


def _pair(b: int):
    return lambda x: F.struct(_value(b)(x).alias("v"), x.alias("x"))


def prepared(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """Each template's distinct shingles, window, stride, and for each band its smallest shingle and that one's value."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string").select("name", shingled(F.col("text")).alias("h"))
    values = [F.array_min(F.transform("h", _pair(b))).alias(f"b{b}") for b in range(BANDS)]
    out = []
    for r in rows.select("name", F.size("h").alias("n"), F.array_distinct("h").alias("h"), *values).where("n > 0").orderBy("name").collect():
        out.append({"name": r["name"], "window": r["n"], "stride": max(1, r["n"] // 8), "shingles": r["h"], "bands": [(r[f"b{b}"]["v"], r[f"b{b}"]["x"]) for b in range(BANDS)]})
    return out


def _found(t: dict, h: Column, hits: Column) -> Column:
    """The best match of a template: struct of containment and window start, null if none."""
    window, stride = t["window"], t["stride"]
    lead: dict[int, list[int]] = {}
    for b, (_, x) in enumerate(t["bands"]):
        lead.setdefault(x, []).append(b)
    mine = F.filter(hits, lambda p: F.get(h, p).isin(list(lead)))
    # windows that hold a hit: (its position, window start)
    low = lambda p: F.greatest(F.lit(0), F.ceil((p - (window - 1)) / stride).cast("int"))
    pairs = F.flatten(F.transform(mine, lambda p: F.transform(F.sequence(low(p), F.floor(p / stride).cast("int")), lambda j: F.struct(p.alias("p"), (j * stride).alias("w")))))

    def shares(c: Column) -> Column:
        part = F.slice(h, c["w"] + 1, window)
        test = F.lit(False)
        for x, bands in lead.items():
            same = F.lit(False)
            for b in bands:
                same = same | (F.array_min(F.transform(part, _value(b))) == F.lit(t["bands"][b][0]))
            test = F.when(F.get(h, c["p"]) == F.lit(x), same).otherwise(test)
        return test

    starts = F.array_distinct(F.transform(F.filter(pairs, shares), lambda c: c["w"]))
    whole = F.array(*[F.lit(x).cast("bigint") for x in t["shingles"]])

    def held(w: Column) -> Column:
        begin = F.greatest(w - stride, F.lit(0))
        part = F.slice(h, begin + 1, w + window + stride - begin)
        return F.struct((F.size(F.array_intersect(whole, part)) / float(len(t["shingles"]))).alias("containment"), (-w).alias("w"))

    return F.array_max(F.filter(F.transform(starts, held), lambda m: m["containment"] >= CONTAINMENT))


def _named(name: str):
    return lambda m: F.when(m.isNotNull(), F.struct(F.lit(name).alias("name"), m["containment"].alias("containment"), (-m["w"]).alias("start")))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """docs with licenses: array of name, containment, and the first word of the matching window, by name."""
    ready = prepared(docs.sparkSession, TEMPLATES if templates is None else templates)
    anchors = sorted({x for t in ready for _, x in t["bands"]})
    none = F.array().cast("array<struct<name:string,containment:double,start:int>>")

    def matches(h: Column) -> Column:
        def all_of(hits: Column) -> Column:
            each = [let(_found(t, h, hits), _named(t["name"])) for t in ready]
            return F.filter(F.array(*each), lambda m: m.isNotNull())

        hits = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.get(h, i).isin(anchors))
        return F.when(F.exists(h, lambda x: x.isin(anchors)), let(hits, all_of)).otherwise(none)

    return docs.withColumn("licenses", let(shingled(quoted(text)), matches) if ready else none)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    said = F.transform("licenses", lambda m: F.concat(m["name"], F.lit(":"), F.round(m["containment"] * 1000).cast("long").cast("string")))
    return scan(docs).select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(said, ",").alias("licenses"))


def _sql(templates: dict[str, str]) -> str:
    """All windows of all documents, without bands."""
    norm = lambda t: f"list_filter(regexp_split_to_array(translate(coalesce({t}, ''), '{UPPER}', '{LOWER}'), '{BREAKS}'), lambda x: x <> '')"
    values = ", ".join("('" + n.replace("'", "''") + "', '" + x.replace("'", "''") + "')" for n, x in sorted(templates.items()))
    pieces = lambda key, src: f"(SELECT {key}, i - 1 AS p, array_to_string(list_slice(ws, i, i + {K - 1}), ' ') AS g FROM (SELECT {key}, ws, unnest(range(1, greatest(len(ws) - {K - 1}, 1) + 1)) AS i FROM {src} WHERE len(ws) > 0))"
    return f"""
WITH t AS (SELECT name, {norm("text")} AS ws FROM (VALUES {values}) v(name, text)),
tg AS {pieces("name", "t")},
tn AS (SELECT name, count(*) AS win, count(DISTINCT g) AS n, greatest(1, count(*) // 8) AS stride FROM tg GROUP BY name),
d AS (SELECT doc_id, {norm("text")} AS ws FROM documents),
dg AS {pieces("doc_id", "d")},
m AS (SELECT doc_id, name, n, g, unnest(range(greatest(0, (p - win - stride + 1 + stride - 1) // stride), (p + stride) // stride + 1)) * stride AS w, p, win, stride FROM (SELECT hit.*, tn.win, tn.n, tn.stride FROM (SELECT doc_id, dg.p, name, g FROM dg JOIN (SELECT DISTINCT name, g FROM tg) USING (g)) hit JOIN tn USING (name))),
c AS (SELECT doc_id, name, w, count(DISTINCT g) / max(n)::DOUBLE AS containment FROM m WHERE p >= w - stride AND p < w + win + stride GROUP BY doc_id, name, w),
b AS (SELECT doc_id, name, max(containment) AS containment FROM c WHERE containment >= {CONTAINMENT} GROUP BY doc_id, name),
o AS (SELECT doc_id, count(*) AS n, string_agg(name || ':' || round(containment * 1000)::BIGINT, ',' ORDER BY name) AS said FROM b GROUP BY doc_id)
SELECT d.doc_id, coalesce(o.n, 0)::BIGINT AS n_licenses, coalesce(said, '') AS licenses FROM d LEFT JOIN o ON o.doc_id = d.doc_id
"""


OP10_SQL = _sql(TEMPLATES)

"""Configuration-key scan: pattern hits with positions, and how a line uses its key."""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
_HITS = "array<struct<pattern: string, ord: int, config_key: string, col: int>>"
_CONTROL = r"\b(if|while|for|switch|else|elif)\b|\?"
_RETURN, _ASSIGN, _CALL = r"\breturn\b", r"[^=!<>]=([^=]|$)", r"\w+\s*\("


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), content: the lines of each text, broken at all of Unicode's line breaks; a trailing one opens none."""
    parts = F.split(F.regexp_replace(F.col(text), rf"({_BREAK})\z", ""), _BREAK)
    return texts.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(parts).alias("line", "content")).withColumn("line", F.col("line") + 1)


def valid(spark: SparkSession, patterns: list[dict]) -> list[dict]:
    """Patterns that compile in the dialect that runs them (Java's), their key_group checked: one that the regex doesn't have reads the whole match."""
    dialect = spark._jvm.java.util.regex
    out = []
    for p in patterns:
        try:
            groups = dialect.Pattern.compile(p["regex"]).matcher("").groupCount()
        except IllegalArgumentException:
            continue
        out.append(p | {"key_group": p.get("key_group", 1) if p.get("key_group", 1) <= groups else 0})
    return out


def literal(regex: str) -> str:
    """Text that every match of a regex holds (the longest such run of letters that is easily seen), or nothing."""
    if "|" in regex or "(?" in regex:
        return ""
    bare = re.sub(r"\\.|\[[^\]]*\]|\([^()]*\)[?*{]?", "\0", regex)
    return max((m[1] for m in re.finditer(r"([A-Za-z_:]{2,})(?![A-Za-z_:?*{])", bare)), key=len, default="")


def _marked(regex: str, group: int) -> Column:
    """Matches in content as an array of key and col (from 1, of the match).

    Every match is put between two marks; cut at the first of them, the line gives pieces whose lengths add up to the columns.
    """
    line = F.regexp_replace("content", "[\x01\x02]", " ")
    pieces = F.split(F.regexp_replace(line, F.lit(regex), F.lit("\x01$0\x02")), "\x01")
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("cols"))
    size = lambda p: F.length(F.replace(p, F.lit("\x02"), F.lit("")))
    cols = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), start, lambda a, p: F.struct((a["at"] + size(p)).alias("at"), F.concat(a["cols"], F.array(a["at"] + size(p))).alias("cols")))["cols"]
    return F.arrays_zip(F.regexp_extract_all(line, F.lit(regex), F.lit(group)).alias("config_key"), cols.alias("col"))


def scan(texts_lines: DataFrame, patterns: list[dict], key: str) -> DataFrame:
    """key, line, content, pattern, ord, config_key, col: every match of every pattern in each line that isn't blank or a comment.

    A pattern is run on lines that hold its literal text only.
    """
    body = texts_lines.where(~F.col("content").rlike(r"^\s*(//.*)?$"))
    each = []
    for i, p in enumerate(valid(texts_lines.sparkSession, patterns)):
        hits, held = F.transform(_marked(p["regex"], p["key_group"]), _hit(p["name"], i)), literal(p["regex"])
        each.append(F.when(F.contains("content", F.lit(held)), hits).otherwise(F.array().cast(_HITS)) if held else hits)
    return body.withColumn("hit", F.explode(F.flatten(F.array(*each)))).select(key, "line", "content", "hit.*")


def _hit(name: str, i: int):
    return lambda k: F.struct(F.lit(name).alias("pattern"), F.lit(i).alias("ord"), k["config_key"].alias("config_key"), k["col"].alias("col"))


def sources(hits: DataFrame, key: str) -> DataFrame:
    """One row for each (key, line, config_key): that of the first pattern."""
    return hits.groupBy(key, "line", "config_key").agg(F.min_by("pattern", "ord").alias("pattern"))


def sources_at(hits: DataFrame, key: str) -> DataFrame:
    """One row for each (key, line, col, config_key): that of the first pattern."""
    return hits.groupBy(key, "line", "col", "config_key").agg(F.min_by("pattern", "ord").alias("pattern"))


def usage(content: Column) -> Column:
    """CONDITION, RETURN, ASSIGNMENT, CALL_ARG or OTHER, in this order of priority."""
    return F.when(content.rlike(_CONTROL), "CONDITION").when(content.rlike(_RETURN), "RETURN").when(content.rlike(_ASSIGN), "ASSIGNMENT").when(content.rlike(_CALL), "CALL_ARG").otherwise("OTHER")

"""Relations of the dataflow engine that are joins of assignments (fn, lhs, rhs, line) with themselves or with calls.

A variable's path begins with a name; its suffix is what follows from the first -> or . on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that an alias can't stand for: numbers, NULL, constants.
_CONSTANT = r"^([0-9].*|NULL|nullptr|true|false|[A-Z][A-Z0-9_]+)$"


def head(var: Column) -> Column:
    return F.regexp_extract(var, r"^\**([A-Za-z_]\w*)", 1)


def suffix(var: Column) -> Column:
    """From the first -> or . on; empty for a plain name."""
    return F.regexp_extract(var, r"(->|\.).*$", 0)


def writers(assigns: DataFrame) -> DataFrame:
    """The assignments by what they write (view lhs) and by its suffix (view suffix), as key."""
    whole = assigns.withColumn("view", F.lit("lhs")).withColumn("key", F.col("lhs"))
    part = assigns.where(suffix(F.col("lhs")) != "").withColumn("view", F.lit("suffix")).withColumn("key", suffix(F.col("lhs")))
    return whole.unionByName(part)


def aliases(assigns: DataFrame) -> DataFrame:
    """fn, name, origin: plain names set to a plain name, its address, or the structure around it; the last one counts, constants are none."""
    around = F.regexp_extract("rhs", r"^container_of\s*\(\s*&?(\w+)", 1)
    origin = F.when(around != "", around).otherwise(F.regexp_extract("rhs", r"^&?\s*([A-Za-z_]\w*)$", 1))
    found = assigns.where(F.col("lhs").rlike(r"^\**\w+$")).withColumn("name", head(F.col("lhs"))).withColumn("origin", origin).where((F.col("origin") != "") & ~F.col("origin").rlike(_CONSTANT) & (F.col("origin") != F.col("name")))
    return found.groupBy("fn", "name").agg(F.max(F.struct("line", "origin"))["origin"].alias("origin"))


def union_members(assigns: DataFrame, unions: DataFrame) -> DataFrame:
    """fn, var, other: writes to different members of one union variable (var) within a function."""
    of = assigns.where(suffix(F.col("lhs")) != "").select("fn", head(F.col("lhs")).alias("union"), "lhs").distinct().join(unions.select(F.col("var").alias("union")).distinct(), "union", "left_semi")
    return of.select("fn", "union", F.col("lhs").alias("var")).join(of.select("fn", "union", F.col("lhs").alias("other")), ["fn", "union"]).where("var <> other").select("fn", "var", "other").distinct()


def partial_writes(assigns: DataFrame) -> DataFrame:
    """fn, var, part: structures that a function never sets as a whole, and the parts of them that it sets."""
    parts = assigns.where(suffix(F.col("lhs")) != "").select("fn", head(F.col("lhs")).alias("var"), F.col("lhs").alias("part")).distinct()
    return parts.join(assigns.select("fn", F.col("lhs").alias("var")).distinct(), ["fn", "var"], "left_anti").select("fn", "var", "part")


def field_writers(assigns: DataFrame, uncalled: DataFrame) -> DataFrame:
    """fn, var, writer: for functions (fn) that nothing calls, other functions that write the same suffix."""
    by = writers(assigns).where("view = 'suffix'").select(F.col("fn").alias("writer"), "key").distinct()
    asked = assigns.where(suffix(F.col("lhs")) != "").select("fn", F.col("lhs").alias("var"), suffix(F.col("lhs")).alias("key")).distinct().join(uncalled.select("fn").distinct(), "fn", "left_semi")
    return asked.join(by, "key").where("fn <> writer").select("fn", "var", "writer").distinct()


def substituted(text: Column, pairs: Column) -> Column:
    """text with each whole word that is a param of pairs (array of param, argument) replaced by its argument, one pair after another."""
    return F.aggregate(pairs, text, lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"\b"), p["param"], F.lit(r"\b")), F.regexp_replace(p["argument"], r"([\\$])", r"\\$1")))


def with_is_param(uses: DataFrame, params: DataFrame) -> DataFrame:
    """uses (fn, var) with is_param: whether the path begins with a parameter (fn, name) of the function."""
    known = params.select("fn", F.col("name").alias("_head")).distinct().withColumn("is_param", F.lit(True))
    return uses.withColumn("_head", head(F.col("var"))).join(known, ["fn", "_head"], "left").select(*uses.columns, F.coalesce("is_param", F.lit(False)).alias("is_param"))


def copies(calls: DataFrame) -> DataFrame:
    """fn, dst, src of memory copies among calls (fn, callee, args); bcopy names its source first."""
    plain = lambda c: F.regexp_replace(F.trim(c), r"^[&(\s]+|[)\s]+$", "")
    found = calls.where(F.col("callee").rlike(r"(^|\W)(memcpy|memmove|bcopy)$") & (F.size("args") >= 2))
    first = F.col("callee").rlike(r"bcopy$")
    return found.select("fn", plain(F.when(first, F.col("args")[1]).otherwise(F.col("args")[0])).alias("dst"), plain(F.when(first, F.col("args")[0]).otherwise(F.col("args")[1])).alias("src"))

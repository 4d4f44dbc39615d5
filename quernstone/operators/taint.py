"""Sinks, chains and specifications of backward dataflow; the trace itself is in ``backward``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCES = [r"\b(cfg|config|settings|params)(->|\.)\w+"]
SINKS = [r"\bregs?(->|\.)\w+", r"\bWRITE_REG\s*\("]


def base(v: Column) -> Column:
    return F.regexp_extract(v, r"^\**([A-Za-z_]\w*)", 1)


def plain(v: Column) -> Column:
    return F.regexp_replace(v, r"^\*+|\[[^\]]*\]", "")


def sinks(assigns: DataFrame, calls: DataFrame, patterns: list[str | dict]) -> DataFrame:
    """sink (its text), fn, path, line, var, pos: what flows into writes and calls that match, by its place among the variables there.

    A pattern is a regex, or has a regex and a value_arg: the number of the argument (from 0, or from -1 backwards) that calls
    write. The last is taken where it names none, or one that the call doesn't have. The first pattern that matches counts.
    """
    patterns = [p if isinstance(p, dict) else {"regex": p} for p in patterns]
    any_of = lambda c: F.expr("false") if not patterns else F.greatest(*[c.rlike(p["regex"]) for p in patterns], F.lit(False))
    written = assigns.withColumn("sink", F.concat_ws(" ", "lhs", "operator", "rhs")).where(any_of(F.col("lhs"))).select("sink", "function", "path", "line", F.posexplode("rhs_vars").alias("pos", "var"))
    text = F.concat("callee", F.lit("("), F.array_join("args", ", "), F.lit(")"))
    at = F.lit(-1)
    for p in reversed(patterns):
        k = p.get("value_arg", -1)
        at = F.when(text.rlike(p["regex"]), F.when(F.size("arg_vars") >= (k + 1 if k >= 0 else -k), k + 1 if k >= 0 else k).otherwise(-1)).otherwise(at)
    called = calls.withColumn("sink", text).where(any_of(text)).select("sink", "function", "path", "line", F.posexplode(F.try_element_at("arg_vars", at)).alias("pos", "var"))
    return written.unionByName(called).select(F.substring("sink", 1, 100).alias("sink"), F.col("function").alias("fn"), "path", "line", plain(F.col("var")).alias("var"), "pos")


def by_sink(paths: DataFrame) -> DataFrame:
    """sink, paths: the distinct paths of each sink, in order."""
    return paths.groupBy("sink").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def chain(steps: Column, sink: Column) -> Column:
    """A path as text, from the source to the sink."""
    return F.concat(F.array_join(F.reverse(steps), " -> "), F.lit(" => "), sink)


def specs(fields: DataFrame, enums: DataFrame, ranges: DataFrame, paths: DataFrame) -> DataFrame:
    """A row for each struct field: type, enum values, range, sinks, functions and description."""
    values = enums.groupBy("enum").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda v: v["value"]).alias("enum_values"))
    last = ranges.withColumn("field", F.regexp_extract("variable", r"(\w+)$", 1)).groupBy("field").agg(F.max_by(F.when(F.col("side") == "min", F.col("bound")), "line").alias("low"), F.max_by(F.when(F.col("side") == "max", F.col("bound")), "line").alias("high"))
    reach = paths.withColumn("field", F.regexp_extract("source", r"(\w+)$", 1)).groupBy("field").agg(F.array_sort(F.collect_set("sink")).alias("sinks"), F.array_sort(F.collect_set("function")).alias("functions"))
    rows = fields.withColumn("enum", F.regexp_replace("type", "^enum ", "")).join(values, "enum", "left").join(last, "field", "left").join(reach, "field", "left")
    empty = F.array().cast("array<string>")
    text = F.concat_ws("; ", "type", F.when(F.col("low").isNotNull() | F.col("high").isNotNull(), F.concat(F.lit("range ["), F.coalesce("low", F.lit("")), F.lit(", "), F.coalesce("high", F.lit("")), F.lit("]"))), F.when(F.size("sinks") > 0, F.concat(F.lit("-> "), F.array_join("sinks", ", "))), F.when(F.size("functions") > 0, F.concat(F.lit("via "), F.array_join("functions", ", "))))
    return rows.select("struct", "field", "type", F.coalesce("enum_values", empty).alias("enum_values"), "low", "high", F.coalesce("sinks", empty).alias("sinks"), F.coalesce("functions", empty).alias("functions"), text.alias("description"))

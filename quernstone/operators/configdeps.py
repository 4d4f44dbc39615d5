"""Relations between configuration fields: shared sinks, gating, ranges, grouped flags, menus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def co_dependencies(uses: DataFrame) -> DataFrame:
    """field, others (ascending): fields that share a sink with it. uses: distinct (sink, field).

    The fields of a sink are listed once and each field unites its sinks' lists, so a sink of n fields makes n
    rows, not n * n.
    """
    sinks = uses.groupBy("sink").agg(F.collect_set("field").alias("fields"))
    listed = uses.join(sinks, "sink").groupBy("field").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("fields")))).alias("all"))
    return listed.select("field", F.array_remove("all", F.col("field")).alias("others")).where(F.size("others") > 0)


def gating_map(pairs: DataFrame, by: str, of: str) -> DataFrame:
    return pairs.groupBy(by).agg(F.array_sort(F.collect_set(of)).alias(of))


def with_ranges(fields: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """fields with low and high: the last bound of each side by ord. bounds: key, side (min or max), bound, ord."""
    last = bounds.groupBy(key).agg(*[F.max_by(F.when(F.col("side") == s, F.col("bound")), F.when(F.col("side") == s, F.col("ord"))).alias(n) for s, n in (("min", "low"), ("max", "high"))])
    return fields.join(last, key, "left")


def at_least(pairs: DataFrame, key: str, n: int) -> DataFrame:
    """Pairs whose key has n or more of them: the aggregation rule of flags."""
    return pairs.join(pairs.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).drop("_n"), key, "left_semi")


def without_known(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


def menus(blocks: DataFrame) -> DataFrame:
    """struct, text: the menu of each struct, its blocks (struct, ord, block) in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda b: b["block"])
    return blocks.groupBy("struct").agg(F.concat(F.lit('menu "'), F.first("struct"), F.lit('"\n'), F.array_join(listed, "\n"), F.lit("\nendmenu")).alias("text"))

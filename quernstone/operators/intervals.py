"""Interval operators: the innermost span around a point, and the definitions that reach a use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str = "at", width: int = 64) -> DataFrame:
    """points (key, at, ..) with span_id of the shortest span (key, span_id, begin, end; both ends included) that holds them, null if none.

    Spans are dealt to cells of width positions, so the join is an equality on (key, cell) and a hot key
    spreads over its cells. Of equally short spans the smallest span_id wins.
    """
    cell = F.floor(F.col("begin") / width), F.floor(F.col("end") / width)
    cells = spans.select(F.col(key).alias("s_key"), "span_id", "begin", "end", F.explode(F.sequence(*cell)).alias("s_cell"))
    near = points.select(key, at).distinct().withColumn("cell", F.floor(F.col(at) / width))
    held = near.join(cells, (near[key] == cells["s_key"]) & (near["cell"] == cells["s_cell"]) & (near[at] >= cells["begin"]) & (near[at] <= cells["end"]))
    best = held.groupBy(key, at).agg(F.min(F.struct((F.col("end") - F.col("begin")).alias("w"), "span_id")).alias("best")).select(key, at, F.col("best.span_id").alias("span_id"))
    return points.join(best, [key, at], "left")


def reaching(defs: DataFrame, uses: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """For each use (keys, line, use_id) its definitions (keys, line, def_id) at or before its line, nearest = 1 the newest, one a line."""
    one = defs.groupBy(*keys, F.col(line).alias("def_line")).agg(F.min("def_id").alias("def_id"))
    pairs = uses.join(one, keys).where(F.col("def_line") <= F.col(line))
    return pairs.withColumn("nearest", F.row_number().over(Window.partitionBy("use_id").orderBy(F.desc("def_line"))))


def last_definition(defs: DataFrame, uses: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """use_id, def_id: the newest definition at or before each use, by one sort of both sides: linear where reaching() is quadratic."""
    both = defs.select(*keys, F.col(line).alias("line"), F.col("def_id"), F.lit(None).cast("long").alias("use_id"), F.lit(0).alias("side")).unionByName(uses.select(*keys, F.col(line).alias("line"), F.lit(None).cast("long").alias("def_id"), F.col("use_id").cast("long"), F.lit(1).alias("side")))
    w = Window.partitionBy(*keys).orderBy("line", "side", F.desc("def_id")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("last", F.last("def_id", ignorenulls=True).over(w)).where("side = 1").select("use_id", F.col("last").alias("def_id"))

"""Catalog operators: search, lookups, joins and counts over symbol, call, file and configuration tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def escaped(text: str) -> str:
    """A literal as a LIKE pattern body."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search(symbols: DataFrame, text: str, kind: str | None = None, limit: int | None = 50, name: str = "name", qualified: str = "qualified_name", key: str = "id") -> DataFrame:
    """Symbols whose name or qualified name holds text, whatever its case; first by name."""
    like = f"%{escaped(text)}%"
    found = symbols.where(F.col(name).ilike(like) | F.col(qualified).ilike(like))
    if kind:
        found = found.where(F.col("kind") == kind.upper())
    return found.orderBy(name, key).limit(limit) if limit else found


def find_by_name(symbols: DataFrame, text: str, limit: int = 5, name: str = "name", qualified: str = "qualified_name", key: str = "id") -> DataFrame:
    """Exact matches if there are any, else the first substring matches."""
    found = symbols.withColumn("exact", (F.col(name) == text) | (F.col(qualified) == text)).where(F.col("exact") | F.col(name).ilike(f"%{escaped(text)}%") | F.col(qualified).ilike(f"%{escaped(text)}%"))
    ranked = found.crossJoin(F.broadcast(found.agg(F.coalesce(F.max("exact"), F.lit(False)).alias("any_exact"))))
    return ranked.where(F.col("exact") | ~F.col("any_exact")).drop("exact", "any_exact").orderBy(name, key).limit(limit)


def neighbours(calls: DataFrame, symbols: DataFrame, of: str, other: str, how: str) -> DataFrame:
    """Calls with the symbol at their other end: inner for callers, left for callees (unresolved ones stay)."""
    ends = symbols.select(F.col("id").alias(other), F.col("name").alias("other_name"))
    return calls.join(ends, other, how)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in order: the distributed form of insert-or-replace and first-wins."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows replacing those of the same keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def replace_groups(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """All of a file's rows replaced by its new ones."""
    return upsert(table, rows, [key])


def list_keys(hits: DataFrame, key: str, kind: str, order: str) -> DataFrame:
    """Keys with their number of hits and the kind of the first."""
    return hits.groupBy(key).agg(F.count("*").alias("n"), F.min_by(kind, order).alias(kind))


def stats(counted: dict[str, DataFrame]) -> DataFrame:
    """name, n: rows of each frame, counted in one job."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in counted.items()])


def store_stats(files: DataFrame, symbols: DataFrame, calls: DataFrame, sources: DataFrame, usages: DataFrame, paths: DataFrame) -> DataFrame:
    """name, n: the nine counts of a store, each table read once."""
    kinds = {"symbols": F.count("*"), "functions": F.count_if(F.col("kind").isin("FUNCTION", "METHOD", "CONSTRUCTOR")), "classes": F.count_if(F.col("kind").isin("CLASS", "STRUCT"))}
    keys = {"config_keys": F.count_distinct("config_key"), "sources": F.count("*")}
    one = lambda df, counted: df.agg(*[c.alias(k) for k, c in counted.items()]).select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("n")) for k in counted])))
    rest = stats({"files": files, "calls": calls, "usages": usages, "dataflow_paths": paths})
    return rest.unionByName(one(symbols, kinds)).unionByName(one(sources, keys))


def fingerprint(rows: DataFrame, key: str, digest: str, width: int = 4096) -> DataFrame:
    """fingerprint: SHA-256 over the rows' "key:digest" lines in key order, by a tree of digests.

    A node's children are those whose keys (not negative) agree but for the last factor of width, so no array is longer
    than width, however many rows there are; a level is one aggregation.
    """
    level = rows.select(F.col(key).cast("long").alias("k"), F.concat(F.col(key).cast("string"), F.lit(":"), digest).alias("d"))
    reach = 1
    while reach < 2**63:
        reach *= width
        listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda x: x["d"])
        level = level.groupBy(F.expr(f"k div {width}").alias("k")).agg(F.sha2(F.array_join(listed, "\n").cast("binary"), 256).alias("d"))
    return level.select(F.col("d").alias("fingerprint"))


def changed(files: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Files whose (key, hash) the state doesn't hold: the incremental gate."""
    return files.join(state.select(*keys).distinct(), keys, "left_anti")

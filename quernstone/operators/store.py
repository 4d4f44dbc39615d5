"""The store's write path: every table after a change, from the table before it and the rows that came in.

Operators give the new table and leave writing to the caller; ``saved`` writes a group of rows (a file's, or a project's)
over the same group's old ones, as partitions, so that a change costs what it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import upsert
from .lookups import resolved


def upsert_projects(table: DataFrame, rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Projects by name: a known name keeps its id and takes the new roots; a new one gets an id from its name."""
    known = table.select("name", F.col("project_id").alias("_id"))
    stamp = F.current_timestamp() if now is None else now
    fresh = rows.select("name", "root_paths").join(known, "name", "left").select(F.coalesce("_id", F.xxhash64("name")).alias("project_id"), "name", "root_paths", stamp.alias("last_indexed"))
    return upsert(table.select(*fresh.columns), fresh, ["name"])


def touched(table: DataFrame, project_id, now: Column | None = None) -> DataFrame:
    """The project's last_indexed set."""
    stamp = F.current_timestamp() if now is None else now
    return table.withColumn("last_indexed", F.when(F.col("project_id") == F.lit(project_id), stamp).otherwise(F.col("last_indexed")))


def replaced(table: DataFrame, rows: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """The table with all rows of files (key) gone and the new rows in their place; a file without new rows keeps none."""
    return table.join(files.select(key).distinct(), key, "left_anti").unionByName(rows)


def linked_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls (file_id, caller_usr, callee_usr, ..) with caller_id and callee_id, looked up in the same file before others; calls of unknown callers are dropped, unknown callees stay null."""
    at = lambda rows, usr, name: resolved(rows.withColumnRenamed(usr, "usr"), symbols).withColumnRenamed("id", name).withColumnRenamed("usr", usr)
    return at(at(calls, "callee_usr", "callee_id"), "caller_usr", "caller_id").where("caller_id IS NOT NULL")


def saved_results(table: DataFrame, project_id, rows: DataFrame) -> DataFrame:
    """Stored paths with those of a project replaced: also when nothing was found, so none are left from an older run."""
    return table.where(F.col("project_id") != F.lit(project_id)).unionByName(rows)


def encoded(paths: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a path as path_json."""
    return paths.withColumn("path_json", F.to_json(F.struct(*columns)))


def decoded(paths: DataFrame, schema: str) -> DataFrame:
    """path_json as the columns it was made from."""
    return paths.withColumn("path", F.from_json("path_json", schema)).select(*[c for c in paths.columns if c != "path_json"], "path.*")


def synced_patterns(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The pattern table after a change of the pattern file: rows as they are there; those that went are kept inactive, as hits may name them."""
    gone = table.join(rows.select("name"), "name", "left_anti").withColumn("is_active", F.lit(False))
    known = table.select("name", F.col("pattern_id").alias("_id"))
    fresh = rows.join(known, "name", "left").withColumn("pattern_id", F.coalesce("_id", F.xxhash64("name"))).withColumn("is_active", F.lit(True)).drop("_id")
    return gone.unionByName(fresh.select(*gone.columns))


def mark_scanned(state: DataFrame, files: DataFrame) -> DataFrame:
    """The scan state (file_id, file_hash, patterns) after files were scanned: one row a file, the newest."""
    return upsert(state, files.select(*state.columns), ["file_id"])


def rescanned(hits: DataFrame, due: DataFrame, found: DataFrame) -> DataFrame:
    """All hits after a scan of the due files only: their old hits are replaced, the others' stay."""
    return replaced(hits, found, due)


def parse_due(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose (file_id, file_hash) the parse cache doesn't hold."""
    return files.join(cache.select("file_id", "file_hash").distinct(), ["file_id", "file_hash"], "left_anti")


def cache_valid(cache: DataFrame, files: DataFrame) -> DataFrame:
    """The parse cache without entries of files that changed or went."""
    return cache.join(files.select("file_id", "file_hash"), ["file_id", "file_hash"], "left_semi")


def saved(rows: DataFrame, path: str, group: str) -> DataFrame:
    """Write rows below path, a partition each group; groups that rows hold are replaced, others stay."""
    spark: SparkSession = rows.sparkSession
    rows.repartition(group).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(path)
    return spark.read.parquet(path)

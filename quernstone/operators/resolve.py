"""Tiered resolution of included paths: exact, then by suffix, then by a unique base name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (want) with file_id and tier (1 exact path, 2 path ends in /want: the smallest id, 3 base name of one file only; null unresolved).

    Each tier is an equi-join: files are exploded into their path suffixes, never compared pair by pair.
    """
    asked = wanted.select("want").distinct()
    exact = files.groupBy(F.col("path").alias("want")).agg(F.min("file_id").alias("f1"))
    parts = F.split("path", "/")
    suffixes = files.select("file_id", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("want"))
    by_suffix = suffixes.where("want <> ''").groupBy("want").agg(F.min("file_id").alias("f2"))
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    unique = files.groupBy(base("path").alias("base")).agg(F.count("*").alias("n"), F.min("file_id").alias("f3")).where("n = 1").drop("n")
    found = asked.join(exact, "want", "left").join(by_suffix, "want", "left").withColumn("base", base("want")).join(unique, "base", "left")
    tier = F.when(F.col("f1").isNotNull(), 1).when(F.col("f2").isNotNull(), 2).when(F.col("f3").isNotNull(), 3)
    return wanted.join(found.select("want", F.coalesce("f1", "f2", "f3").alias("file_id"), tier.alias("tier")), "want", "left")


def owning_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files (path, ..) with root: the longest of roots (root) that holds the path as a folder or is the path; null where none does.

    An equi-join on the folders around each path, of which there are as many as it has parts; roots are never compared with all paths.
    """
    known = roots.select(F.rtrim(F.col("root"), F.lit("/")).alias("folder"), "root").groupBy("folder").agg(F.min("root").alias("root"))
    parts = F.split(F.rtrim(F.col("path"), F.lit("/")), "/")
    asked = files.select("path").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("folder"))
    found = asked.join(known, "folder").groupBy("path").agg(F.max_by("root", F.length("folder")).alias("root"))
    return files.join(found, "path", "left")

"""A parse cache on disk: a manifest of files with their length and time, and what was parsed, in partitions by file.

A refresh lists the files without their content. Those whose length and time the manifest holds stay as they are; the rest is
read (the reader is given the earliest of their times, so that it doesn't open what is older), parsed, and written into the partitions
that hold them. What was parsed of files that went is no longer in the manifest, and so no longer seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cache import _exists
from ..operators.graph import checkpointed
from ..operators.store import saved
from . import files

#: Partitions of the cache; a changed file costs the one that holds it.
PARTS = 256


def _part(file_id: str = "file_id"):
    return F.pmod(F.col(file_id), F.lit(PARTS)).cast("int")


def refresh(spark: SparkSession, roots: Sequence[str], store: str) -> DataFrame:
    """file_id, path, the entities as arrays, root, file_hash, line_count, part of all files below roots, after those that changed were parsed."""
    listed = checkpointed(files.listing(spark, roots))
    old = spark.read.parquet(f"{store}/manifest") if _exists(spark, f"{store}/manifest/_SUCCESS") else None
    known = checkpointed(old) if old is not None else listed.limit(0)
    due = checkpointed(listed.join(known, ["file_id", "full", "length", "modified"], "left_anti"))
    since = due.agg(F.min("modified")).first()[0]
    if since is not None:
        rows = files.collect(spark, roots, since).join(due.select("file_id"), "file_id", "left_semi")
        of = rows.select("file_id", "root", "file_hash", "line_count")
        made = checkpointed(files.parse(rows).join(of, "file_id").withColumn("part", _part()))
        if old is not None:
            touched = [r.part for r in due.select(_part().alias("part")).distinct().collect()]  # PARTS at most
            rest = spark.read.parquet(f"{store}/parsed").where(F.col("part").isin(touched)).join(due.select("file_id"), "file_id", "left_anti")
            made = checkpointed(made.unionByName(rest.select(*made.columns)))
        saved(made, f"{store}/parsed", "part")
    listed.write.mode("overwrite").parquet(f"{store}/manifest")
    if not _exists(spark, f"{store}/parsed"):
        return files.parse(files.collect(spark, roots).limit(0)).select("*", F.lit("").alias("root"), F.lit("").alias("file_hash"), F.lit(0).alias("line_count"), F.lit(0).alias("part"))
    return spark.read.parquet(f"{store}/parsed").join(listed.select("file_id"), "file_id", "left_semi")

"""Result and scan-state tables: entries valid while their key and the inputs' fingerprint are the same."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def trace_key(depth: int, sources: list[str], sinks: list[str], macro_sinks: bool = True) -> str:
    """Everything that a trace depends on besides the files."""
    return hashlib.sha256(json.dumps([depth, sorted(sources), sorted(sinks), macro_sinks]).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, root: str, key: str, fingerprint: str, make) -> DataFrame:
    """The stored result of (key, fingerprint), made and stored if there is none."""
    path = f"{root}/{key[:32]}-{fingerprint[:32]}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def pattern_key(patterns: list[dict]) -> str:
    return hashlib.sha256(json.dumps(patterns, sort_keys=True).encode()).hexdigest()


def to_scan(files: DataFrame, state: DataFrame, patterns: list[dict]) -> DataFrame:
    """Files whose content or pattern set was not scanned yet; state: file_id, file_hash, patterns."""
    now = files.withColumn("patterns", F.lit(pattern_key(patterns)))
    return now.join(state.select("file_id", "file_hash", "patterns"), ["file_id", "file_hash", "patterns"], "left_anti")

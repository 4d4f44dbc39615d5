"""An extension: a watched folder as a stream of changed sources, scanned as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import patterns


def watched(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    """A stream of path, text: each new file once, whole."""
    return spark.readStream.schema("value string").option("wholetext", True).option("maxFilesPerTrigger", most_files).option("recursiveFileLookup", True).format("text").load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def scanned(stream: DataFrame, rules: list[dict]) -> DataFrame:
    """Pattern hits of a stream of texts with the usage of their line; stateless, so it needs no watermark."""
    hits = patterns.scan(patterns.lines(stream, "path", "text"), rules, "path")
    return hits.withColumn("usage", patterns.usage(F.col("content")))

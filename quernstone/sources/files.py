"""Source trees as frames: files with content, hash and root; entity tables from the C front end."""

from __future__ import annotations

import os
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import cfront

#: Suffixes that are read, and folders that are not (besides those that begin with a dot).
SUFFIXES = ("c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx")
SKIPPED = ("build", "cmake-build-debug", "cmake-build-release", "node_modules", "_deps", "third_party", "vendor")
FILES = "file_id bigint, root string, path string, file_hash string, line_count int"


def _raw(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """The files below roots as binaryFile reads them; others are never opened, and content is read only where it is selected."""
    named = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in x) for x in SUFFIXES) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", named).load(list(roots))


def _placed(raw: DataFrame, roots: Sequence[str]) -> DataFrame:
    """raw with full, root and path, without files in skipped folders."""
    plain = lambda p: "/" + p.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    full = F.regexp_replace("path", "^[a-z]+:(//)?(?=/)", "")
    owner = F.array_max(F.filter(F.array(*[F.struct(F.lit(len(plain(r))).alias("n"), F.lit(plain(r)).alias("root")) for r in roots]), lambda r: F.startswith(full, r["root"])))
    rows = raw.withColumn("full", full).withColumn("root", owner["root"]).where("root IS NOT NULL").withColumn("path", F.expr("substring(full, length(root) + 1)"))
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    return rows.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*SUFFIXES) & ~F.exists(folders, lambda f: f.startswith(".") | f.isin(*SKIPPED)))


def listing(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """file_id, full, length, modified of the files that collect() would read; their content isn't."""
    found = _placed(_raw(spark, roots).select("path", "length", "modificationTime"), roots)
    return found.select(F.xxhash64("root", "path").alias("file_id"), "full", "length", F.col("modificationTime").alias("modified"))


def collect(spark: SparkSession, roots: Sequence[str], since=None) -> DataFrame:
    """file_id, root, path (relative to the longest root that holds it), content, file_hash, line_count; since: only files modified then or later, others are not opened."""
    raw = _raw(spark, roots)
    rows = _placed(raw if since is None else raw.where(F.col("modificationTime") >= F.lit(since)), roots)
    return rows.select(F.xxhash64("root", "path").alias("file_id"), "root", "path", "content", F.sha2("content", 256).alias("file_hash"), (F.size(F.split(F.decode("content", "UTF-8"), "\n"))).alias("line_count"))


def _nested() -> T.StructType:
    kinds = [T.StructField(k, T.ArrayType(T._parse_datatype_string(v))) for k, v in cfront.ENTITIES.items()]
    return T.StructType([T.StructField("file_id", T.LongType()), T.StructField("path", T.StringType()), *kinds])


def parse(files: DataFrame) -> DataFrame:
    """One row a file with all its entities as arrays: parsed once, pruned by column afterwards."""

    schema = _nested()

    def run(parts):
        for p in parts:
            rows = []
            for i, path, content in zip(p["file_id"], p["path"], p["content"], strict=True):
                found = cfront.extract(bytes(content).decode("utf-8", "replace"))
                rows.append((i, path, *[found[k] for k in cfront.ENTITIES]))
            yield pd.DataFrame(rows, columns=schema.names)

    return files.select("file_id", "path", "content").mapInPandas(run, schema)


def entity(parsed: DataFrame, kind: str) -> DataFrame:
    """A kind's rows with their file."""
    return parsed.select("file_id", "path", F.posexplode(kind).alias("ord", "e")).select("file_id", "path", "ord", "e.*")


def corpus() -> str:
    """The folder of the small C sources that come with the engine."""
    return os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "corpus")


def corpus_frame(spark: SparkSession) -> DataFrame:
    """The corpus as collect() gives it, from the driver's copy: five small files of fixed size, so that executors need no shared folder."""
    rows = []
    for name in sorted(os.listdir(corpus())):
        if name.rsplit(".", 1)[-1] in SUFFIXES:
            with open(os.path.join(corpus(), name), "rb") as f:
                rows.append(("corpus", name, bytearray(f.read())))
    made = spark.createDataFrame(rows, "root string, path string, content binary")
    return made.select(F.xxhash64("root", "path").alias("file_id"), "root", "path", "content", F.sha2("content", 256).alias("file_hash"), F.size(F.split(F.decode("content", "UTF-8"), "\n")).alias("line_count"))

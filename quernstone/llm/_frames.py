"""Frames, folders and session settings shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._text import buffers

#: Rows of an Arrow batch; a batch of very long texts is cut by bytes too.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20

#: Writing rows of megabytes: Parquet looks at the size of a row group every 100 rows otherwise, and holds them all in memory until then, as does who reads them.
BIG_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}

_recorders: list[list[str]] = []


@contextmanager
def recorded():
    """The folders that shared_dir makes within."""
    made: list[str] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders.pop()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, which is set only where it is unset and the master local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="quernstone-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _recorders:
        made.append(path)
    return path


def tune(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def release() -> None:
    """Give memory that a step of a Python worker is done with back to the system: idle workers live on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function over batches that gives memory back when it has seen the last one."""

    def lean_run(batches):
        yield from run(batches)
        release()

    return lean_run


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written below the shared folder and read again: its lineage ends there and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove folders below the shared one that nothing will read again, and let Spark drop the shuffles of frames that are gone."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    spark._jvm.System.gc()


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def map_text(df: DataFrame, fn: Callable, out: str, text: str = "text", keep: Sequence[str] = ("doc_id",), flat: bool = True) -> DataFrame:
    """Columns of keep and out (struct): fn(data, offs) gives the arrays of out for a batch of whole texts.

    No shuffle; row for row, so repeated rows and null keys need no care. Not flat: the
    columns of keep stay a struct keep (fields c0, c1, ..), for inputs that may have an out themselves.
    """
    tune(df.sparkSession)
    source = df.select(F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("keep"), quoted(text).cast("binary").alias("text"))
    schema = T.StructType([source.schema["keep"], T.StructField("out", T._parse_datatype_string(out))])
    want = arrow_schema(schema)

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            data, offs = buffers(b.column(1))
            cols = [pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(fn(data, offs), want.field("out").type, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(want.field("keep").type), pa.StructArray.from_arrays(cols, fields=list(want.field("out").type))], schema=want)
        release()

    made = source.mapInArrow(run, schema)
    if not flat:
        return made
    return made.select(*[F.col(f"keep.c{i}").alias(c) for i, c in enumerate(keep)], "out")


def unpacked(df: DataFrame, names: Sequence[str], struct: str = "keep") -> DataFrame:
    """The columns that a struct of fields c0, c1, .. holds, by their names."""
    return df.select(*[F.col(f"{struct}.c{i}").alias(c) for i, c in enumerate(names)])

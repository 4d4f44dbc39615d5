import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    """Write small tables as a data folder: folder(documents=[(id, text), ...], benchmark=..., pages=...)."""

    def make(documents=(), benchmark=(), pages=()):
        rows = [(*r, "en", "s", len(r[1] or "")) if len(r) == 2 else r for r in documents]
        # extra columns whose names clash with what operators make
        spark.createDataFrame(rows, COLUMNS).withColumns({"keep": F.lit(1), "out": F.lit("x"), "n_words": F.lit(None).cast("int"), "key": F.lit("k")}).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(benchmark), "item_id long, text string").withColumn("window", F.lit(3)).write.parquet(f"{tmp_path}/benchmark.parquet")
        spark.createDataFrame(list(pages), "page_id long, url string, html string").withColumns({"digest": F.lit(1), "n": F.lit(2)}).write.parquet(f"{tmp_path}/pages.parquet")
        return str(tmp_path)

    return make


def rows(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=repr)


@pytest.fixture(name="rows")
def _rows():
    return rows


@pytest.fixture
def duck():
    """Rows of a DuckDB query over the tables of a data folder, as rows() gives them."""
    import glob
    import os

    import duckdb

    def run(sql, path):
        con = duckdb.connect()
        for t in ("documents", "benchmark", "pages"):
            p = f"{path}/{t}.parquet"
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'") if glob.glob(p) else None
        got = con.sql(sql)
        return sorted((dict(zip(got.columns, r, strict=True)) for r in got.fetchall()), key=repr)

    return run

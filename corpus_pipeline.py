"""The corpus pipeline: language, near duplicates, benchmark leaks, personal data, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import byte_bpe, langid, near_dup, phrase_index, pii
from quernstone.llm._frames import discard, recorded, stored, table

#: Folders that the stage before has written for itself.
_left: list[str] = []


def _tidy(step):
    """The stage, after what the stage before it left in the shared folder is removed: its result has been written, as this one reads it."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, *_left)
        _left.clear()
        with recorded() as made:
            out = step(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run


#: Each step takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("language", _tidy(langid.stage)),
    ("near_duplicates", _tidy(near_dup.stage)),
    ("benchmark", _tidy(phrase_index.stage)),
    ("personal_data", _tidy(pii.stage)),
    ("tokens", _tidy(byte_bpe.stage)),
]

#: Learned languages, sketches and merges have no SQL form; tests hold the steps against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written below the shared folder and read again; a stage's input is removed when its output stands.

    Null and empty texts have no language and go; repeated rows are near duplicates of each other, so one stays; rows with a null key
    are documents of their own; an empty table gives no rows; columns of any name pass through.
    """
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, step in STAGES:
        with recorded() as made:
            docs = stored(step(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, *before)
        before = made[-1:]
    return docs

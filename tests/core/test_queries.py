"""Every query with SQL against DuckDB, over whole small tables."""

import glob
import math
import os

import duckdb
import pytest
from quernstone import catalogue

SF = "/root/testdata/sf0.001"

#: Rows of the queries that read the bundled sources (C only, so without base classes), whatever the tables are; test_code.py holds what is in them.
ROWS = {
    "code_call_graph": 7, "code_enclosing": 12, "code_include_graph": 5, "config_defaults": 4, "config_dependencies": 19, "config_overrides": 4, "config_specs": 11,
    "extract_assignments": 24, "extract_bases": 0, "extract_calls": 12, "extract_cascades": 3, "extract_cli": 4, "extract_diagnostics": 0, "extract_enum_values": 3,
    "extract_fields": 11, "extract_gates": 5, "extract_guarded": 7, "extract_includes": 7, "extract_locals": 5, "extract_macros": 2, "extract_params": 17, "extract_ranges": 2,
    "extract_returns": 3, "extract_symbols": 32, "extract_tables": 2, "extract_union_vars": 0, "extract_unions": 1, "taint_trace": 4,
}


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    if name in catalogue.ORACLES:
        want = con.sql(catalogue.ORACLES[name])
        assert sorted(want.columns) == cols
        at = [want.columns.index(c) for c in cols]
        assert got == sorted(tuple(cell(r[i]) for i in at) for r in want.fetchall())
    else:
        assert len(got) == ROWS[name]
        assert len(set(got)) == len(got)

from __future__ import annotations

import os
from collections import Counter

import pytest

from ledgerloom.plans import decoders, filings, general, general_sql

SQL = {**general_sql.SQL, **filings.SQL, **decoders.SQL}
QUERIES = {**general.QUERIES, **filings.QUERIES, **decoders.QUERIES}


def normal(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = Counter(tuple(normal(v) for v in r) for r in want.fetchall())
    assert Counter(tuple(normal(v) for v in r) for r in got.select(*columns).collect()) == rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_columns_of_the_stated_queries(spark, sf):
    want = {
        "p1_found": [("file_id", "bigint"), ("sheet_name", "string"), ("field", "string"), ("change", "string")],
        "p2_found": [("snapshot_no", "int"), ("ticker", "string"), ("url", "string"), ("change", "string")],
        "p3_found": [("fact_id_a", "bigint"), ("fact_id_b", "bigint")],
        "p4_found": [("ticker", "string"), ("period", "string"), ("concept", "string")],
        "p5_found": [("src", "string"), ("parent_id", "bigint"), ("outer_no", "int"), ("inner_no", "int")],
    }
    for name, columns in want.items():
        assert QUERIES[name](spark, sf).dtypes == columns


def test_nothing_outside_the_subpackage_imports_it():
    import pathlib
    import re

    import ledgerloom

    root = pathlib.Path(ledgerloom.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"(?:import|from)\s[^\n]*\bllm\b", path.read_text()), path

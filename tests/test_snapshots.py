from __future__ import annotations

from datetime import datetime

from ledgerloom.operators.snapshot_diff import snapshot_changes

SCHEMA = "snapshot_no int, ticker string, name string, ir_page string, presentations array<struct<url:string,title:string,period:string,year:int>>, loaded_at timestamp, change string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)  # a column named like a result's
    return sorted((tuple(r) for r in snapshot_changes(df).collect()), key=str)


T = [datetime(2024, 1, d) for d in range(1, 9)]


def test_changes(spark):
    p = ("u1", "t", "Q1", 2020)
    rows = [
        (1, "A", "a", None, [p, ("u2", "t", "Q1", 2020)], T[0]),
        (1, "B", "b", "", None, T[0]),
        (3, "A", " a\n", "", [("u3 ", "t", "Q1", 2020), (" u1", "t ", "Q1", 2020), ("u1", "t", "Q1", 2020)], T[1]),
        (3, "C", "c", "x", [p], T[1]),
        (3, "C", "c", "x", [p], T[1]),
        (4, "A", "a", "new", [("u1", "t2", "Q1", 2020), ("u3", "t", "Q1", None)], T[2]),
        (4, "A", "wrong", "new", [], T[1]),
        (4, "C", "c", "x", [p], T[2]),
    ]
    assert run(spark, rows) == sorted([
        (3, "B", "", "removed"), (3, "C", "", "added"), (3, "A", "u2", "removed"), (3, "A", "u3", "added"),
        (4, "A", "", "changed"), (4, "A", "u1", "changed"), (4, "A", "u3", "changed"),
    ], key=str)


def test_nulls_and_empty(spark):
    assert run(spark, []) == []
    rows = [(1, None, "a", None, None, None), (2, None, "b", None, [(None, "t", None, None)], None), (None, "Z", "z", None, None, T[0])]
    assert run(spark, rows) == [(2, None, "", "changed")]


def test_many_children(spark):
    old = [(f"u {k}", f"t{k}", "Q1", 2020) for k in range(3000)]
    new = [(f"u {k}", f"t{k + (k % 1000 == 0)}", "Q1", 2020) for k in range(1, 3002)] + [("u 5", "other", "Q1", 2020)]
    rows = [(1, "A", "a", None, old, T[0]), (2, "A", "a", None, new, T[1])]
    assert run(spark, rows) == sorted([(2, "A", "u 0", "removed"), (2, "A", "u 3000", "added"), (2, "A", "u 3001", "added"), (2, "A", "u 1000", "changed"), (2, "A", "u 2000", "changed"), (2, "A", "u 5", "changed")], key=str)

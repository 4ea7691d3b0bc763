from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from ledgerloom.operators import schema_drift as sd
from ledgerloom.operators.sequence import with_previous
from ledgerloom.plans import general

SCHEMA = "file_id bigint, feed_id bigint, delivered_at timestamp, body string"


def body(*sheets):
    return json.dumps({"sheets": [{"name": n, "items": [{"label": lab, "values": v} for lab, v in items]} for n, items in sheets]})


def changes(spark, rows):
    df = spark.createDataFrame([(f, g, datetime(2024, m, 1), b) for f, g, m, b in rows], SCHEMA)
    got = sd.schema_changes(sd.fingerprints(df)).select("file_id", "sheet_name", "field", "change").collect()
    return sorted(tuple(r) for r in got)


def test_every_kind_of_change(spark):
    a = body(("S", [("x", {"p": 1, "q": "t"}), ("y", {"p": "n/a", "q": "u"}), ("z", {"p": 3})]), ("Old", [("k", {"v": 1}), ("l", {"v": 2})]), ("Gone", [("m", {"w": 1})]))
    b = body(("S", [("x", {"p2": 1, "q": 2, "r": True})]), ("New", [("K ", {"v": 1}), ("l", {"v": 2})]), ("Other", [("m2", {"w": 1})]))
    assert changes(spark, [(1, 1, 1, a), (1, 1, 1, a), (2, 1, 2, b)]) == [
        (2, "Gone", "", "removed"), (2, "New", "", "renamed"), (2, "Other", "", "added"), (2, "S", "p2", "renamed"), (2, "S", "q", "retyped"), (2, "S", "r", "added"),
    ]


def test_first_file_and_bad_bodies(spark):
    a, b = body(("S", [("x", {"p": 1})])), body(("S", [("x", {"p": 1, "q": 1})]))
    # the unreadable file has no schema, so the third is compared with the first
    assert changes(spark, [(1, 1, 1, a), (2, 1, 2, "{cut"), (3, 1, 3, b), (4, None, 4, a), (5, 2, 1, None)]) == [(3, "S", "q", "added")]
    assert changes(spark, []) == []


def test_previous_equals_plain_window(spark):
    from pyspark.sql import Window

    df = spark.range(500).select((F.col("id") % 3).alias("s"), (F.col("id") * 7919 % 501).alias("o"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    got = with_previous(df, ["s"], ["o"], F.floor(F.col("o") / 60), F.col("v"), "p")
    want = df.withColumn("p", F.lag("v").over(Window.partitionBy("s").orderBy("o")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_chained_migration(spark):
    rows = [
        (1, 1, 1, body(("A", [("x", {"p": 1, "old": "5"})]))),
        (2, 1, 2, body(("A", [("x", {"p2": 1, "old": 5})]))),
        (3, 1, 3, body(("B", [("X", {"p3": 1, "old": 5, "more": "t"})]))),
    ]
    df = spark.createDataFrame([(f, g, datetime(2024, m, 1), b) for f, g, m, b in rows], SCHEMA)
    got = {(r["file_id"], r["sheet_name"], r["field"]): (r["number"], r["text"], r["rules"]) for r in sd.consistent_items(df).collect()}
    assert got[1, "B", "p3"] == (1.0, "1", ["rename sheet", "rename field"]) or got[1, "B", "p3"][2].count("rename field") == 2
    assert got[1, "B", "old"][0] == 5.0 and "cast number" in got[1, "B", "old"][2]
    assert got[1, "B", "more"] == (None, None, ["default"])
    assert got[3, "B", "p3"] == (1.0, "1", [])


def test_order_within_a_millisecond_and_unreadable_bodies(spark):
    at = [datetime(2024, 1, 1, 0, 0, 0, k) for k in (300, 200, 100)]
    rows = [
        (1, 1, at[0], body(("A", [("x", {"new": 1})]))), (2, 1, at[1], body(("A", [("x", {"mid": 1})]))), (3, 1, at[2], body(("A", [("x", {"old": 1})]))),
        (4, 1, at[0], "{"), (5, None, at[0], body(("A", []))), (6, 2, None, None), (7, 2, at[0], body(("S", [("x", {"a": 1, "b": "t"})]))), (8, 2, None, body(("S", [("x", {"a": 2})]))),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["file_id"], r["field"]): (r["text"], r["rules"]) for r in sd.consistent_items(df).collect()}
    assert got == {(1, "new"): ("1", []), (2, "new"): ("1", ["rename field"]), (3, "new"): ("1", ["rename field"] * 2), (7, "a"): ("1", []), (7, "b"): ("t", []), (8, "a"): ("2", []), (8, "b"): (None, ["default"])}
    assert sorted(map(tuple, sd.unreadable_statements(df).collect())) == [(4, "no statement"), (5, "no feed"), (6, "no statement")]
    assert sd.consistent_items(df.limit(0)).count() == 0


def test_found_against_brute_force(spark, sf):
    rows = {r["file_id"]: r for r in general.table(spark, sf, "statement_files").collect()}
    feeds: dict = {}
    for r in rows.values():
        feeds.setdefault(r["feed_id"], []).append(r)
    want = set()
    for files in feeds.values():
        files.sort(key=lambda r: (r["delivered_at"], r["file_id"]))
        for p, c in zip(files, files[1:], strict=False):
            want |= {(c["file_id"], s, f, w) for s, f, w, _ in sd.compare(sd.describe(p["body"]), sd.describe(c["body"]))}
    got = [tuple(r) for r in general.p1_found(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want

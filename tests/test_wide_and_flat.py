from __future__ import annotations

import json
from datetime import date, datetime

from ledgerloom.operators import flatten, wide
from ledgerloom.plans import general

CONCEPTS = [("Name", "string"), ("When", "date"), ("Flag", "boolean"), ("Staff", "integer"), ("Price", "double"), ("ticker", "string")]
COVER = "cover_id bigint, ticker string, concept string, value double, raw_text string, unit string, period string, decimals string, loaded_at timestamp"


def build(spark, rows):
    df = spark.createDataFrame([(i, t, c, 0.0, x, "", p, "", datetime(2024, 1, d)) for i, (t, p, c, x, d) in enumerate(rows)], COVER)
    concepts = spark.createDataFrame(CONCEPTS, "concept string, data_type string")
    return wide.wide_table(wide.cells(df, concepts), wide.declared_attributes(concepts))


def test_wide(spark):
    rows = [
        ("A", "P", "dei:Name", "x  y", 1), ("A", "P", " NAME", "x y", 2), ("A", "P", "dei_When", "31/12/2020", 1), ("A", "P", "When", "2020-12-31", 2), ("A", "P", "flag", "Ya", 1), ("A", "P", "flag", "N", 3), ("A", "P", "flag", "?", 4),
        ("A", "P", "Staff", "1.200", 1), ("A", "P", "Price", "3,50", 1), ("A", "P", "ext:Other", "1", 1), ("A", "P", "ticker", "T", 1), (None, "P", "Name", "z", 1), ("", "P", "Name", "z", 1), ("B", None, "Price", "no", 1), ("A", "P", None, "z", 1),
    ]
    got = {(r["ticker"], r["period"]): r for r in build(spark, rows).collect()}
    a = got["A", "P"]
    assert (a["Name"], a["When"], a["Flag"], a["Staff"], a["Price"], a["ticker_value"]) == ("x y", date(2020, 12, 31), False, 1200, 3.5, "T")
    assert a["conflicts"] == ["Flag"]
    assert got["B", None]["Price"] is None and got["B", None]["conflicts"] == [] and len(got) == 2
    assert build(spark, []).count() == 0


def test_more_attributes_than_a_table_takes(spark):
    rows = [("A", "P", c, v, 1) for c, v in (("Name", "x"), ("When", "2020-01-02"), ("Flag", "y"), ("Staff", "7"), ("Price", "1.5"))] + [("B", "P", "Price", "2", 1), ("B", "P", "Price", "3", 2)]
    df = spark.createDataFrame([(i, t, c, 0.0, x, "", p, "", datetime(2024, 1, d)) for i, (t, p, c, x, d) in enumerate(rows)], COVER)
    concepts = spark.createDataFrame(CONCEPTS, "concept string, data_type string")
    cell, attributes = wide.cells(df, concepts), wide.declared_attributes(concepts)
    whole = {r["ticker"]: r.asDict() for r in wide.wide_table(cell, attributes).collect()}
    got: dict = {}
    for t in wide.wide_tables(cell, attributes, most=2):
        for r in t.collect():
            mine = got.setdefault(r["ticker"], dict.fromkeys(whole["A"]) | {"conflicts": []})
            mine.update({k: v for k, v in r.asDict().items() if k != "conflicts"})
            mine["conflicts"] = mine["conflicts"] + r["conflicts"]
    assert got == whole


def test_wide_round_trip_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(f"T{i % 50:03}", f"P{i % 7}", c, str(i % 50 * 10 + i % 7), 1) for i in range(350) for c in ("Staff", "Price", "Name")]
        got = build(spark, rows).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(got) == 350
    for r in got:
        n = int(r["ticker"][1:]) * 10 + int(r["period"][1:])
        assert (r["Staff"], r["Price"], r["Name"]) == (n, float(n), str(n))


def test_positions_wrapping_and_bad_bodies(spark):
    good = {"Results": [None, {"Attachments": [{"a": 1}, None, "x", {"a": 2}]}, {"Attachments": {"a": 3}}, {}]}
    text = json.dumps(good)
    rows = [(1, text), (1, text), (2, json.dumps(text)), (3, "﻿" + json.dumps({"Results": {"Attachments": [{}]}})), (4, text[:-4]), (5, ""), (6, None), (7, "<html>"), (8, "[1]"), (9, '{"Results": NaN}'), (None, json.dumps({"Results": [{"Attachments": {}}]}))]
    df = spark.createDataFrame(rows, "id bigint, body string")
    flat = flatten.flatten(df, "id", "body", flatten.RESPONSE, ("attachment",))
    got = sorted(((r["parent_id"], r["outer_no"], r["inner_no"]) for r in flat.collect()), key=str)
    assert got == sorted([(1, 1, 0), (1, 1, 3), (1, 2, 0), (2, 1, 0), (2, 1, 3), (2, 2, 0), (3, 0, 0), (None, 0, 0)], key=str)
    variants = {r["variant"]: r["n_objects"] for r in flatten.variant_tables(flat).collect()}
    assert variants == {'attachment{"a":"num"}': 6, "attachment": 2}
    bad = sorted(((r["parent_id"], r["reason"]) for r in flatten.unreadable(df, "id", "body").collect()))
    assert bad == [(4, "no complete JSON"), (5, "empty"), (6, "null"), (7, "no complete JSON"), (8, "no object"), (9, "no complete JSON")]
    typed = flatten.subtype_table(flat, "attachment", "a int").where("parent_id = 1").collect()
    assert sorted(r["a"] for r in typed) == [1, 2, 3]


def test_automaton_states():
    assert flatten.state({"b": [1, "x", None], "a": True}) == '{"a":bool,"b":[num|str]}'
    assert flatten.state([{"x": 1}, {"x": 2.5, "y": None}, {}]) == "[<>|<num>]"
    # dictionaries: data in the names of members makes no state of its own
    assert flatten.state({"2016": 1, "2015": None}) == flatten.state({"2019": 2.5}) == "<num>"
    assert flatten.state({"2016": [1], "2015": [2]}) == "<[num]>"
    deep: object = 1
    for _ in range(50_000):
        deep = [deep]
    assert flatten.state(deep) == "[" * 50_000 + "num" + "]" * 50_000


def test_optional_members_make_no_variants():
    t = {"a": "str", "b": "<num>", "c": "[str]"}
    for x in ({}, {"a": None}, {"a": "x", "b": {}}, {"b": {"2016": 1, "2017": None}, "c": []}, {"extra": None, "more": []}):
        assert flatten.departures(x, t, None) == ()
    assert flatten.departures({"a": 1, "z": {"k": "v"}, "n": [1]}, t, "n") == (("a", "num"), ("z", "<str>"))


def test_bodies_wrapped_any_number_of_times_and_nested_deep():
    body = json.dumps({"Results": {"Attachments": {"a": 1}}})
    for _ in range(12):
        body = json.dumps(body)
    assert [n[:3] for n in flatten.nodes(body, flatten.RESPONSE)] == [("result", 0, -1), ("attachment", 0, 0)]
    deep = '{"Results": [{"Attachments": [{"a": ' + "[" * 2000 + "]" * 2000 + "}]}]}"
    assert [n[:3] for n in flatten.nodes(deep, flatten.RESPONSE)] == [("result", 0, -1), ("attachment", 0, 0)]


def test_variant_tables_are_typed(spark):
    body = json.dumps({"Results": [{"Attachments": [{"a": 1, "parent_id": "x", "b": [True], "c": {"d": "t"}}, {"a": "s", "File_Size": 3}, {"A": 1, "a": 2}, {"z": [1, "x"]}, {"File_Size": 7, "File_Name": "f"}, {"File_Name": None}]}]})
    level = flatten.RESPONSE
    flat = flatten.flatten(spark.createDataFrame([(1, body)], "id bigint, body string"), "id", "body", level, ("attachment",))
    variants = {r["variant"]: r["n_objects"] for r in flatten.variant_tables(flat).collect()}
    wide = 'attachment{"a":"num","b":"[bool]","c":"<str>","parent_id":"str"}'
    assert variants == {"attachment": 2, wide: 1, 'attachment{"a":"str"}': 1, 'attachment{"A":"num","a":"num"}': 1, 'attachment{"z":"[num|str]"}': 1}
    base = flatten.variant_table(flat, "attachment", level)
    assert dict(base.dtypes)["File_Size"] == "double"
    assert sorted((r["inner_no"], r["File_Size"], r["File_Name"]) for r in base.collect()) == [(4, 7.0, "f"), (5, None, None)]
    t = flatten.variant_table(flat, wide, level)
    assert t.columns == ["parent_id", "outer_no", "inner_no", *level.supertype("attachment"), "a", "b", "c", "members"]
    r = t.first()
    assert (r["parent_id"], r["inner_no"], r["a"], r["b"], r["c"]) == (1, 0, 1.0, [True], {"d": "t"})
    assert "a" not in [c.lower() for c in flatten.variant_table(flat, 'attachment{"A":"num","a":"num"}', level).columns]
    assert flatten.variant_table(flat, 'attachment{"z":"[num|str]"}', level).first()["z"] == ["1", "x"]


def test_leaves(spark):
    body = json.dumps({"sheets": [{"items": [{"values": {"a": 1, "b": "x", "c": None, "d": True}}, {"values": None}, {}]}]})
    got = flatten.leaves(spark.createDataFrame([(1, body), (1, body), (2, None)], "id bigint, body string"), "id", "body", flatten.STATEMENT, "values").collect()
    assert sorted((r["name"], r["type"], r["text"], r["number"], r["flag"]) for r in got) == [("a", "num", "1", 1.0, None), ("b", "str", "x", None, None), ("c", "null", None, None, None), ("d", "bool", "true", None, True)]


def test_found_against_brute_force(spark, sf):
    want = set()
    for r in general.table(spark, sf, "report_responses").collect():
        want |= {("response", r["response_id"], i, j) for k, i, j, _ in flatten.nodes(r["body"], flatten.RESPONSE) if k == "attachment"}
    for r in general.table(spark, sf, "statement_files").collect():
        for i, sheet in enumerate(json.loads(r["body"])["sheets"]):
            want |= {("statement", r["file_id"], i, j) for j, x in enumerate((sheet or {}).get("items") or []) if x is not None}
    got = [tuple(r) for r in general.p5_found(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want

from __future__ import annotations

import random

from ledgerloom.operators import kv, layout

ELEMENTS = "page int, seq int, text string, font_name string, font_size double, x1 double, y1 double, x2 double, y2 double"


def page(spark, *rows, n=1):
    return spark.createDataFrame([(n, i, t, f, s, float(x1), float(y), float(x2), float(y) + s) for i, (t, x1, x2, y, f, s) in enumerate(rows)], ELEMENTS)


def lines(spark, *rows):
    return [(r["text"], r["region"]) for r in layout.analyze_pages(page(spark, *rows)).orderBy("line_idx").collect()]


def test_line_texts(spark):
    A = ("Arial", 12.0)
    assert lines(spark) == []
    assert lines(spark, ("World", 100, 140, 700, *A), ("Hello", 10, 50, 700, *A)) == [("Hello\tWorld", 0)]
    assert lines(spark, ("Bottom", 10, 50, 600, *A), ("Top", 10, 50, 700, *A)) == [("Top", 0), ("Bottom", 0)]
    assert lines(spark, ("Hello", 10, 50, 700, *A), ("World", 60, 100, 701, *A)) == [("Hello World", 0)]
    assert lines(spark, ("Hel", 10, 34, 700, *A), ("lo", 34, 50, 700, *A)) == [("Hello", 0)]
    assert lines(spark, ("Title", 10, 50, 720, "Bold", 18.0), ("Body text", 10, 80, 700, *A)) == [("Title", 0), ("Body text", 1)]


def test_the_anchor_is_the_first_element(spark):
    rows = [(str(y), 10 * i, 10 * i + 5, y, "F", 12.0) for i, y in enumerate([700, 696, 692, 690, 600])]
    got = {r["text"]: r["line_idx"] for r in layout.cluster_lines(page(spark, *rows)).collect()}
    assert got == {"700": 0, "696": 0, "692": 1, "690": 1, "600": 2}


def test_size_ties_and_zero_size(spark):
    got = layout.dominant_size(page(spark, ("a", 0, 1, 1, "F", 8.0), ("b", 0, 1, 1, "F", 12.0))).first()["dominant"]
    assert got == 12.0
    zero = layout.cluster_lines(page(spark, ("a", 0, 1, 5, "F", 0.0), ("b", 2, 3, 5, "F", 0.0)))
    assert sorted(r["line_idx"] for r in zero.collect()) == [0, 1]


def greedy(rows):
    out, used = [], set()
    for i in range(len(rows) - 1):
        a, b = rows[i], rows[i + 1]
        if i not in used and i + 1 not in used and a[1] > b[1] and abs(a[2] - b[2]) <= 50:
            out.append((a[0], b[0]))
            used |= {i, i + 1}
    return out


def test_label_pairs_are_greedy(spark):
    rng = random.Random(1)
    rows = [(p, i, f"w{i}", rng.choice([8.0, 10.0, 12.0]), float(rng.choice([0, 50, 51, 100]))) for p in range(40) for i in range(12)]
    df = spark.createDataFrame(rows, "page int, line_idx int, text string, font_size double, x1 double")
    got = {(r["page"], r["key"], r["value"]) for r in kv.label_pairs(df).collect()}
    want = {(p, a, b) for p in range(40) for a, b in greedy([(t, s, x) for q, _, t, s, x in rows if q == p])}
    assert got == want


def test_extract_pairs(spark):
    rows = [(1, 0, "Company Name", 14.0, 50.0), (1, 1, "PT Example Tbk", 10.0, 100.0), (1, 2, "Label", 14.0, 0.0), (1, 3, "Time: 10:30", 10.0, 0.0), (1, 4, "value", 8.0, 0.0), (1, 5, None, 8.0, 0.0), (1, 6, "Total 1,000 2,000", 9.0, 0.0)]
    df = spark.createDataFrame(rows, "page int, line_idx int, text string, font_size double, x1 double")
    got = [(r["key"], r["value"], r["confidence"]) for r in kv.extract_pairs(df).orderBy("page", "pass", "line_idx").collect()]
    assert got == [("Time", "10:30", 0.9), ("Company Name", "PT Example Tbk", 0.7)]

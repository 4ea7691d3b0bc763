from __future__ import annotations

import math
import random
from datetime import datetime

import pytest

from ledgerloom.operators import units
from ledgerloom.plans import general

FACTS = "fact_id bigint, filing_id bigint, ticker string, year int, stmt_period string, source string, entry string, concept string, value double, raw_text string, unit string, period string, decimals string, loaded_at timestamp"
FACTORS = [("IDR", "IDR", 1.0, "money"), ("USD", "USD", 1.0, "money"), ("ha", "m2", 1e4, "area"), ("m2", "m2", 1.0, "area")]


def facts(spark, rows):
    full = [(i, f, t, 2020, "Q1", "pdf", "", c, 0.0, raw, u, p, d, datetime(2024, 1, 1)) for i, f, t, c, raw, u, p, d in rows]
    return spark.createDataFrame(full, FACTS), spark.createDataFrame(FACTORS, "unit_code string, common_unit string, factor double, quantity_kind string")


def quantities(spark, rows):
    return {r["fact_id"]: (r["quantity"], r["how"]) for r in units.normalise_units(*facts(spark, rows)).collect()}


def test_pins():
    assert units.pinned_scale(24625135, "IDR", None, "-6") == (6, 0)
    assert units.pinned_scale(17_672_000_000, "IDR", None, "-6") == (0, 6)
    assert units.pinned_scale(5.0, "IDR", 6, "-3") == (6, 0)
    assert units.pinned_scale(5.0, "ha", None, "-3") == (0, 0)
    assert units.pinned_scale(5.0, None, None, "-3") == (None, 0)


def test_reading_a_batch_equals_reading_one_by_one(sf):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from ledgerloom.functions.quantity import read_fact

    t = pq.read_table(f"{sf}/facts.parquet")
    texts = [("1,234.5", "IDR"), ("1.234,5", "Rp"), ("-5.", None), ("1.2.3", "USD"), ("5,5,", "persen"), ("+7", ""), ("", "IDR"), (None, "IDR"), ("(12)", None), ("1e3", "kg"), (" 9 ", "juta rupiah"), ("12", None), ("–3", "USD")]
    raw, unit = t["raw_text"].to_pylist() + [x for x, _ in texts], t["unit"].to_pylist() + [x for _, x in texts]
    dec, n = t["decimals"].to_pylist() + ["-3"] * len(texts), len(raw)
    b = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([None] * n, pa.timestamp("us")), pa.array([1] * n, pa.int64()), *[pa.array([None] * n, pa.string())] * 3, pa.array(raw, pa.string()), pa.array(unit, pa.string()), pa.array(dec, pa.string())], list("abcdefghi"))
    got = units._read_batch(b).to_pylist()
    for r, u, d, g in zip(raw, unit, dec, got, strict=True):
        figure, base, scale = read_fact(r, u)
        pin, soft = units.pinned_scale(figure, base, scale, d)
        assert (g["figure"], None if g["base"] is None else units.UNIT_CODES[g["base"]], g["scale"], g["soft"]) == (figure, base, pin if figure is not None and base is not None else scale, soft), (r, u, d)


def test_viterbi_is_the_best_path():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 5)
        levels = [rng.choice([None, rng.uniform(0, 12)]) for _ in range(n)]
        cands = [[(e, ("IDR", e), rng.uniform(-2, 0)) for e in rng.sample([0, 3, 6, 9], rng.randint(1, 3))] for _ in range(n)]
        if any(x is None for x in levels):
            continue  # a step without a level passes its neighbour's on, which depends on the path

        def score(path):
            s = 0.0
            for t, k in enumerate(path):
                s += cands[t][k][2]
                if t:
                    a, b = cands[t - 1][path[t - 1]], cands[t][k]
                    s += 0.0 if a[1] == b[1] else units.SWITCH
                    s -= min((levels[t] + b[0] - levels[t - 1] - a[0]) ** 2 / 2, -units.BREAK)
            return s

        paths = [[]]
        for c in cands:
            paths = [p + [k] for p in paths for k in range(len(c))]
        assert score(units.viterbi(levels, cands)) == pytest.approx(max(map(score, paths)))


def test_open_facts_follow_their_device(spark):
    rows = [(i, i, "AAAA", "fin:X", raw, u, f"FY{2000 + i}", None) for i, (raw, u) in enumerate([("1,000 (IDR mn)", None), ("1100", ""), ("1,150", None), ("1,300,000", None), ("1250", "IDR mn"), ("1,400,000,000", "IDR")])]
    got = quantities(spark, rows)
    assert got[1] == (1.1e9, "decoded") and got[2] == (1.15e9, "decoded")
    assert got[0] == (1e9, "stated") and got[5] == (1.4e9, "stated")
    # a jump of three powers of ten reads as another unit of the device, not as growth
    assert got[3][1] == "decoded"


def test_facts_that_nothing_tells(spark):
    got = quantities(spark, [(1, 1, "A", "c", "12", None, "FY2020", None), (2, 1, None, None, None, None, None, None), (3, 1, "", "c", "no number", "IDR", "", "-x")])
    assert got == {1: (None, "open"), 2: (None, "open"), 3: (None, "open")}
    assert quantities(spark, []) == {}


def test_repeated_rows_and_hot_parts(spark, monkeypatch):
    rows = [(1, 1, "A", "c", "1,5", "hektar", "FY2020", None)] * 3 + [(2, 1, "A", "c", "15,000", "m2", "FY2020", None)]
    q = units.normalise_units(*facts(spark, rows))
    assert q.count() == 2
    assert [tuple(r) for r in units.restated(q).collect()] == [(1, 2)]
    assert [tuple(r) for r in units.restated_facts(*facts(spark, rows)).collect()] == [(1, 2)]
    monkeypatch.setattr(units, "CHUNK_ROWS", 2)
    many = [(i, i % 3, "A", "c", "100", "IDR mn" if i % 2 else None, "FY2020", None) for i in range(20)]
    assert all(v[1] in ("stated", "decoded") for v in quantities(spark, many).values())


def test_the_size_of_parts_and_batches_changes_nothing(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        raw, u, d = rng.choice([(f"{rng.randint(1, 99)}00", None, None), (f"{rng.randint(1, 9)},000,000", None, None), (f"{rng.randint(1, 99)}00", "IDR mn", None), (f"{rng.randint(1, 99)},000,000,000", "IDR", "-6"), ("0", None, None), ("none", "IDR", None), ("7,000", "USD", "-3")])
        period = rng.choice([None, "", *(f"FY{y}" for y in range(2018, 2023))])
        rows.append((i, i % 7, "A" if i % 5 else "B", "c", raw, u, period, d))
    whole = quantities(spark, rows)
    assert sum(how == "decoded" for _, how in whole.values()) > 100
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert quantities(spark, rows) == whole
        for n in (1, 3, 20):
            monkeypatch.setattr(units, "CHUNK_ROWS", n)
            assert quantities(spark, rows) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_found_against_brute_force(spark, sf):
    q = [r for r in general.p3_quantities(spark, sf).collect() if r["quantity"]]
    groups: dict = {}
    for r in q:
        groups.setdefault((r["filing_id"], r["concept"], r["period"], r["common_unit"]), []).append(r)

    def near(a, b):
        return abs(a - b) <= 0.001 * max(abs(a), abs(b))

    want = set()
    for rows in groups.values():
        for i, a in enumerate(rows):
            for b in rows[i + 1 :]:
                if near(a["quantity"], b["quantity"]) and not near(a["figure"], b["figure"]):
                    want.add((min(a["fact_id"], b["fact_id"]), max(a["fact_id"], b["fact_id"])))
    got = [tuple(r) for r in general.p3_found(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert not any(math.isnan(r["quantity"]) for r in q)


def test_copies_and_bucket_edges(spark):
    import itertools

    schema = "fact_id bigint, filing_id bigint, concept string, period string, common_unit string, quantity double, figure double"
    values = [10 ** (k * 0.01) * (1 + e) for k in (1, 2, 3) for e in (-9e-4, -4e-4, 0.0, 4e-4, 9e-4)]
    rows = [(i, 1, "c", "p", "u", sign * v, sign * f * v) for i, (v, f, sign) in enumerate(itertools.product(values, (1.0, 1e-3), (1.0, -1.0)))]
    rows += [(1000 + i, 1, "c", "p", "u", 5e6, 5.0) for i in range(6)] + [(2000 + i, 1, "c", "p", "u", 5e6, 5000.0) for i in range(3)] + [(3000, 1, "c", None, "u", 5e6, 1.0), (3001, 1, "c", "p", "u", 0.0, 0.0)]

    def near(a, b):
        return abs(a - b) <= 0.001 * max(abs(a), abs(b))

    want = {(min(a[0], b[0]), max(a[0], b[0])) for a, b in itertools.combinations([r for r in rows if r[3] and r[5]], 2) if near(a[5], b[5]) and not near(a[6], b[6])}
    for size in ("10000", "2"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = [tuple(r) for r in units.restated(spark.createDataFrame(rows, schema)).collect()]
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 18

from __future__ import annotations

import json

import pytest

from ledgerloom.plans import extract
from ledgerloom.sources import sink
from tests.test_sources import INLINE, INSTANCE, STATEMENT, block, make_pdf, workbook, zipped


@pytest.fixture
def home(tmp_path):
    at = tmp_path / "data" / "BBCA" / "2024" / "Q3"
    at.mkdir(parents=True)
    (at / "FinancialStatement-2024-Q3-BBCA.xlsx").write_bytes(workbook(STATEMENT))
    (at / "inline.zip").write_bytes(zipped({"a.html": INLINE, "b.xbrl": INSTANCE}))
    (at / "deck.pdf").write_bytes(make_pdf([block("(Company Name: PT Example Tbk) Tj"), b""]))
    (at / "notes.txt").write_text("x")
    other = tmp_path / "data" / "TLKM" / "2024" / "Q3"
    other.mkdir(parents=True)
    (other / "bad.zip").write_bytes(b"junk")
    return str(tmp_path)


def results(df):
    return {r["path"].rsplit("/", 1)[1]: (r["result"] and json.loads(r["result"]), r["error"]) for r in df.collect()}


def test_extract_a_ticker(spark, home):
    got = results(extract.extract(spark, "bbca", home, mode="presentation"))
    book = got["FinancialStatement-2024-Q3-BBCA.xlsx"][0]
    assert (book["ticker"], book["year"], book["period"]) == ("BBCA", 2024, "Q3")
    assert [s["name"] for s in book["sheets"]] == ["Balance Sheet"]
    assert book["sheets"][0]["items"][0] == {"label": "Total Assets", "values": {"2023": 900000.0, "2024": 1000000.0}}
    facts = got["inline.zip"][0]
    assert (facts["ticker"], facts["year"]) == ("BBCA", 0) and len(facts["facts"]) == 5
    assert facts["facts"][0] == {"concept": "ifrs-full:Revenue", "value": 1500000.0, "unit": "IDR", "period": "FY2024", "decimals": "-6"}
    assert got["deck.pdf"][0] == [{"key": "Company Name", "value": "PT Example Tbk", "confidence": 0.9, "page_num": 1}]
    assert len(got) == 3


def test_modes_and_errors(spark, home):
    with pytest.raises(ValueError, match="presentation"):
        extract.extract(spark, "BBCA", home)
    got = results(extract.extract(spark, "BBCA", home, fail_fast=False))
    assert got["deck.pdf"][0] is None and got["inline.zip"][1] is None
    with pytest.raises(Exception):
        extract.extract(spark, "NONE", home).collect()


def test_one_file(spark, home):
    got = extract.extract(spark, f"{home}/data/BBCA/2024/Q3/inline.zip").collect()
    assert json.loads(got[0]["result"])["ticker"] == "" and len(got) == 1
    assert sink.document([r["result"] for r in got]).endswith("}\n")


def test_analyze(spark, home):
    got = {r["ticker"]: r for r in extract.analyze(spark, "bbca,tlkm,none", home, 2024, "Q3").collect()}
    assert got["BBCA"]["format"] == "xbrl" and json.loads(got["BBCA"]["result"])["period"] == "Q3"
    assert got["TLKM"]["result"] is None and "archive" in got["TLKM"]["error"]
    assert got["NONE"]["error"]


def test_listing(spark):
    rows = [("A", f"f{i}", ".pdf" if i % 2 else ".PDF", i, "Q1", "2024", "p") for i in range(5)]
    df = spark.createDataFrame(rows, "Emiten_Code string, File_Name string, File_Type string, File_Size long, Report_Period string, Report_Year string, File_Path string")
    got = extract.listing(df, ".pdf", 3).collect()
    assert [r["FILENAME"] for r in got] == ["f0", "f1", "f2"]
    assert extract.listing(df, "pdf").count() == 0

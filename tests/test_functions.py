from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import exprs, text, typed
from ledgerloom.functions.quantity import Unit, read_fact, read_number, read_unit


def values(spark, rows, *cols, schema="x string"):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_read_unit_spellings():
    assert read_unit("IDR mn") == Unit("IDR", 6, False)
    assert read_unit("IDRbn") == Unit("IDR", 9, False)
    assert read_unit("IDR '000") == Unit("IDR", 3, False)
    assert read_unit("IDR_millions") == Unit("IDR", 6, False)
    assert read_unit("iso4217:USD") == Unit("USD", None, False)
    assert read_unit("Jutaan Rp") == Unit("IDR", 6, True)
    assert read_unit("rupiah penuh") == Unit("IDR", 0, True)
    assert read_unit("miliar dolar AS") == Unit("USD", 9, True)
    assert read_unit("Mt") == Unit("tonne", 6, False)
    assert read_unit("kt") == Unit("tonne", 3, False)
    assert read_unit("m²").base == read_unit("meter persegi").base == "m2"
    assert read_unit("-") == read_unit("") == Unit(None, None, False)


def test_read_fact_styles():
    assert read_fact("1.239,6", "hektar") == (1239.6, "ha", None)
    assert read_fact("(340,6)", "miliaran rupiah") == (-340.6, "IDR", 9)
    assert read_fact("IDR 27,055 billion", None) == (27055.0, "IDR", 9)
    assert read_fact("9,500 (IDR '000)", "") == (9500.0, "IDR", 3)
    assert read_fact("m2 1,200", "-") == (1200.0, "m2", None)
    assert read_fact(" 12 \n", "km2") == (12.0, "km2", None)
    assert read_fact("none", "IDR") == (None, "IDR", None)
    assert read_fact(None, "IDR") == (None, None, None)
    assert read_number("-4.138", True) == -4138.0


def test_typed_readings(spark):
    dates = ["2015-12-31", "31/12/2015", "20151231", "31 Desember 2015", "December 31, 2015", "31-Dec-15", "31/02/2023", "TBA", None, ""]
    got = values(spark, [(d,) for d in dates], typed.read_date(F.col("x")).cast("string"))
    assert got == [("2015-12-31",)] * 6 + [(None,)] * 4
    assert values(spark, [("1.234",), ("1 2",), ("12a",), ("-",), (None,)], typed.read_integer(F.col("x"))) == [(1234,), (12,), (None,), (None,), (None,)]
    assert values(spark, [("670,90",), ("6.709e+2",), ("1.2.3",), ("-0",)], typed.read_double(F.col("x"))) == [(670.9,), (670.9,), (None,), (0.0,)]
    assert values(spark, [("Ya",), ("N",), ("sebagian",)], typed.read_boolean(F.col("x"))) == [(True,), (False,), (None,)]
    assert values(spark, [("Watch board  ",), (" ",)], typed.read_string(F.col("x"))) == [("Watch board",), (None,)]


def test_white_space(spark):
    assert values(spark, [("\t  x y \n",), (None,)], text.trim_ws(F.col("x")), exprs.trim_space(F.col("x"))) == [("x y", "x y"), (None, None)]
    assert values(spark, [("  a  b ",)], exprs.space_fields(F.col("x"))) == [(["a", "b"],)]


def test_numbers(spark):
    rows = [("1,000",), (" 12.5 ",), ("1d",), ("1e999",), ("abc",), (".5",), ("NaN",), (None,)]
    got = values(spark, rows, exprs.parse_number_xlsx(F.col("x")), exprs.parse_number_xbrl(F.col("x")))
    assert got == [(None, 1000.0), (12.5, 12.5), (None, 0.0), (None, 0.0), (None, 0.0), (0.5, 0.5), (None, 0.0), (None, 0.0)]


def test_file_names(spark):
    names = ["FinancialStatement-2024-Q3-BBCA.xlsx", "FinancialStatement-2023-Audit-TLKM.xlsx", "random-file.xlsx", "a/financialstatement-2024-Q1-abcd.XLSX"]
    got = values(spark, [(n,) for n in names], exprs.filename_meta(F.col("x")))
    assert [tuple(g[0]) for g in got] == [("BBCA", 2024, "Q3"), ("TLKM", 2023, "Audit"), ("", 0, ""), ("abcd", 2024, "Q1")]
    assert values(spark, [("a.XLSX",), ("b.zip",), ("c.Pdf",), ("d.txt",), ("e",)], exprs.detect_format(F.col("x"))) == [("xlsx",), ("xbrl",), ("pdf",), ("",), ("",)]


def test_line_predicates(spark):
    rows = [("Company Name: PT Example Tbk",), ("Time: 10:30",), ("Section Title:",), ("Revenue    1,000,000    2,000,000    3,000,000",)]
    got = values(spark, rows, exprs.colon_pair(F.col("x")), exprs.is_tabular(F.col("x")))
    assert [(tuple(a) if a else None, b) for a, b in got] == [(("Company Name", "PT Example Tbk"), False), (("Time", "10:30"), False), (None, False), (None, True)]


def test_text_metrics(spark):
    rows = [(12.0, 1.0, 1.0), (12.0, 1.0, 2.0), (12.0, -1.0, -1.0), (10.0, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "s double, a double, d double")
    assert [r[0] for r in df.select(exprs.effective_font_size(F.col("s"), F.col("a"), F.col("d"))).collect()] == [12.0, 24.0, 12.0, 20.0]
    assert values(spark, [(-300.0,), (-301.0,)], exprs.kerning_is_space(F.col("x")), schema="x double") == [(False,), (True,)]


def test_fact_elements(spark):
    rows = [("http://www.xbrl.org/2013/inlineXBRL", "nonFraction"), ("http://www.xbrl.org/2013/inlineXBRL", "header"), ("http://xbrl.ifrs.org/taxonomy/2023", "Revenue"), ("ix", "nonFraction")]
    df = spark.createDataFrame(rows, "n string, l string")
    assert [r[0] for r in df.select(exprs.is_fact_element(F.col("n"), F.col("l"))).collect()] == [True, False, True, False]

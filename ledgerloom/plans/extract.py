"""Filings end to end: from a file, or a company's cached files, to JSON results.

``extract`` reads every matching file, ``analyze`` the best file of each company.
Results are rows (path, format, result); ``result`` is the document as JSON, and
``error`` tells why a file has none. ``fail_fast`` ends at the first error instead.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import filename_meta, or_fallback
from ledgerloom.operators import filings, kv, layout
from ledgerloom.sources import files

_MODE_ERROR = "this format needs the presentation mode"
_NO_FILE = "no file of a known format"


def cached_files(spark: SparkSession, home: str, arg: str, year: int = 0, period: str = "") -> DataFrame:
    """(path, format, ticker, year, period) of a file, or of the files of one or more
    tickers (a comma list) in the cache home/data/ticker/year/period; year 0 and period
    '' mean any. Only names are read; no file at all is an error."""
    path = "." in arg or "/" in arg
    pattern = arg if path else f"{home}/data/{{{arg.upper()}}}/{year or '*'}/{period or '*'}/*"
    inputs = filings.resolve_inputs(spark.read.format("binaryFile").load(pattern).select("path"))
    return inputs.select("path", "format", F.lit("").alias("ticker"), F.lit(0).alias("year"), F.lit("").alias("period")) if path else inputs


def _given(rows: DataFrame, given: DataFrame | None, xlsx: bool) -> DataFrame:
    """Rows by path with ``ticker``, ``year`` and ``period`` of the file's name, else as
    ``given`` for the path."""
    m = filename_meta(F.col("path"), xlsx)
    if given is None:
        return rows.select("*", m["ticker"].alias("ticker"), m["year"].alias("year"), m["period"].alias("period"))
    known = rows.join(given.select("path", *[F.col(c).alias(f"_{c}") for c in ("ticker", "year", "period")]), "path", "left")
    return known.select(*rows.columns, *[or_fallback(m[c], F.coalesce(f"_{c}", F.lit(unset)), unset).alias(c) for c, unset in (("ticker", ""), ("year", 0), ("period", ""))])


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _ordered(order: str, *fields: str) -> Column:
    """The rows of a group in order, without the order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *fields)), lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0))
    return F.transform(rows, lambda x: F.struct(*[x[f].alias(f) for f in fields]))


def statements(cells: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(path, result) of spreadsheet cells: the sheets that have items, with them.
    ``given`` (path, ticker, year, period) fills what file names don't tell."""
    names = cells.where("error is null").groupBy("path", "sheet_idx").agg(F.first("sheet_name").alias("name"))
    items = filings.items_from_cells(cells.where("error is null"), ("path", "sheet_idx"))
    sheets = items.groupBy("path", "sheet_idx").agg(_ordered("row_idx", "label", "values").alias("items")).join(names, ["path", "sheet_idx"])
    books = cells.where("error is null").select("path").distinct().join(sheets.groupBy("path").agg(_ordered("sheet_idx", "name", "items").alias("sheets")), "path", "left")
    return _given(books, given, True).select("path", _json(*map(F.col, ("ticker", "year", "period", "sheets"))).alias("result"))


def fact_statements(facts: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(path, result) of tagged facts, in the archive's order."""
    fields = ("concept", "value", "unit", "period", "decimals")
    grouped = facts.where("concept is not null").groupBy("path").agg(_ordered("seq", *fields).alias("facts"))
    return _given(grouped, given, False).select("path", _json(*map(F.col, ("ticker", "year", "period", "facts"))).alias("result"))


def presentations(elements: DataFrame) -> DataFrame:
    """(path, result) of page elements: the pairs of all pages, colon pairs first on each."""
    rows = elements.where("error is null").drop("error")
    pairs = kv.extract_pairs(layout.analyze_pages(rows, ("path", "page")), ("path", "page"))
    order = F.struct("page", "pass", "line_idx").alias("at")
    listed = pairs.select("path", order, "key", "value", "confidence", F.col("page").alias("page_num")).groupBy("path").agg(_ordered("at", "key", "value", "confidence", "page_num").alias("pairs"))
    empty = F.array().cast("array<struct<key:string,value:string,confidence:double,page_num:int>>")
    return elements.where("error is null").select("path").distinct().join(listed, "path", "left").select("path", F.to_json(F.coalesce("pairs", empty)).alias("result"))


def _results(spark: SparkSession, inputs: DataFrame, mode: str, fail_fast: bool) -> DataFrame:
    """One plan for all inputs (path, format, and what is given for each). The paths come
    to the driver once: a listing that its file index holds anyway, so that no other
    file is opened."""
    chosen = [tuple(r) for r in inputs.select("path", "format", "ticker", "year", "period").collect()]
    given = spark.createDataFrame(chosen, "path string, format string, ticker string, year int, period string")
    content, policy, out = spark.read.format("binaryFile"), "failfast" if fail_fast else "permissive", None
    for fmt in ("xlsx", "xbrl", "pdf"):
        paths = [p for p, f, *_ in chosen if f == fmt]
        if not paths:
            continue
        if fmt == "pdf" and mode != "presentation":
            if fail_fast:
                raise ValueError(f"{paths[0]}: {_MODE_ERROR}")
            part = given.where(F.col("format") == fmt).select("path", F.lit(None).cast("string").alias("result"), F.lit(_MODE_ERROR).alias("error"))
        else:
            rows = files.decode(content.load(paths), fmt, policy)
            made = presentations(rows) if fmt == "pdf" else (statements if fmt == "xlsx" else fact_statements)(rows, given)
            # an archive's entries may fail alone; a file has an error if nothing came of it
            failed = rows.groupBy("path").agg(F.min("error").alias("error"))
            part = failed.join(made, "path", "left").select("path", "result", F.when(F.col("result").isNull(), F.col("error")).alias("error"))
        part = part.withColumn("format", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(_NO_FILE)
    return out.select("path", "format", "result", "error")


def extract(spark: SparkSession, arg: str, home: str = ".", year: int = 0, period: str = "", mode: str = "financial", fail_fast: bool = True) -> DataFrame:
    """Every matching file. Metadata that a file's name lacks comes from the arguments;
    the period FY means Audit."""
    period = "Audit" if period.upper() == "FY" else period
    inputs = cached_files(spark, home, arg, year, period)
    if "." not in arg and "/" not in arg:
        inputs = inputs.select("path", "format", F.lit(arg.upper()).alias("ticker"), F.lit(year).alias("year"), F.lit(period).alias("period"))
    return _results(spark, inputs, mode, fail_fast)


def analyze(spark: SparkSession, tickers: str, home: str = ".", year: int = 0, period: str = "") -> DataFrame:
    """The best file of each ticker of a comma list, in the list's order, with ``ticker``;
    a ticker without a file, or whose file fails, has its error and the others their
    results. One plan for all tickers."""
    period = "Audit" if period.upper() == "FY" else period
    wanted = spark.createDataFrame(list(enumerate(tickers.upper().split(","))), "pos int, ticker string")
    try:
        best = filings.best_format(cached_files(spark, home, tickers, year, period).select("ticker", "path", "format"), ("ticker",))
        given = best.select("path", "format", "ticker", F.lit(year).alias("year"), F.lit(period).alias("period"))
        got = _results(spark, given, "presentation", False).join(best.select("ticker", "path"), "path")
    except (AnalysisException, ValueError) as e:
        if isinstance(e, AnalysisException) and e.getCondition() != "PATH_NOT_FOUND" or isinstance(e, ValueError) and str(e) != _NO_FILE:
            raise
        got = spark.createDataFrame([], "path string, format string, result string, error string, ticker string")
    rows = wanted.join(got, "ticker", "left").withColumn("error", F.when(F.col("path").isNull(), F.lit(_NO_FILE)).otherwise(F.col("error")))
    return rows.orderBy("pos").select("path", "format", "result", "error", "ticker")


listing = filings.listing

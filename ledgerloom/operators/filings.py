"""Choosing, listing and reshaping filings: inputs, catalog, registry, statement items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import ATTEMPTS, PRIORITY, RETRYABLE, backoff_seconds, detect_format, parse_number_xlsx, trim_space


def resolve_inputs(paths: DataFrame, path: str = "path", root: str = "data") -> DataFrame:
    """Files of known format in a cache laid out root/ticker/year/period/file, with the
    parts of their paths as ``ticker``, ``year`` and ``period``; others are left out."""
    parts = rf"{root}/([^/]+)/([^/]+)/([^/]+)/[^/]+$"
    got = lambda g: F.regexp_extract(path, parts, g)
    return paths.withColumn("format", detect_format(F.col(path))).where(F.col("format") != "").select(path, "format", got(1).alias("ticker"), F.coalesce(got(2).try_cast("int"), F.lit(0)).alias("year"), got(3).alias("period"))


def priority(fmt: Column) -> Column:
    out = F.lit(0)
    for name, p in PRIORITY.items():
        out = F.when(fmt == name, p).otherwise(out)
    return out


def best_format(inputs: DataFrame, by: tuple[str, ...], path: str = "path") -> DataFrame:
    """The preferred file of each group, at a tie the first by path. It reads paths
    only, so files that lose are never opened."""
    rest = [c for c in inputs.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.struct((-priority(F.col("format"))).alias("p"), F.col(path).alias("f")))
    return inputs.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def filter_type(attachments: DataFrame, wanted: str, column: str = "file_type") -> DataFrame:
    """'' keeps all; else equality in any case, with no other normalisation."""
    return attachments if not wanted else attachments.where(F.lower(column) == wanted.lower())


def presentations(registry: DataFrame, year: int = 0, period: str = "") -> DataFrame:
    """One row per presentation of registry rows, filtered by year (0: any) and period
    in any case ('': any)."""
    rows = registry.select("ticker", F.posexplode("presentations").alias("pos", "p")).select("ticker", "pos", "p.*")
    if year:
        rows = rows.where(F.col("year") == year)
    return rows.where(F.lower("period") == period.lower()) if period else rows


def registry_lookup(tickers: DataFrame, registry: DataFrame, year: int = 0, period: str = "") -> DataFrame:
    """The presentations of each ticker in the order of tickers; unknown tickers and
    those without presentations give none."""
    return tickers.join(presentations(registry, year, period), "ticker")


def fetch_summary(downloads: DataFrame, by: tuple[str, ...], order: str = "pos") -> DataFrame:
    """``downloaded`` and ``failed`` names in order, by group."""
    names = lambda ok: F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct(order, "name")))), lambda x: x["name"])
    return downloads.groupBy(*by).agg(names(F.col("error").isNull()).alias("downloaded"), names(F.col("error").isNotNull()).alias("failed"))


def listing(attachments: DataFrame, wanted: str = "", most: int = 1000) -> DataFrame:
    """The catalog table of attachments of a type: the first ``most`` of each company by
    ``pos``, where the portal tells its order, else by year, period, name and path."""
    rows = filter_type(attachments, wanted, "File_Type")
    order = ("pos",) if "pos" in rows.columns else ("Report_Year", "Report_Period", "File_Name", "File_Path")
    cols = {"TICKER": "Emiten_Code", "FILENAME": "File_Name", "TYPE": "File_Type", "SIZE": "File_Size", "PERIOD": "Report_Period", "YEAR": "Report_Year"}
    return with_ordinal(rows, ("Emiten_Code",), order, "_at").where(F.col("_at") < most).orderBy("Emiten_Code", "_at").select(*[F.col(c).alias(n) for n, c in cols.items()])


def retry_outcomes(answers: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """What retrying makes of the answers (``attempt`` from 0, ``status``) of each
    request: ``status`` of the last attempt made, ``attempts`` made and ``waited``
    seconds. Only answers that may pass are tried again, at most ``ATTEMPTS`` times, with
    a doubling delay before each further try."""
    again = F.col("status").isin(*RETRYABLE)
    made = answers.where((F.col("attempt") >= 0) & (F.col("attempt") < ATTEMPTS)).groupBy(*by).agg(F.min(F.when(~again, F.col("attempt"))).alias("_end"), F.max("attempt").alias("_last"), F.collect_list(F.struct("attempt", "status")).alias("_all"))
    stop = F.coalesce("_end", "_last")
    status = F.filter("_all", lambda x: x["attempt"] == stop)[0]["status"]
    waited = F.aggregate(F.sequence(F.lit(0), stop), F.lit(0.0), lambda acc, k: acc + F.when(k < stop, backoff_seconds(k)).otherwise(0.0))
    return made.select(*by, status.alias("status"), (stop + 1).alias("attempts"), waited.alias("waited"))


def attachments_of(tickers: DataFrame, attachments: DataFrame, code: str = "emiten_code") -> DataFrame:
    """The attachments of each ticker (``pos``, ``ticker``), by ticker in any case and
    without outer blanks; tickers without any give none."""
    return tickers.join(attachments.withColumn("ticker", F.upper(F.trim(code))), "ticker")


def items_from_cells(cells: DataFrame, sheet: tuple[str, ...] = ("file", "sheet_idx")) -> DataFrame:
    """Spreadsheet cells (sheet keys, ``row_idx``, ``col_idx``, ``text``) to items: one row
    per labelled row with ``label`` and ``values`` (map of header to number).

    Row 0 is the header. Cells beside no header, empty or no number are skipped; of
    equal headers the last column counts. A labelled row without numbers keeps an
    empty map. The header meets its cells in one shuffle by sheet and column."""
    text = trim_space(F.col("text"))
    head = cells.where((F.col("row_idx") == 0) & (F.col("col_idx") > 0)).select(*sheet, "col_idx", text.alias("_h")).where(F.col("_h") != "")
    body = cells.where(F.col("row_idx") > 0)
    labels = body.where((F.col("col_idx") == 0) & (text != "")).select(*sheet, "row_idx", text.alias("label"))
    numbers = body.where(F.col("col_idx") > 0).select(*sheet, "row_idx", "col_idx", parse_number_xlsx(F.col("text")).alias("_v")).where(F.col("_v").isNotNull())
    values = numbers.join(head, [*sheet, "col_idx"]).groupBy(*sheet, "row_idx", "_h").agg(F.max_by("_v", "col_idx").alias("_v"))
    maps = values.groupBy(*sheet, "row_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_h", "_v")))).alias("values"))
    empty = F.create_map().cast("map<string,double>")
    return labels.join(maps, [*sheet, "row_idx"], "left").select(*sheet, "row_idx", "label", F.coalesce("values", empty).alias("values"))


def with_ordinal(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], name: str = "pos") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)

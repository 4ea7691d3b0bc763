"""Scalar expressions of filing extraction; every function maps columns to a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OUTER = r"(?U)^\s+|\s+$"
#: A decimal literal with optional exponent; hex, underscores, suffixes and names of infinity stay out.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
FORMATS = {".xlsx": "xlsx", ".zip": "xbrl", ".pdf": "pdf"}
#: Preference among formats of one report.
PRIORITY = {"xbrl": 3, "xlsx": 2, "pdf": 1}
XBRL_EXTENSIONS = (".xbrl", ".xml", ".htm", ".html")
#: Fixed values of key-value extraction.
COLON_CONFIDENCE, LABEL_CONFIDENCE = 0.9, 0.7
TABULAR_FIELDS, TABULAR_NUMBERS, LABEL_SHIFT = 3, 2, 50.0
KERNING_SPACE, CHAR_WIDTH = 300.0, 0.5


def trim_space(c: Column) -> Column:
    """Without outer Unicode white space."""
    return F.regexp_replace(c, _OUTER, "")


def space_fields(c: Column) -> Column:
    """Parts between runs of Unicode white space, without empty ones."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def detect_format(path: Column) -> Column:
    """xlsx, xbrl (a ZIP) or pdf by extension in any case; '' for all others and null paths."""
    ext = extension(path)
    out = F.when(ext == ".xlsx", "xlsx").when(ext == ".zip", "xbrl").when(ext == ".pdf", "pdf")
    return out.otherwise("")


def is_path(arg: Column) -> Column:
    """Whether an argument names a file rather than a ticker."""
    return arg.rlike("[./]")


def filename_meta(name: Column, xlsx: bool = True) -> Column:
    """struct<ticker, year, period> from a statement's file name; '' and 0 where the
    name doesn't follow the pattern. Spreadsheets need the whole tail, archives don't."""
    base = F.substring_index(name, "/", -1)
    pattern = r"(?i)FinancialStatement-(\d{4})-([^-]+)-([A-Z]{4})" + (r"\.xlsx$" if xlsx else "")
    part = lambda g: F.coalesce(F.regexp_extract(base, pattern, g), F.lit(""))
    return F.struct(part(3).alias("ticker"), F.coalesce(part(1).try_cast("int"), F.lit(0)).alias("year"), part(2).alias("period"))


def or_fallback(value: Column, fallback: Column, unset: object) -> Column:
    """The value, or the fallback where the value is null or ``unset`` ('' or 0)."""
    return F.coalesce(F.nullif(value, F.lit(unset)), fallback)


def normalize_period(p: Column) -> Column:
    """FY in any case means Audit; everything else stays."""
    return F.when(F.upper(p) == "FY", F.lit("Audit")).otherwise(p)


def tickers(arg: Column) -> Column:
    """Upper-case parts of a comma list, neither trimmed nor deduplicated."""
    return F.split(F.upper(arg), ",")


def _parse(c: Column) -> Column:
    v = F.when(c.rlike(NUMBER), c.try_cast("double"))
    return F.when(F.abs(v) < F.lit(float("inf")), v)  # a finite text out of range is a failure


def parse_number_xlsx(c: Column) -> Column:
    """Null where the trimmed cell is no number; separators are not removed."""
    return _parse(trim_space(c))


def parse_number_xbrl(c: Column) -> Column:
    """Commas dropped; 0 where the rest is no number."""
    return F.coalesce(_parse(F.replace(trim_space(c), F.lit(","), F.lit(""))), F.lit(0.0))


def parse_number_pdf(c: Column) -> Column:
    """0 where the token is no number."""
    return F.coalesce(_parse(c), F.lit(0.0))


def looks_numeric(c: Column) -> Column:
    return F.translate(c, ",.()-", "").rlike("^[0-9]+$")


def is_tabular(text: Column) -> Column:
    """At least three fields, two of them numeric."""
    parts = space_fields(text)
    return (F.size(parts) >= TABULAR_FIELDS) & (F.size(F.filter(parts, looks_numeric)) >= TABULAR_NUMBERS)


def colon_pair(text: Column) -> Column:
    """struct<key, value> of a line cut at its first colon; null unless both sides have text."""
    at = F.instr(text, ":")
    key, value = trim_space(F.substring(text, F.lit(1), at - 1)), trim_space(F.substring(text, at + 1, F.length(text)))
    return F.when((at > 0) & (key != "") & (value != ""), F.struct(key.alias("key"), value.alias("value")))


def effective_font_size(size: Column, a: Column, d: Column) -> Column:
    return F.abs(F.when((d != 0) & (d != a), size * d).otherwise(size * a))


def text_width(text: Column, size: Column) -> Column:
    return F.char_length(text) * size * CHAR_WIDTH


def kerning_is_space(k: Column) -> Column:
    return F.abs(k) > KERNING_SPACE


def is_fact_element(namespace: Column, local: Column) -> Column:
    """An inline fact, or any element of an IFRS namespace."""
    inline = (namespace.endswith("/inlineXBRL") | namespace.contains("inline")) & local.isin("nonFraction", "nonNumeric")
    return inline | namespace.contains("ifrs")


def request_query(params: dict[str, Column]) -> Column:
    """A percent-encoded query string, keys in order."""
    return F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in sorted(params.items())])


def cache_path(ticker: Column, year: Column, period: Column, file: Column) -> Column:
    return F.concat_ws("/", F.lit("data"), ticker, year.cast("string"), period, F.substring_index(file, "/", -1))


def backoff_seconds(attempt: Column) -> Column:
    """Delay before the next try after attempt 0, 1, ..."""
    return F.pow(F.lit(2.0), attempt)


# Answers that are tried again, and how often at most.
RETRYABLE = (429, 500, 502, 503, 504)
ATTEMPTS = 3

"""Reading free text as a declared type, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import squeeze_ws

# Month names and short forms, English and Indonesian.
MONTHS = {
    "jan": 1, "january": 1, "januari": 1, "feb": 2, "february": 2, "februari": 2, "mar": 3, "march": 3, "maret": 3, "apr": 4, "april": 4,
    "may": 5, "mei": 5, "jun": 6, "june": 6, "juni": 6, "jul": 7, "july": 7, "juli": 7, "aug": 8, "august": 8, "agu": 8, "agt": 8, "agustus": 8,
    "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "okt": 10, "oktober": 10, "nov": 11, "november": 11, "nop": 11, "nopember": 11,
    "dec": 12, "december": 12, "des": 12, "desember": 12,
}
YES = ("true", "t", "yes", "y", "ya", "1", "benar")
NO = ("false", "f", "no", "n", "tidak", "0", "salah")


_NAME = r"([a-z]{3,9})\.?"
#: Forms of a date with digits only, and what makes each yyyy-m-d.
_DIGITS = ((r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", "$1-$2-$3"), (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$", "$3-$2-$1"), (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))
#: Forms with a month's name, and what makes each "year day".
_NAMED = ((rf"^(\d{{1,2}})[- ]{_NAME}[- ,]+(\d{{4}}|\d{{2}})$", "$3 $1"), (rf"^{_NAME} (\d{{1,2}}),? (\d{{4}})$", "$3 $2"))


def _date(t: Column) -> Column:
    t = F.lower(t)
    month = F.try_element_at(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv]), F.regexp_extract(t, "([a-z]+)", 1))
    out = None
    for pattern, to in _DIGITS:
        value = F.regexp_replace(t, pattern, to).try_cast("date")
        out = F.when(t.rlike(pattern), value) if out is None else out.when(t.rlike(pattern), value)
    for pattern, to in _NAMED:
        parts = F.split(F.regexp_replace(t, pattern, to), " ")
        year = F.when(F.length(parts[0]) == 4, parts[0]).otherwise(F.concat(F.when(parts[0] >= "70", F.lit("19")).otherwise(F.lit("20")), parts[0]))
        out = out.when(t.rlike(pattern), F.concat_ws("-", year, F.coalesce(month.cast("string"), F.lit("?")), parts[1]).try_cast("date"))
    return out


def _boolean(t: Column) -> Column:
    t = F.lower(t)
    return F.when(t.isin(*YES), F.lit(True)).when(t.isin(*NO), F.lit(False))


def _integer(t: Column) -> Column:
    return F.when(t.rlike(r"^[+-]?\d[\d., ]*$"), F.translate(t, "., ", "").try_cast("bigint"))


def _double(t: Column) -> Column:
    return F.when(t.rlike(r"^[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?$"), F.translate(t, ",", ".").try_cast("double") + F.lit(0.0))


def _string(t: Column) -> Column:
    return F.nullif(t, F.lit(""))


#: By type, the reading of a text whose white space is reduced (``squeeze_ws``) already:
#: a reading may use its text several times.
SQUEEZED = {"string": _string, "date": _date, "boolean": _boolean, "integer": _integer, "double": _double}


def read_date(c: Column) -> Column:
    """ISO, day/month/year, yyyymmdd, and day and month name in either order, in
    English or Indonesian; two-digit years from 70 on are 19xx. Null when unreadable
    or no day of the calendar."""
    return _date(squeeze_ws(c))


def read_boolean(c: Column) -> Column:
    return _boolean(squeeze_ws(c))


def read_integer(c: Column) -> Column:
    """``.``, ``,`` and blanks only group digits."""
    return _integer(squeeze_ws(c))


def read_double(c: Column) -> Column:
    """``,`` and ``.`` both are the decimal sign; a text with two of them has no reading."""
    return _double(squeeze_ws(c))


def read_string(c: Column) -> Column:
    """Trimmed, white space of any kind reduced to single blanks; empty is null."""
    return _string(squeeze_ws(c))


READERS = {"string": read_string, "date": read_date, "boolean": read_boolean, "integer": read_integer, "double": read_double}
SPARK_TYPES = {"string": "string", "date": "date", "boolean": "boolean", "integer": "bigint", "double": "double"}

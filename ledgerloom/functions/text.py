"""Column expressions on text; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind at either end, byte order mark and zero width space too.
_ENDS = r"(?U)^[\s\x{FEFF}\x{200B}]+|[\s\x{FEFF}\x{200B}]+$"


def trim_ws(c: Column) -> Column:
    """Without outer white space of any kind; null stays null."""
    return F.regexp_replace(c, _ENDS, "")


def blank_to_null(c: Column) -> Column:
    """Trimmed; null when nothing is left."""
    return F.nullif(trim_ws(c), F.lit(""))


def squeeze_ws(c: Column) -> Column:
    """Trimmed, with inner white space of any kind reduced to single blanks."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x{FEFF}\x{200B}]+", " "))


def fields(c: Column) -> Column:
    """Parts between runs of white space, without empty ones."""
    return F.filter(F.split(squeeze_ws(c), " "), lambda x: x != "")

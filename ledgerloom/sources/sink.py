"""Results as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def result_json(*fields: Column) -> Column:
    """A row as JSON that keeps null fields."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def document(results: list[str], pretty: bool = False) -> str:
    """Nothing for no result, the bare object for one, an array for more; a line end behind."""
    import json

    if not results:
        return ""
    if pretty:
        values = [json.loads(r) for r in results]
        return json.dumps(values[0] if len(values) == 1 else values, indent=2, ensure_ascii=False) + "\n"
    return (results[0] if len(results) == 1 else "[" + ",".join(results) + "]") + "\n"


def write_results(df: DataFrame, path: str) -> None:
    """Any number of results as lines of JSON, through Spark's committer."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)

"""Portal answers and the company registry, from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTACHMENT = "struct<File_Name:string,File_Path:string,File_Type:string,File_Size:bigint,Emiten_Code:string,Report_Period:string,Report_Year:string>"
RESPONSE = f"struct<Results:array<struct<Attachments:array<{ATTACHMENT}>>>>"
REGISTRY = "map<string,struct<name:string,ir_page:string,presentations:array<struct<url:string,title:string,period:string,year:int>>>>"


def attachments(bodies: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per attachment of well-formed answers, in order, with ``result_no`` and ``attachment_no``."""
    parsed = bodies.select(*keep, F.from_json(body, RESPONSE).alias("r"))
    results = parsed.select(*keep, F.posexplode("r.Results").alias("result_no", "x"))
    rows = results.select(*keep, "result_no", F.posexplode("x.Attachments").alias("attachment_no", "a"))
    return rows.select(*keep, "result_no", "attachment_no", "a.*")


def registry(texts: DataFrame, value: str = "value") -> DataFrame:
    """(ticker, name, ir_page, presentations) of registry documents."""
    return texts.select(F.explode(F.from_json(value, REGISTRY)).alias("ticker", "c")).select("ticker", "c.*")


def read_json_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows (path, value)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")

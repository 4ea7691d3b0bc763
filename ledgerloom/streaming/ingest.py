"""Filings decoded as they arrive in the cache folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.files import decode

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, folder: str, kind: str, glob: str, per_trigger: int = 1000) -> DataFrame:
    """A streaming table of the decoder ``kind``'s rows for files matching ``glob``."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    return decode(files, kind)


def write_stream(df: DataFrame, table_path: str, checkpoint: str):
    """Append to a parquet table, once for all files there are; restarts go on where it ended."""
    return df.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

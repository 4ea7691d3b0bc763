"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings the engine wants everywhere. None of them fixes a size: partition
#: counts are left to adaptive execution and to the cluster's own defaults.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``BASE_CONF`` and the given settings on top."""
    builder = SparkSession.builder.appName(app).config(map={**BASE_CONF, **conf})
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()

"""The row before each row of a series, without one task per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, series: list[str], order: list[str], bucket: Column, payload: Column, name: str = "previous") -> DataFrame:
    """Add ``name``: the ``payload`` of the row before in ``series`` by ``order``.

    A plain window would sort a whole series in one task, which a series holding a
    third of all rows turns into the slowest of the job. Here ``bucket`` (a value
    that never decreases along ``order``, such as the month) splits each series:
    the window runs inside (series, bucket), and only the first row of each bucket
    looks further back, into a summary with the last row of every bucket, which is
    pre-aggregated map-side. The result is the same as the plain window's. Nulls
    in ``order`` come first; the first row of a series gets null.
    """
    b = df.withColumn("_bucket", bucket).withColumn("_order", F.struct(*order)).withColumn("_payload", payload)
    inside = Window.partitionBy(*series, "_bucket").orderBy(*order)
    b = b.withColumn("_in", F.lag(F.struct("_payload")).over(inside))
    last = b.groupBy(*series, "_bucket").agg(F.max_by(F.struct("_payload"), "_order").alias("_last"))
    along = Window.partitionBy(*series).orderBy("_bucket")
    before = last.withColumn("_last", F.lag("_last").over(along)).where(F.col("_last").isNotNull())
    before = before.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(series)], F.col("_bucket").alias("_sb"), F.col("_last").alias("_back"))
    on = F.col("_bucket").eqNullSafe(F.col("_sb")) & F.col("_in").isNull()
    for i, c in enumerate(series):
        on = on & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    return b.join(before, on, "left").select(*df.columns, F.coalesce("_in", "_back")["_payload"].alias(name))

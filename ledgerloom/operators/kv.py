"""Key-value pairs from lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import COLON_CONFIDENCE, LABEL_CONFIDENCE, LABEL_SHIFT, colon_pair, is_tabular, trim_space


def colon_pairs(lines: DataFrame, page: tuple[str, ...] = ("page",), order: str = "line_idx") -> DataFrame:
    """(page, line_idx, key, value) of lines with a colon that are not tabular."""
    return lines.where(F.instr("text", ":") > 0).where(~is_tabular(F.col("text"))).withColumn("_p", colon_pair(F.col("text"))).where(F.col("_p").isNotNull()).select(*page, order, "_p.key", "_p.value")


def label_pairs(lines: DataFrame, page: tuple[str, ...] = ("page",), order: str = "line_idx", taken: str | None = None) -> DataFrame:
    """(page, line_idx, key, value): a line above a line in a smaller font at nearly the
    same left edge is its label.

    Pairs are taken greedily from the top, each line once. Neighbouring candidate
    pairs form runs, and greedy choice keeps the odd ones of each run, so one window
    sort per page does it. ``taken`` names a flag of lines already used."""
    w = Window.partitionBy(*page).orderBy(order)
    nxt = lambda c: F.lead(c).over(w)
    usable = ~is_tabular(F.col("text")) & (trim_space(F.col("text")) != "")
    if taken:
        usable = usable & ~F.col(taken)
    rows = lines.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    edge = F.col("_ok") & nxt("_ok") & (F.col("font_size") > nxt("font_size")) & (F.abs(F.col("x1") - nxt("x1")) <= LABEL_SHIFT)
    rows = rows.withColumn("_edge", F.coalesce(edge, F.lit(False))).withColumn("_value", nxt("text"))
    rows = rows.withColumn("_start", F.when(F.col("_edge") & ~F.coalesce(F.lag("_edge").over(w), F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = Window.partitionBy(*page, "_run", "_edge").orderBy(order)
    kept = rows.withColumn("_at", F.row_number().over(runs)).where(F.col("_edge") & (F.col("_at") % 2 == 1))
    return kept.select(*page, order, trim_space(F.col("text")).alias("key"), trim_space(F.col("_value")).alias("value"))


def extract_pairs(lines: DataFrame, page: tuple[str, ...] = ("page",), order: str = "line_idx") -> DataFrame:
    """All pairs with ``confidence`` and ``pass``: on each page the colon pairs in line
    order, then the label pairs; a line with a colon pair is no label and no value."""
    marked = lines.withColumn("_taken", F.coalesce((F.instr("text", ":") > 0) & ~is_tabular(F.col("text")) & colon_pair(F.col("text")).isNotNull(), F.lit(False)))
    a = colon_pairs(lines, page, order).withColumn("confidence", F.lit(COLON_CONFIDENCE)).withColumn("pass", F.lit(1))
    b = label_pairs(marked, page, order, "_taken").withColumn("confidence", F.lit(LABEL_CONFIDENCE)).withColumn("pass", F.lit(2))
    return a.unionByName(b)

"""Page layout: positioned text elements to lines, line texts and regions.

``elements`` has the page's key columns (``page`` by default, any number), ``seq``
(order of appearance, the tie-break wherever positions are equal), ``text``,
``font_name``, ``font_size`` and the bounds ``x1 y1 x2 y2`` with y upwards. Exchanges
are by page and line, so even a page with very many elements is spread.
Rows with null coordinates sort last and start lines of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Shares of the dominant size or the average character width, and the shift of a region.
LINE_SHARE, WORD_GAP, COLUMN_GAP, REGION_SHIFT, DEFAULT_WIDTH = 0.5, 0.3, 3.0, 5.0, 0.5


def dominant_size(elements: DataFrame, page: tuple[str, ...] = ("page",)) -> DataFrame:
    """The most frequent font size of each page, at a tie the larger: ``dominant``."""
    counts = elements.groupBy(*page, "font_size").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*page).agg(F.max(F.struct("_n", "font_size"))["font_size"].alias("dominant"))


def dominant_font(elements: DataFrame, line: tuple[str, ...] = ("page", "line_idx")) -> DataFrame:
    """The most frequent (font_name, font_size) of each line; at a tie the larger size,
    then the name first in order."""
    counts = elements.groupBy(*line, "font_name", "font_size").agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(F.struct("font_name", "font_size"), F.struct((-F.col("_n")).alias("n"), (-F.col("font_size")).alias("s"), F.col("font_name").alias("f")))
    return counts.groupBy(*line).agg(best.alias("_b")).select(*line, "_b.font_name", "_b.font_size")


def union_bounds(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*by).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def region_bounds(lines: DataFrame, page: tuple[str, ...] = ("page",)) -> DataFrame:
    """The bounds of each region of analyzed lines."""
    return union_bounds(lines, (*page, "region"))


def average_width(elements: DataFrame, by: tuple[str, ...], fallback: str | None = None) -> DataFrame:
    """Mean character width over non-empty texts; without characters, half the ``fallback`` size."""
    full = F.when(F.col("text") != "", F.col("x2") - F.col("x1"))
    width = F.sum(full) / F.nullif(F.sum(F.when(F.col("text") != "", F.char_length("text"))), F.lit(0))
    other = F.lit(DEFAULT_WIDTH) * (F.max(fallback) if fallback else F.lit(1.0))
    return elements.groupBy(*by).agg(F.coalesce(width, other).alias("avg_width"))


def cluster_lines(elements: DataFrame, page: tuple[str, ...] = ("page",), share: float = LINE_SHARE) -> DataFrame:
    """Adds ``line_idx`` (from 0, top down) and ``dominant``.

    Elements are taken from the top; one joins the line if it is less than ``share``
    of the dominant size away from the line's *first* element. The anchor makes this
    a fold, not a window: the page's distinct heights (with their dominant size) are
    folded once, so a page with very many elements on few lines stays small, and the
    elements themselves are joined back by height."""
    sized = elements.withColumn("_y", F.col("y1"))
    heights = sized.groupBy(*page, "_y", "font_size").agg(F.count(F.lit(1)).alias("_n"))
    per_size = heights.groupBy(*page, "font_size").agg(F.sum("_n").alias("_n"), F.collect_set("_y").alias("_ys"))
    folded = per_size.groupBy(*page).agg(
        F.max(F.struct("_n", "font_size"))["font_size"].alias("dominant"),
        F.reverse(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ys"))))).alias("_ys"),
    )
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("line"), F.array().cast("array<struct<y:double,line:int>>").alias("out"))

    def step(acc, y):
        # with a dominant size of 0 nothing is near enough, not even the same height
        same = acc["anchor"].isNotNull() & (F.abs(acc["anchor"] - y) < F.lit(share) * F.col("dominant"))
        line = F.when(same, acc["line"]).otherwise(acc["line"] + 1)
        return F.struct(F.when(same, acc["anchor"]).otherwise(y).alias("anchor"), line.alias("line"), F.concat(acc["out"], F.array(F.struct(y.alias("y"), line.alias("line")))).alias("out"))

    lines = folded.select(*page, "dominant", F.explode(F.aggregate("_ys", start, step)["out"]).alias("_o")).select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(page)], "dominant", F.col("_o.y").alias("_oy"), F.col("_o.line").alias("line_idx"))
    on = F.col("_y").eqNullSafe(F.col("_oy"))
    for i, p in enumerate(page):
        on = on & F.col(p).eqNullSafe(F.col(f"_p{i}"))
    joined = sized.join(lines, on).select(*elements.columns, "dominant", "line_idx")
    # Where the dominant size is 0 each element is a line. Both branches read one
    # exchange; the second has rows only for such pages.
    flat = F.col("dominant") * share <= 0
    w = Window.partitionBy(*page).orderBy(F.desc("y1"), "seq")
    return joined.where(~flat | flat.isNull()).unionByName(joined.where(flat).withColumn("line_idx", (F.row_number().over(w) - 1).cast("int")))


def line_texts(elements: DataFrame, line: tuple[str, ...] = ("page", "line_idx")) -> DataFrame:
    """One row a line: ``text`` with a tab at column gaps and a blank at word gaps,
    ``font_name`` and ``font_size`` (dominant), bounds and ``n_elements``.

    Elements go from left to right. A gap of three average widths or more is a tab,
    one above 0.3 a blank, else none. A line without characters takes half the
    page's dominant size as its width."""
    whole = Window.partitionBy(*line)
    w = whole.orderBy("x1", "seq")
    full = F.col("text") != ""
    chars = F.sum(F.when(full, F.char_length("text"))).over(whole)
    other = F.lit(DEFAULT_WIDTH) * (F.max("dominant").over(whole) if "dominant" in elements.columns else F.lit(1.0))
    rows = elements.select(
        *line, "text", "font_name", "font_size", "x1", "y1", "x2", "y2",
        F.count(F.lit(1)).over(Window.partitionBy(*line, "font_name", "font_size")).alias("_fonts"),
        F.coalesce(F.sum(F.when(full, F.col("x2") - F.col("x1"))).over(whole) / F.nullif(chars, F.lit(0)), other).alias("_width"),
        (F.col("x1") - F.lag("x2").over(w)).alias("_gap"), F.row_number().over(w).alias("_at"),
    )
    sep = F.when(F.col("_gap").isNull(), "").when(F.col("_gap") >= COLUMN_GAP * F.col("_width"), "\t").when(F.col("_gap") > WORD_GAP * F.col("_width"), " ").otherwise("")
    # windows and aggregate share one exchange by line
    font = F.min_by(F.struct("font_name", "font_size"), F.struct((-F.col("_fonts")).alias("n"), (-F.col("font_size")).alias("s"), F.col("font_name").alias("f")))
    texts = rows.groupBy(*line).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.concat(sep, F.coalesce("text", F.lit(""))).alias("t")))), lambda x: x["t"]), "").alias("text"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).cast("int").alias("n_elements"), font.alias("_font"),
    )
    return texts.select(*line, "text", "x1", "y1", "x2", "y2", "n_elements", "_font.font_name", "_font.font_size")


def regions(lines: DataFrame, page: tuple[str, ...] = ("page",), order: str = "line_idx") -> DataFrame:
    """Adds ``region`` (from 0): a line goes on with the region of the line before if
    their left edges are less than five units apart and the font is the same."""
    w = Window.partitionBy(*page).orderBy(order)
    prev = lambda c: F.lag(c).over(w)
    same = (F.abs(F.col("x1") - prev("x1")) < REGION_SHIFT) & F.col("font_name").eqNullSafe(prev("font_name")) & (F.col("font_size") == prev("font_size"))
    fresh = F.when(F.row_number().over(w) == 1, 0).when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    return lines.withColumn("_fresh", fresh).withColumn("region", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_fresh")


def analyze_pages(elements: DataFrame, page: tuple[str, ...] = ("page",)) -> DataFrame:
    """Elements to lines with text, font, bounds and region, lines renumbered top down."""
    lines = line_texts(cluster_lines(elements, page), (*page, "line_idx"))
    w = Window.partitionBy(*page).orderBy(F.desc("y1"), "line_idx")
    return regions(lines.withColumn("line_idx", F.row_number().over(w) - 1), page)

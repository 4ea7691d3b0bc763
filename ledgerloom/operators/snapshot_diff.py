"""What changed between consecutive full snapshots of a keyed table.

Every row of snapshot n takes part twice: as the *new* side of the step to n and
as the *old* side of the step to the next snapshot. The tagged union of both
sides is grouped once by (step, key); a row's state is told from per-side
hashes. No snapshot is joined with another, so the work is one aggregation
shuffle however many snapshots there are, and ``max_by`` combines map-side: a key
delivered very often in one snapshot leaves each task as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import trim_ws


def _text(c: Column) -> Column:
    return F.coalesce(trim_ws(c.cast("string")), F.lit(""))


def row_hash(*cols: Column) -> Column:
    """Hash of the cells as normalised text; null and empty text are alike."""
    return F.xxhash64(*[_text(c) for c in cols])


def snapshot_changes(
    df: DataFrame,
    snapshot: str = "snapshot_no",
    key: str = "ticker",
    fields: tuple[str, ...] = ("name", "ir_page"),
    children: str | None = "presentations",
    child_key: str = "url",
    child_fields: tuple[str, ...] = ("title", "period", "year"),
    version: str = "loaded_at",
) -> DataFrame:
    """Added, removed and changed keys, and those of their child lists.

    Returns ``snapshot``, ``key``, ``child_key`` ('' for the row itself) and
    ``change``. Rules: of several deliveries of a key in a snapshot the one with
    the latest ``version`` holds (null is earliest; at a tie the larger content
    hash, so the result never depends on row order). Outer white space, null
    versus empty, and order and repeats in the child list do not count. A child
    without a key has no identity and is left out; two entries with one key in one
    list stand for the set of both. Children of added or removed keys are not
    listed. Rows without a snapshot number belong to no snapshot; a null key is a
    key of its own. Snapshots are consecutive by number among those that exist.
    Further columns, whatever their names, are not read.
    """
    kid = (
        F.transform(
            F.coalesce(F.col(children), F.array()),
            # hash and key as one text: set operations on texts are hashed, on structs they compare all pairs
            lambda p: F.when(_text(p[child_key]) != "", F.concat(row_hash(*[p[f] for f in child_fields]).cast("string"), F.lit(" "), _text(p[child_key]))),
        )
        if children
        else F.array().cast("array<string>")
    )
    rows = df.where(F.col(snapshot).isNotNull()).select(
        F.col(snapshot).alias("_n"),
        F.col(key).alias("_k"),
        F.col(version).alias("_v"),
        row_hash(*[F.col(f) for f in fields]).alias("_h"),
        F.array_sort(F.array_distinct(F.filter(kid, lambda p: p.isNotNull()))).alias("_kids"),
    )
    # One row per snapshot: a tiny table, whose window needs no large partition.
    steps = (
        df.where(F.col(snapshot).isNotNull())
        .groupBy(F.col(snapshot).alias("_n"))
        .agg(F.lit(1).alias("_one"))
        .select("_n", F.lead("_n").over(Window.partitionBy("_one").orderBy("_n")).alias("_next"), F.lag("_n").over(Window.partitionBy("_one").orderBy("_n")).alias("_before"))
    )
    state = F.struct("_v", "_h", "_kids")
    both = rows.join(steps, "_n").select(
        "_k",
        state.alias("_state"),
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.when(F.col("_before").isNotNull(), F.col("_n")).alias("step"), F.lit(True).alias("new")),
                    F.struct(F.col("_next").alias("step"), F.lit(False).alias("new")),
                ),
                lambda s: s["step"].isNotNull(),
            )
        ).alias("_s"),
    )
    sides = both.groupBy(F.col("_s.step").alias("_step"), "_k").agg(
        F.max(F.when(~F.col("_s.new"), F.col("_state"))).alias("o"),
        F.max(F.when(F.col("_s.new"), F.col("_state"))).alias("n"),
    )
    keys = lambda kids: F.array_distinct(F.transform(kids, lambda p: F.regexp_replace(p, "^-?[0-9]+ ", "")))
    only_n, only_o = keys(F.array_except("n._kids", "o._kids")), keys(F.array_except("o._kids", "n._kids"))
    all_n, all_o = keys(F.col("n._kids")), keys(F.col("o._kids"))
    change = lambda k, what: F.struct(k.alias("c"), F.lit(what).alias("w"))
    own = (
        F.when(F.col("o").isNull(), F.array(change(F.lit(""), "added")))
        .when(F.col("n").isNull(), F.array(change(F.lit(""), "removed")))
        .when(F.col("o._h") != F.col("n._h"), F.array(change(F.lit(""), "changed")))
        .otherwise(F.array().cast("array<struct<c:string,w:string>>"))
    )
    below = F.when(
        F.col("o").isNotNull() & F.col("n").isNotNull() & (F.col("o._kids") != F.col("n._kids")),
        F.concat(
            F.transform(F.array_except(only_n, all_o), lambda k: change(k, "added")),
            F.transform(F.array_except(only_o, all_n), lambda k: change(k, "removed")),
            F.transform(F.array_intersect(F.array_union(only_n, only_o), F.array_intersect(all_o, all_n)), lambda k: change(k, "changed")),
        ),
    ).otherwise(F.array().cast("array<struct<c:string,w:string>>"))
    return sides.select(F.col("_step").alias(snapshot), F.col("_k").alias(key), F.explode(F.concat(own, below)).alias("_c")).select(
        snapshot, key, F.col("_c.c").alias(child_key), F.col("_c.w").alias("change")
    )

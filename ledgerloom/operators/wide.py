"""Entity-attribute-value rows as one typed row per entity.

First the rows are reduced to one per cell (entity, attribute) with map-side
combine, so an entity or cell sent very often arrives as one row. Then entities
are hash-bucketed over the partitions; a partition's rows stream by in entity
order, entity and attribute are dictionary-encoded, and values are scattered into
one numpy array per type by row and column index, emitted as Arrow batches. An
entity never has more rows there than there are declared attributes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import blank_to_null, squeeze_ws, trim_ws
from ledgerloom.functions.typed import READERS, SPARK_TYPES, SQUEEZED

#: Slot of each type in a cell, and its numpy and Arrow types.
_NUMPY = {"string": object, "date": np.int32, "boolean": np.bool_, "integer": np.int64, "double": np.float64}
_ARROW = {"string": pa.string(), "date": pa.date32(), "boolean": pa.bool_(), "integer": pa.int64(), "double": pa.float64()}
#: Columns of one wide table; more attributes make several (``wide_tables``).
MAX_ATTRIBUTES = 10_000


def attribute_key(c: Column) -> Column:
    """An attribute's name without outer blanks, name space prefix and letter case."""
    return F.lower(F.regexp_replace(trim_ws(c), r"^[A-Za-z][A-Za-z0-9-]*[:_]\s*", ""))


def cells(df: DataFrame, concepts: DataFrame, entity: tuple[str, ...] = ("ticker", "period"), attribute: str = "concept", text: str = "raw_text", version: str = "loaded_at", tie: str = "cover_id") -> DataFrame:
    """One row per (entity, declared attribute): the latest readable value in the slot
    of its type, and ``conflict``: whether the rows give different readable values.

    Rows whose first entity column is null or blank, or whose attribute is not
    declared, do not count; text that can't be read in the type is null. Of readable
    values the latest ``version`` holds, at a tie the larger ``tie``, then value."""
    declared = concepts.select(F.lower(trim_ws(F.col("concept"))).alias("_a"), F.col("concept").alias("_concept"), F.lower(F.col("data_type")).alias("_type")).groupBy("_a").agg(F.min(F.struct("_concept", "_type")).alias("_d")).select("_a", "_d.*")
    rows = df.where(blank_to_null(F.col(entity[0])).isNotNull()).select(*[F.col(e).alias(f"_e{i}") for i, e in enumerate(entity)], attribute_key(F.col(attribute)).alias("_a"), squeeze_ws(F.col(text)).alias("_text"), F.struct(version, tie).alias("_v"))
    canon = None
    for t, read in SQUEEZED.items():
        value = read(F.col("_text")).cast("string")
        canon = F.when(F.col("_type") == t, value) if canon is None else canon.when(F.col("_type") == t, value)
    keys = [f"_e{i}" for i in range(len(entity))]
    best = (
        rows.join(declared, "_a").select(*keys, "_concept", "_type", "_v", canon.alias("_canon"))
        .groupBy(*keys, "_concept", "_type")
        .agg(F.max(F.when(F.col("_canon").isNotNull(), F.struct("_v", "_canon"))).alias("_best"), F.min("_canon").alias("_lo"), F.max("_canon").alias("_hi"))
    )
    # a reading's text form is exact, so the winner alone is turned into its type again
    typed = [F.when(F.col("_type") == t, F.col("_best._canon")).try_cast(k).alias(f"_{t}") for t, k in SPARK_TYPES.items()]
    return best.select(*[F.col(f"_e{i}").alias(e) for i, e in enumerate(entity)], F.col("_concept").alias("concept"), F.col("_type").alias("data_type"), *typed, F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False)).alias("conflict"))


def declared_attributes(concepts: DataFrame) -> list[tuple[str, str]]:
    """(attribute, type) in name order: the wide table's schema."""
    rows = concepts.groupBy(F.lower(trim_ws(F.col("concept"))).alias("_a")).agg(F.min(F.struct("concept", F.lower("data_type").alias("t"))).alias("d")).select("d.*").collect()
    return sorted((r["concept"], r["t"]) for r in rows if r["concept"] is not None and r["t"] in READERS)


def wide_tables(cell: DataFrame, attributes: list[tuple[str, str]], entity: tuple[str, ...] = ("ticker", "period"), most: int = MAX_ATTRIBUTES) -> list[DataFrame]:
    """``wide_table`` for any number of attributes: tables of at most ``most`` of them
    each, in name order. An entity has a row in each table it has cells in."""
    parts = [attributes[i : i + most] for i in range(0, max(1, len(attributes)), most)]
    return [wide_table(cell.where(F.col("concept").isin([a for a, _ in p])) if len(parts) > 1 else cell, p, entity) for p in parts]


def wide_table(cell: DataFrame, attributes: list[tuple[str, str]], entity: tuple[str, ...] = ("ticker", "period")) -> DataFrame:
    """One row per entity: the entity columns, a column of the declared type for each
    attribute, and ``conflicts``: the attributes whose rows disagree. Attributes
    named like an entity column get the suffix ``_value``."""
    width, n = len(entity), len(attributes)
    names = [a + "_value" if a.lower() in {*(e.lower() for e in entity), "conflicts"} else a for a, _ in attributes]
    kinds = dict(cell.dtypes)
    at = {a: i for i, (a, _) in enumerate(attributes)}
    slot = {t: i for i, t in enumerate(READERS)}
    order = {t: [i for i, (_, k) in enumerate(attributes) if k == t] for t in READERS}
    place = {i: k for cols in order.values() for k, i in enumerate(cols)}

    def emit(t: pa.Table) -> pa.RecordBatch:
        keys = [t.column(i).combine_chunks() for i in range(width)]
        # rows are sorted by entity: a new code wherever a key column changes
        codes = [k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in keys]
        first = np.ones(len(t), bool)
        if len(t) > 1:
            first[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
        row = np.cumsum(first) - 1
        rows = int(row[-1]) + 1
        attr = t.column(width).combine_chunks().dictionary_encode()
        lookup = np.array([at.get(x, -1) for x in attr.dictionary.to_pylist()], np.int64)
        col = lookup[attr.indices.to_numpy(zero_copy_only=False)]
        arrays: list[pa.Array | None] = [None] * n
        for kind, cols in order.items():
            if not cols:
                continue
            values, there = np.zeros((rows, len(cols)), _NUMPY[kind]), np.zeros((rows, len(cols)), bool)
            v = t.column(width + 2 + slot[kind]).combine_chunks()
            ok = (np.isin(col, cols)) & v.is_valid().to_numpy(zero_copy_only=False)
            if ok.any():
                r, c = row[ok], np.array([place[x] for x in col[ok]])
                got = v.filter(pa.array(ok))
                values[r, c] = got.to_numpy(zero_copy_only=False) if kind not in ("date",) else got.cast(pa.int32()).to_numpy(zero_copy_only=False)
                there[r, c] = True
            for k, i in enumerate(cols):
                arrays[i] = pa.array(values[:, k], _ARROW[kind], mask=~there[:, k])
        clash = t.column(width + 2 + len(slot)).to_numpy(zero_copy_only=False).astype(bool)
        ends = np.zeros(rows + 1, np.int32)
        np.add.at(ends, row[clash] + 1, 1)
        conflicts = pa.ListArray.from_arrays(pa.array(np.cumsum(ends).astype(np.int32)), t.column(width).combine_chunks().filter(pa.array(clash)))
        pick = pa.array(np.flatnonzero(first))
        return pa.RecordBatch.from_arrays([*(k.take(pick) for k in keys), *arrays, conflicts], [*entity, *names, "conflicts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = pa.concat_tables([held, t]) if held is not None else t
            # the last entity may go on in the next batch
            last = [held.column(i)[-1].as_py() for i in range(width)]
            cut = held.num_rows
            while cut and [held.column(i)[cut - 1].as_py() for i in range(width)] == last:
                cut -= 1
            if cut:
                yield emit(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield emit(held)

    schema = ", ".join([*(f"`{e}` {kinds[e]}" for e in entity), *(f"`{x}` {SPARK_TYPES[k]}" for x, (_, k) in zip(names, attributes, strict=True)), "conflicts array<string>"])
    src = cell.select(*entity, "concept", "data_type", *[f"_{t}" for t in READERS], "conflict")
    return src.repartition(*entity).sortWithinPartitions(*entity, "concept").mapInArrow(run, schema)


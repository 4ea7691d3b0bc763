"""Queries p1 to p5 over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import flatten, schema_drift, snapshot_diff, units, wide


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    prints = schema_drift.fingerprints(table(spark, d, "statement_files"))
    return schema_drift.schema_changes(prints).select("file_id", "sheet_name", "field", "change")


def p1_items(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent_items(table(spark, d, "statement_files"))


def p1_unreadable(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.unreadable_statements(table(spark, d, "statement_files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff.snapshot_changes(table(spark, d, "registry_snapshots"))


def p3_quantities(spark: SparkSession, d: str) -> DataFrame:
    return units.normalise_units(table(spark, d, "facts"), table(spark, d, "unit_factors"))


def p3_held_out(spark: SparkSession, d: str) -> DataFrame:
    return units.held_out(table(spark, d, "facts"), table(spark, d, "unit_factors"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return units.restated_facts(table(spark, d, "facts"), table(spark, d, "unit_factors"))


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    concepts = table(spark, d, "concepts")
    return wide.wide_table(wide.cells(table(spark, d, "cover_facts"), concepts), wide.declared_attributes(concepts))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_wide(spark, d).select("ticker", "period", F.explode("conflicts").alias("concept"))


def p4_cells(spark: SparkSession, d: str) -> DataFrame:
    """The wide table's cells as rows again: doubles as ``number``, others as text."""
    wide_rows = p4_wide(spark, d)
    kinds = {c: k for c, k in wide_rows.dtypes if c not in ("ticker", "period", "conflicts")}
    number = lambda c, k: F.col(c) if k == "double" else F.lit(None).cast("double")
    text = lambda c, k: F.lit(None).cast("string") if k == "double" else F.col(c).cast("string")
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("concept"), text(c, k).alias("value"), number(c, k).alias("number")) for c, k in kinds.items()])).alias("c")
    return wide_rows.select("ticker", "period", cell).where("c.value is not null or c.number is not null").select("ticker", "period", "c.*")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every inner object, by way of its variant: the keys that all subtype tables share."""
    both = _variants(spark, d, "response", ("attachment",)).withColumn("src", F.lit("response")).unionByName(_variants(spark, d, "statement", ("item",)).withColumn("src", F.lit("statement")))
    return both.where(F.col("variant").isNotNull()).select("src", "parent_id", "outer_no", "inner_no").distinct()


_BODIES = {"response": ("report_responses", "response_id", flatten.RESPONSE), "statement": ("statement_files", "file_id", flatten.STATEMENT)}


def _variants(spark: SparkSession, d: str, src: str, kinds: tuple[str, ...] = (), payload: bool = False) -> DataFrame:
    name, key, level = _BODIES[src]
    return flatten.flatten(table(spark, d, name), key, "body", level, kinds, payload)


def p5_attachments(spark: SparkSession, d: str) -> DataFrame:
    schema = "File_Name string, File_Path string, File_Type string, File_Size string, Emiten_Code string, Report_Period string, Report_Year string"
    return flatten.subtype_table(_variants(spark, d, "response", ("attachment",), True), "attachment", schema).drop("variant", "members")


def p5_items(spark: SparkSession, d: str) -> DataFrame:
    return flatten.subtype_table(_variants(spark, d, "statement", ("item",), True), "item", "label string").drop("variant", "members")


def p5_sheets(spark: SparkSession, d: str) -> DataFrame:
    return flatten.subtype_table(_variants(spark, d, "statement", ("sheet",), True), "sheet", "name string, currency string, hidden boolean").drop("inner_no", "variant", "members")


def p5_results(spark: SparkSession, d: str) -> DataFrame:
    return flatten.subtype_table(_variants(spark, d, "response", ("result",), True), "result", "Emiten struct<Code:string,Boards:array<string>>").select("parent_id", "outer_no", F.col("Emiten.Code").alias("emiten"), F.array_join("Emiten.Boards", "|").alias("boards"))


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    return flatten.leaves(table(spark, d, "statement_files"), "file_id", "body", flatten.STATEMENT, "values")


def p5_variants(spark: SparkSession, d: str) -> DataFrame:
    return flatten.variant_tables(_variants(spark, d, "response").unionByName(_variants(spark, d, "statement")))


def p5_variant_attachments(spark: SparkSession, d: str) -> DataFrame:
    """The typed table of the attachments that have the supertype's members only."""
    return flatten.variant_table(_variants(spark, d, "response", ("attachment",), True), "attachment", flatten.RESPONSE).drop("members")


def p5_variant_items(spark: SparkSession, d: str) -> DataFrame:
    """The typed table of the items with numbers only, one value a row."""
    flat = flatten.variant_table(_variants(spark, d, "statement", ("item",), True), "item", flatten.STATEMENT)
    return flat.select("parent_id", "outer_no", "inner_no", "label", F.explode("values").alias("name", "number")).where(F.col("number").isNotNull())


def p5_unreadable(spark: SparkSession, d: str) -> DataFrame:
    parts = [flatten.unreadable(table(spark, d, name), key, "body").withColumn("src", F.lit(src)) for src, (name, key, _) in _BODIES.items()]
    return parts[0].unionByName(parts[1])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_items, p1_unreadable, p2_found, p3_found, p3_quantities, p3_held_out, p4_found, p4_wide, p4_cells, p5_found, p5_attachments, p5_items, p5_sheets, p5_results, p5_values, p5_variants, p5_variant_attachments, p5_variant_items, p5_unreadable)}

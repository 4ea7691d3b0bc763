"""Queries p6 to p9 over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import canon, leakage, split, tokens


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def entered(spark: SparkSession, d: str) -> DataFrame:
    """Every freely entered value with its field and row."""
    parts = (("label", "line_items", "item_id", "label"), ("key", "kv_pairs", "kv_id", "key"), ("report_period", "catalog", "attachment_id", "report_period"))
    out = None
    for field, name, key, value in parts:
        p = table(spark, d, name).select(F.lit(field).alias("field_name"), F.col(key).alias("row_id"), F.col(value).alias("value"))
        out = p if out is None else out.unionByName(p)
    return out


def p6_mapped(spark: SparkSession, d: str) -> DataFrame:
    return canon.match_values(entered(spark, d), table(spark, d, "canon_terms")).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    got = canon.match_values(entered(spark, d), table(spark, d, "canon_terms"))
    return got.where(F.col("how") == "matched").select("field_name", "row_id", "term_id").distinct()


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    got = canon.match_values(entered(spark, d), table(spark, d, "canon_terms"))
    return got.where(F.col("how") == "unmatched").groupBy("field_name", "value").agg(F.count_distinct("row_id").alias("n_rows"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p7_words(spark: SparkSession, d: str) -> DataFrame:
    return tokens.word_table(tokens.split_words(table(spark, d, "documents")))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode_corpus(p7_ids(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_evidence(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_templates(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_templates(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return split.oversized(table(spark, d, "documents"))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_corpus(table(spark, d, "documents"))


def p9_joined(spark: SparkSession, d: str) -> DataFrame:
    """Texts put together again from their pieces' fresh parts, with the largest piece's
    tokens: what the splitter must keep."""
    pieces = p9_pieces(spark, d)
    fresh = F.expr("substring(text, char_fresh - char_start + 1)")
    rows = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", fresh.alias("t")))).alias("p"), F.max("n_tokens").alias("most"), F.max("n_pieces").alias("n"))
    return rows.select("doc_id", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"), (F.col("most") <= split.LIMIT).alias("within_limit"), (F.size("p") == F.col("n")).alias("complete"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p6_found, p6_mapped, p6_unmatched, p7_ids, p7_words, p7_decoded, p8_found, p8_evidence, p8_templates, p9_found, p9_pieces, p9_joined)}

ORACLE: dict[str, str] = {
    # a document's text comes back from its ids; null texts as empty ones
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    # pieces without their overlaps are the text
    "p9_joined": "SELECT doc_id, coalesce(text, '') AS text, true AS within_limit, true AS complete FROM documents",
}

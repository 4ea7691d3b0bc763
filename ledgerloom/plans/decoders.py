"""Queries for the document decoders: rows of the tables are written as workbooks,
tagged archives and page documents, and decoded again. ``SQL`` states what must come
out, from the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import filings, flatten
from ledgerloom.plans.general import table
from ledgerloom.plans.general_sql import _ITEMS, _SHEETS
from ledgerloom.sources import files, write

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _written(rows: DataFrame, build: Callable[[dict], bytes]) -> DataFrame:
    """``path`` (the first column) and ``content`` built from each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                made = [build(r) for r in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def _decoded(rows: DataFrame, build: Callable[[dict], bytes], kind: str, key: str) -> DataFrame:
    got = files.decode(_written(rows, build), kind)
    return got.withColumn(key, F.col("path").cast("bigint")).drop("path")


# XML can't hold some control characters; the writers leave them out
_XML = "regexp_replace({0}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{fffe}}\\x{{ffff}}]', '', 'g')"


def _workbook_of(r: dict) -> bytes:
    sheets: list[tuple[str, dict[int, list]]] = []
    for kind, i, j, obj in flatten.nodes(r["body"], flatten.STATEMENT):
        if kind == "sheet":
            name = obj.get("name")
            sheets.append((name if isinstance(name, str) else f"Sheet{i}", {}))
        else:
            label, values = obj.get("label"), obj.get("values")
            sheets[-1][1][j] = [label if isinstance(label, str) else None, *(v if not isinstance(v, list | dict) else None for v in (values.values() if isinstance(values, dict) else ()))]
    return write.workbook(sheets)


@query(f"""WITH f AS (SELECT DISTINCT file_id AS k, CAST(body AS JSON) AS b FROM statement_files WHERE json_valid(body)),
g AS (SELECT k, {_SHEETS} AS l FROM f),
h AS (SELECT k, i AS o, json_extract(l, '$[' || i || ']') AS s FROM (SELECT k, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS i FROM g)),
n AS (SELECT k, o, s, CAST(row_number() OVER (PARTITION BY k ORDER BY o) - 1 AS INTEGER) AS sheet_idx, CASE json_type(json_extract(s, '$.name')) WHEN 'VARCHAR' THEN json_extract_string(s, '$.name') ELSE 'Sheet' || o END AS name FROM h WHERE json_type(s) = 'OBJECT'),
z AS (SELECT k, sheet_idx, name, {_ITEMS} AS l FROM n),
y AS (SELECT k, sheet_idx, name, j, json_extract(l, '$[' || j || ']') AS x FROM (SELECT *, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS j FROM z)),
i AS (SELECT *, json_extract(x, '$.values') AS v FROM y WHERE json_type(x) = 'OBJECT'),
w AS (SELECT k, sheet_idx, name, j, 0 AS c, json_extract(x, '$.label') AS t FROM i UNION ALL
  SELECT k, sheet_idx, name, j, c, json_extract(v, '/' || replace(replace(keys[c], '~', '~0'), '/', '~1')) FROM (SELECT *, unnest(range(1, len(keys) + 1)) AS c FROM (SELECT *, json_keys(v) AS keys FROM i WHERE json_type(v) = 'OBJECT')))
SELECT k AS file_id, sheet_idx, {_XML.format("name")} AS sheet_name, CAST(j AS INTEGER) AS row_idx, CAST(c AS INTEGER) AS col_idx,
  CASE json_type(t) WHEN 'VARCHAR' THEN {_XML.format("json_extract_string(t, '$')")} WHEN 'BOOLEAN' THEN upper(CAST(t AS VARCHAR)) ELSE regexp_replace(regexp_replace(CAST(t AS VARCHAR), '\\.0$', ''), '^-0$', '0') END AS text
FROM w WHERE json_type(t) IN ('VARCHAR', 'BOOLEAN', 'BIGINT', 'UBIGINT', 'DOUBLE') AND (c > 0 OR json_type(t) = 'VARCHAR')""")
def ref_xlsx_cells(spark: SparkSession, d: str) -> DataFrame:
    """Statements as workbooks: every cell, with its sheet and place."""
    rows = table(spark, d, "statement_files").select("file_id", "body").distinct()
    return _decoded(rows, _workbook_of, "xlsx", "file_id").where("error is null").drop("error")


@query(f"""WITH i AS (SELECT DISTINCT item_id, sheet_name, {_XML.format("label")} AS label, item_values AS v FROM line_items),
e AS (SELECT item_id, sheet_name, trim(regexp_replace(label, '^[\\s\\x{{a0}}\\x{{85}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{1680}}]+|[\\s\\x{{a0}}\\x{{85}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{1680}}]+$', '', 'g')) AS label, unnest(map_entries(v)) AS e FROM i)
SELECT item_id, coalesce(sheet_name, '') AS sheet_name, label, e.key AS field, e.value AS value FROM e WHERE label <> '' AND e.value IS NOT NULL AND e.key <> ''""")
def ref_xlsx_items(spark: SparkSession, d: str) -> DataFrame:
    """Line items as workbooks of a header and a row: labels and numbers by header."""
    rows = table(spark, d, "line_items").select("item_id", "sheet_name", "label", F.to_json("item_values").alias("v")).distinct()

    def build(r: dict) -> bytes:
        values = json.loads(r["v"] or "{}")
        return write.workbook([(r["sheet_name"] or "", {0: ["Account", *values], 1: [r["label"], *values.values()]})])

    cells = _decoded(rows, build, "xlsx", "item_id").where("error is null")
    names = cells.select("item_id", "sheet_name").distinct()
    items = filings.items_from_cells(cells, ("item_id", "sheet_idx"))
    return items.join(names, "item_id").select("item_id", "sheet_name", "label", F.explode("values").alias("field", "value"))


_FACT = ("fact_id", "concept", "raw_text", "unit", "period", "decimals")


@query(f"SELECT DISTINCT fact_id, 'facts.' || ['htm', 'html', 'xml', 'xbrl'][1 + fact_id % 4] AS entry, coalesce({_XML.format('concept')}, 'nonFraction') AS concept, value, coalesce(unit, '') AS unit, coalesce(period, '') AS period, coalesce(decimals, '') AS decimals, coalesce({_XML.format('raw_text')}, '') AS raw_text FROM facts")
def ref_xbrl_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts as archives with a tagged document beside one that is none: the value a
    project keeps of each text, and its attributes."""
    rows = table(spark, d, "facts").select(*_FACT).distinct()

    def build(r: dict) -> bytes:
        kind = ("htm", "html", "xml", "xbrl")[r["fact_id"] % 4]
        return write.archive([("readme.txt", "no facts here"), (f"facts.{kind}", write.inline_facts([r | {"text": r["raw_text"]}]))])

    got = _decoded(rows, build, "xbrl", "fact_id").where("error is null")
    return got.select("fact_id", "entry", "concept", "value", "unit", "period", "decimals", "raw_text")


@query("SELECT filing_id, count(DISTINCT fact_id) AS n_facts, CAST(0 AS BIGINT) AS n_errors, CAST(sum(CASE WHEN regexp_full_match(replace(regexp_replace(coalesce(raw_text, ''), '^\\s+|\\s+$', '', 'g'), ',', ''), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN 1 ELSE 0 END) AS BIGINT) AS n_numeric FROM (SELECT DISTINCT filing_id, fact_id, raw_text FROM facts WHERE filing_id IS NOT NULL) GROUP BY filing_id")
def ref_xbrl_filings(spark: SparkSession, d: str) -> DataFrame:
    """Filings as archives of one document an XBRL entry, facts of a filing together."""
    rows = table(spark, d, "facts").where("filing_id is not null").select("filing_id", *_FACT).distinct().groupBy("filing_id").agg(F.collect_list(F.struct(*_FACT)).alias("facts"))  # a filing is one document

    def build(r: dict) -> bytes:
        facts = [f | {"text": f["raw_text"]} for f in r["facts"]]
        return write.archive([("a/one.XML", write.inline_facts(facts[::2])), ("two.htm", write.inline_facts(facts[1::2]))])

    got = _decoded(rows, build, "xbrl", "filing_id")
    return got.groupBy("filing_id").agg(F.count("concept").alias("n_facts"), F.count("error").alias("n_errors"), F.count_if("is_numeric").alias("n_numeric"))


def _latin(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^\\x00-\\xff]', '?', 'g')"


_KV = "(SELECT DISTINCT kv_id, key, value, file_name, page_num FROM kv_pairs)"


def _pages_of(r: dict) -> bytes:
    """The key on the first page, the value in the form object, compressed by turns."""
    key = b"BT /F1 12 Tf 72 700 Td %s Tj ET /Fm0 Do" % write.literal(r["key"] or "")
    form = b"BT /F2 10 Tf 14 TL 300 650 Td %s Tj ET" % write.hexed(r["value"] or "")
    return write.pages([key, *[b"BT /F1 9 Tf 10 10 Td ET"] * (int(r["page_num"] or 0) % 3)], form, r["file_name"] or "", bool(r["kv_id"] % 2))


@query(f"""WITH e AS (SELECT kv_id, {_latin("key")} AS key, {_latin("value")} AS value FROM {_KV})
SELECT kv_id, 1 AS page, key AS text, 'F1' AS font_name, 12.0::DOUBLE AS font_size, 72.0::DOUBLE AS x1, 700.0::DOUBLE AS y1, 72.0 + length(key) * 6.0::DOUBLE AS x2 FROM e WHERE key <> ''
UNION ALL SELECT kv_id, 1, value, 'F2', 10.0, 300.0, 650.0, 300.0 + length(value) * 5.0 FROM e WHERE value <> ''""")
def ref_pdf_elements(spark: SparkSession, d: str) -> DataFrame:
    """Pairs as page documents, the value in a form object: texts, fonts and places."""
    rows = table(spark, d, "kv_pairs").select("kv_id", "key", "value", "file_name", "page_num").distinct()
    got = _decoded(rows, _pages_of, "pdf", "kv_id").where("error is null and text is not null")
    return got.select("kv_id", "page", "text", "font_name", "font_size", "x1", "y1", "x2")


@query(f"SELECT kv_id, {_latin('file_name')} AS title, '' AS author, CAST(1 + coalesce(page_num, 0) % 3 AS INTEGER) AS pages FROM {_KV}")
def ref_pdf_meta(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "kv_pairs").select("kv_id", "key", "value", "file_name", "page_num").distinct()
    return _decoded(rows, _pages_of, "pdf_meta", "kv_id").where("error is null").select("kv_id", "title", "author", "pages")


@query("SELECT DISTINCT attachment_id, k AS kind, true AS failed FROM catalog, (VALUES ('xlsx'), ('xbrl'), ('pdf')) AS t(k)")
def ref_decode_errors(spark: SparkSession, d: str) -> DataFrame:
    """Content that is no document: every file has its error, and no other fails."""
    rows = table(spark, d, "catalog").select("attachment_id", "file_name").distinct()
    build = lambda r: (r["file_name"] or "").encode()
    parts = [_decoded(rows, build, k, "attachment_id").select("attachment_id", F.lit(k).alias("kind"), F.col("error").isNotNull().alias("failed")) for k in ("xlsx", "xbrl", "pdf")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()

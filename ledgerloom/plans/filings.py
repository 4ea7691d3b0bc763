"""Queries for the operators of filing extraction, over adapter views of the tables.

The adapters give every operator discriminating input from the relational tables;
``SQL`` holds the same queries for a second engine. Queries read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import exprs
from ledgerloom.operators import filings, kv, layout
from ledgerloom.plans.general import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Unicode white space, for an engine whose \s is ASCII.
_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _num(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') AND NOT isinf(TRY_CAST({x} AS DOUBLE)) THEN TRY_CAST({x} AS DOUBLE) END"


# --- adapters --------------------------------------------------------------------

_LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def elements(spark: SparkSession, d: str) -> DataFrame:
    """Line items as positioned text elements, a page per order."""
    w = Window.partitionBy("l_orderkey").orderBy(*_LINEITEM)
    x1 = (F.col("l_suppkey") * 7 % 500).cast("double")
    y1 = (F.col("l_partkey") % 60).cast("double")
    size = (8 + 2 * (F.col("l_linenumber") % 3)).cast("double")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.row_number().over(w).alias("seq"), F.concat("l_returnflag", "l_linestatus").alias("text"), F.col("l_returnflag").alias("font_name"), size.alias("font_size"),
        x1.alias("x1"), y1.alias("y1"), (x1 + F.col("l_quantity")).alias("x2"), (y1 + size).alias("y2"),
    )


_ELEMENTS = f"""elements AS (
  SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_LINEITEM)}) AS INTEGER) AS seq, l_returnflag || l_linestatus AS text, l_returnflag AS font_name,
         CAST(8 + 2 * (l_linenumber % 3) AS DOUBLE) AS font_size, CAST(l_suppkey * 7 % 500 AS DOUBLE) AS x1, CAST(l_partkey % 60 AS DOUBLE) AS y1,
         CAST(l_suppkey * 7 % 500 AS DOUBLE) + l_quantity AS x2, CAST(l_partkey % 60 AS DOUBLE) + 8 + 2 * (l_linenumber % 3) AS y2
  FROM lineitem)"""
_DOMINANT = """dominant AS (
  SELECT page, font_size AS dominant FROM (SELECT page, font_size, row_number() OVER (PARTITION BY page ORDER BY count(*) DESC, font_size DESC) AS k FROM elements GROUP BY page, font_size) WHERE k = 1)"""
# the anchor of the current line is carried from element to element
_CLUSTERED = f"""WITH RECURSIVE {_ELEMENTS}, {_DOMINANT},
ranked AS (SELECT e.*, dominant, row_number() OVER (PARTITION BY page ORDER BY y1 DESC, seq) AS k FROM elements e JOIN dominant USING (page)),
fold AS (
  SELECT page, seq, k, y1 AS anchor, 0 AS line_idx FROM ranked WHERE k = 1
  UNION ALL
  SELECT r.page, r.seq, r.k, CASE WHEN abs(f.anchor - r.y1) < 0.5 * r.dominant THEN f.anchor ELSE r.y1 END, CASE WHEN abs(f.anchor - r.y1) < 0.5 * r.dominant THEN f.line_idx ELSE f.line_idx + 1 END
  FROM fold f JOIN ranked r ON r.page = f.page AND r.k = f.k + 1),
clustered AS (SELECT r.*, f.line_idx FROM ranked r JOIN fold f USING (page, seq))"""


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of text, a page per user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(
        F.col("user_id").alias("page"), (F.row_number().over(w) - 1).alias("line_idx"), F.col("event_type").alias("font_name"), (10 + F.col("event_id") * 7 % 5).cast("double").alias("font_size"),
        (F.col("event_id") % 8).cast("double").alias("x_region"), (F.col("event_id") * 13 % 120).cast("double").alias("x_label"),
        F.when(F.col("event_id") % 6 == 0, F.concat("event_type", F.lit(": "), F.col("event_id").cast("string"))).otherwise(F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"))).alias("text"),
    )


_LINES = """lines AS (
  SELECT user_id AS page, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS line_idx, event_type AS font_name, CAST(10 + event_id * 7 % 5 AS DOUBLE) AS font_size,
         CAST(event_id % 8 AS DOUBLE) AS x_region, CAST(event_id * 13 % 120 AS DOUBLE) AS x_label,
         CASE WHEN event_id % 6 = 0 THEN event_type || ': ' || event_id ELSE event_type || ' ' || event_id END AS text
  FROM events)"""


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line_idx", "text"))


_DOC_LINES = """lines AS (
  SELECT page, CAST(i - 1 AS INTEGER) AS line_idx, parts[i] AS text FROM (SELECT doc_id AS page, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL), unnest(range(1, len(parts) + 1)) AS u(i))"""

# --- scalar expressions ------------------------------------------------------------


@query("SELECT attachment_id, file_name, CASE lower(regexp_extract(file_name, '(\\.[^./]*)$', 1)) WHEN '.xlsx' THEN 'xlsx' WHEN '.zip' THEN 'xbrl' WHEN '.pdf' THEN 'pdf' ELSE '' END AS format FROM catalog")
def ref_detect_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "catalog").select("attachment_id", "file_name", exprs.detect_format(F.col("file_name")).alias("format"))


_META = "(?i)FinancialStatement-(\\d{4})-([^-]+)-([A-Z]{4})"


@query(
    f"SELECT file_id, coalesce(regexp_extract(file_name, '{_META}\\.xlsx$', 3), '') AS ticker, coalesce(TRY_CAST(regexp_extract(file_name, '{_META}\\.xlsx$', 1) AS INTEGER), 0) AS year, coalesce(regexp_extract(file_name, '{_META}\\.xlsx$', 2), '') AS period, "
    f"coalesce(regexp_extract(replace(file_name, '.xlsx', 'X.zip'), '{_META}', 3), '') AS zip_ticker FROM statement_files"
)
def ref_filename_meta(spark: SparkSession, d: str) -> DataFrame:
    zipped = exprs.filename_meta(F.replace("file_name", F.lit(".xlsx"), F.lit("X.zip")), xlsx=False)
    return table(spark, d, "statement_files").select("file_id", exprs.filename_meta(F.col("file_name")).alias("m"), zipped.alias("z")).select("file_id", "m.*", F.col("z.ticker").alias("zip_ticker"))


@query(f"SELECT file_id, coalesce(nullif(ticker, ''), regexp_extract(file_name, '{_META}\\.xlsx$', 3)) AS ticker, coalesce(nullif(year, 0), 1) AS year FROM statement_files")
def ref_fallback_meta(spark: SparkSession, d: str) -> DataFrame:
    meta = exprs.filename_meta(F.col("file_name"))
    return table(spark, d, "statement_files").select("file_id", exprs.or_fallback(F.col("ticker"), meta["ticker"], "").alias("ticker"), exprs.or_fallback(F.col("year"), F.lit(1), 0).alias("year"))


@query("SELECT attachment_id, CASE WHEN upper(report_period) = 'FY' THEN 'Audit' ELSE report_period END AS period FROM catalog")
def ref_normalize_period(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "catalog").select("attachment_id", exprs.normalize_period(F.col("report_period")).alias("period"))


@query("SELECT n_nationkey, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS ticker FROM (SELECT n_nationkey, string_split(upper(n_name || ',' || ' x,' || n_name), ',') AS parts FROM nation), unnest(range(1, len(parts) + 1)) AS u(i)")
def ref_ticker_list(spark: SparkSession, d: str) -> DataFrame:
    arg = F.concat("n_name", F.lit(", x,"), "n_name")
    return table(spark, d, "nation").select("n_nationkey", F.posexplode(exprs.tickers(arg)).alias("pos", "ticker"))


@query(f"SELECT fact_id, {_num(_trim('raw_text'))} AS xlsx, coalesce({_num('replace(' + _trim('raw_text') + ', $$,$$, $$$$)')}, 0.0) AS xbrl, coalesce({_num('raw_text')}, 0.0) AS pdf FROM facts")
def ref_parse_number(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw_text")
    return table(spark, d, "facts").select("fact_id", exprs.parse_number_xlsx(raw).alias("xlsx"), exprs.parse_number_xbrl(raw).alias("xbrl"), exprs.parse_number_pdf(raw).alias("pdf"))


@query(f"WITH {_DOC_LINES}, split AS (SELECT page, line_idx, text, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '') AS f FROM lines) SELECT page, line_idx, len(f) >= 3 AND len(list_filter(f, lambda x: regexp_full_match(translate(x, ',.()-', ''), '[0-9]+'))) >= 2 AS tabular FROM split")
def ref_is_tabular(spark: SparkSession, d: str) -> DataFrame:
    return document_lines(spark, d).select("page", "line_idx", exprs.is_tabular(F.col("text")).alias("tabular"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, abs(CASE WHEN l_tax <> 0 AND l_tax <> l_discount THEN l_quantity * l_tax ELSE l_quantity * l_discount END) AS size, length(l_returnflag || l_linestatus) * l_quantity * 0.5 AS width, abs(l_suppkey * 7 - 350) > 300 AS is_space FROM lineitem")
def ref_text_metrics(spark: SparkSession, d: str) -> DataFrame:
    size = exprs.effective_font_size(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"))
    width = exprs.text_width(F.concat("l_returnflag", "l_linestatus"), F.col("l_quantity"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", size.alias("size"), width.alias("width"), exprs.kerning_is_space(F.col("l_suppkey") * 7 - 350).alias("is_space"))


@query("SELECT file_id, 'emitenCode=' || coalesce(ticker, '') || '&periode=' || period || '&year=' || year AS query, 'data/' || coalesce(ticker, 'none') || '/' || year || '/' || period || '/' || file_name AS path FROM statement_files")
def ref_request_and_path(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("ticker", F.lit(""))
    q = exprs.request_query({"year": F.col("year").cast("string"), "emitenCode": t, "periode": F.col("period")})
    return table(spark, d, "statement_files").select("file_id", q.alias("query"), exprs.cache_path(F.coalesce("ticker", F.lit("none")), F.col("year"), F.col("period"), F.col("file_name")).alias("path"))


_NS = "CASE source WHEN 'xbrl' THEN 'http://www.xbrl.org/2013/inlineXBRL' WHEN 'xlsx' THEN 'http://xbrl.ifrs.org/taxonomy/2023' ELSE 'http://www.w3.org/1999/xhtml' END"
_LOCAL = "CASE WHEN concept LIKE 'fin:%' THEN 'nonFraction' ELSE 'span' END"


@query(f"SELECT fact_id FROM facts WHERE (({_NS}) LIKE '%inline%' AND ({_LOCAL}) IN ('nonFraction', 'nonNumeric')) OR ({_NS}) LIKE '%ifrs%'")
def ref_fact_elements(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "facts").where(exprs.is_fact_element(F.expr(_NS), F.expr(_LOCAL))).select("fact_id")


# --- layout --------------------------------------------------------------------------


@query(f"WITH {_ELEMENTS}, {_DOMINANT} SELECT page, dominant FROM dominant")
def ref_dominant_size(spark: SparkSession, d: str) -> DataFrame:
    return layout.dominant_size(elements(spark, d))


@query(f"WITH {_ELEMENTS} SELECT page, font_name, font_size FROM (SELECT page, font_name, font_size, row_number() OVER (PARTITION BY page ORDER BY count(*) DESC, font_size DESC, font_name) AS k FROM elements GROUP BY ALL) WHERE k = 1".replace("GROUP BY ALL", "GROUP BY page, font_name, font_size"))
def ref_dominant_font(spark: SparkSession, d: str) -> DataFrame:
    return layout.dominant_font(elements(spark, d), ("page",))


@query(f"WITH {_ELEMENTS} SELECT page, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM elements GROUP BY page")
def ref_union_bounds(spark: SparkSession, d: str) -> DataFrame:
    return layout.union_bounds(elements(spark, d), ("page",))


@query(f"WITH {_ELEMENTS} SELECT page, sum(x2 - x1) / sum(length(text)) AS avg_width FROM elements GROUP BY page")
def ref_average_width(spark: SparkSession, d: str) -> DataFrame:
    return layout.average_width(elements(spark, d), ("page",))


@query(f"{_CLUSTERED} SELECT page, seq, line_idx FROM clustered")
def ref_cluster_lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.cluster_lines(elements(spark, d)).select("page", "seq", "line_idx")


_TEXTS = f"""{_CLUSTERED},
widths AS (SELECT page, line_idx, sum(x2 - x1) / sum(length(text)) AS w FROM clustered GROUP BY page, line_idx),
gaps AS (SELECT c.*, w, x1 - lag(x2) OVER (PARTITION BY page, line_idx ORDER BY x1, seq) AS gap FROM clustered c JOIN widths USING (page, line_idx))"""


@query(
    f"{_TEXTS} SELECT page, line_idx, string_agg(CASE WHEN gap IS NULL THEN '' WHEN gap >= 3.0 * w THEN chr(9) WHEN gap > 0.3 * w THEN ' ' ELSE '' END || text, '' ORDER BY x1, seq) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, CAST(count(*) AS INTEGER) AS n_elements FROM gaps GROUP BY page, line_idx"
)
def ref_line_texts(spark: SparkSession, d: str) -> DataFrame:
    return layout.line_texts(layout.cluster_lines(elements(spark, d))).select("page", "line_idx", "text", "x1", "y1", "x2", "y2", "n_elements")


@query(
    f"WITH {_LINES}, marked AS (SELECT *, CASE WHEN lag(font_name) OVER w IS NULL OR (abs(x_region - lag(x_region) OVER w) < 5 AND font_name = lag(font_name) OVER w AND font_size = lag(font_size) OVER w) THEN 0 ELSE 1 END AS fresh FROM lines WINDOW w AS (PARTITION BY page ORDER BY line_idx)) "
    "SELECT page, line_idx, CAST(sum(fresh) OVER (PARTITION BY page ORDER BY line_idx ROWS UNBOUNDED PRECEDING) AS INTEGER) AS region FROM marked"
)
def ref_regions(spark: SparkSession, d: str) -> DataFrame:
    return layout.regions(event_lines(spark, d).withColumnRenamed("x_region", "x1")).select("page", "line_idx", "region")


_PAGE_LINES = f"""{_TEXTS},
texts AS (SELECT page, line_idx AS old, string_agg(CASE WHEN gap IS NULL THEN '' WHEN gap >= 3.0 * w THEN chr(9) WHEN gap > 0.3 * w THEN ' ' ELSE '' END || text, '' ORDER BY x1, seq) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, CAST(count(*) AS INTEGER) AS n_elements FROM gaps GROUP BY page, line_idx),
fonts AS (SELECT page, line_idx AS old, font_name, font_size FROM (SELECT page, line_idx, font_name, font_size, row_number() OVER (PARTITION BY page, line_idx ORDER BY count(*) DESC, font_size DESC, font_name) AS k FROM clustered GROUP BY page, line_idx, font_name, font_size) WHERE k = 1),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY y1 DESC, old) - 1 AS INTEGER) AS line_idx FROM texts JOIN fonts USING (page, old)),
marked AS (SELECT *, CASE WHEN lag(font_name) OVER w IS NULL OR (abs(x1 - lag(x1) OVER w) < 5 AND font_name = lag(font_name) OVER w AND font_size = lag(font_size) OVER w) THEN 0 ELSE 1 END AS fresh FROM numbered WINDOW w AS (PARTITION BY page ORDER BY line_idx)),
analyzed AS (SELECT page, line_idx, text, x1, y1, x2, y2, n_elements, font_name, font_size, CAST(sum(fresh) OVER (PARTITION BY page ORDER BY line_idx ROWS UNBOUNDED PRECEDING) AS INTEGER) AS region FROM marked)"""


@query(f"{_PAGE_LINES} SELECT * FROM analyzed")
def ref_analyze_pages(spark: SparkSession, d: str) -> DataFrame:
    return layout.analyze_pages(elements(spark, d))


@query(f"{_PAGE_LINES} SELECT page, region, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM analyzed GROUP BY page, region")
def ref_region_bounds(spark: SparkSession, d: str) -> DataFrame:
    return layout.region_bounds(layout.analyze_pages(elements(spark, d)))


# --- key-value pairs ---------------------------------------------------------------------

_KEY = _trim("substr(text, 1, strpos(text, ':') - 1)")
_VALUE = _trim("substr(text, strpos(text, ':') + 1)")
_TAB = f"(len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '')) >= 3 AND len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: regexp_full_match(translate(x, ',.()-', ''), '[0-9]+'))) >= 2)"
_COLON = f"strpos(text, ':') > 0 AND NOT {_TAB} AND {_KEY} <> '' AND {_VALUE} <> ''"


@query(f"WITH {_DOC_LINES} SELECT page, line_idx, {_KEY} AS key, {_VALUE} AS value FROM lines WHERE {_COLON}")
def ref_colon_pairs(spark: SparkSession, d: str) -> DataFrame:
    return kv.colon_pairs(document_lines(spark, d))


# greedily, line by line: a different algorithm from the windows'
_GREEDY = f"""WITH RECURSIVE {_LINES}, flagged AS (SELECT *, {_COLON} AS colon, NOT {_TAB} AND {_trim("text")} <> '' AS usable FROM lines),
edges AS (SELECT page, line_idx, text, colon, usable AND NOT colon AND lead(usable AND NOT colon) OVER w AND font_size > lead(font_size) OVER w AND abs(x_label - lead(x_label) OVER w) <= 50 AS edge, lead(text) OVER w AS below FROM flagged WINDOW w AS (PARTITION BY page ORDER BY line_idx)),
walk AS (
  SELECT page, line_idx, coalesce(edge, false) AS taken FROM edges WHERE line_idx = 0
  UNION ALL
  SELECT e.page, e.line_idx, coalesce(e.edge, false) AND NOT w.taken FROM walk w JOIN edges e ON e.page = w.page AND e.line_idx = w.line_idx + 1)"""


@query(
    f"{_GREEDY} SELECT page, line_idx, {_trim('text')} AS key, {_trim('below')} AS value, CAST(0.7 AS DOUBLE) AS confidence, 2 AS pass FROM edges JOIN walk USING (page, line_idx) WHERE taken UNION ALL SELECT page, line_idx, {_KEY}, {_VALUE}, CAST(0.9 AS DOUBLE), 1 FROM flagged WHERE colon"
)
def ref_extract_pairs(spark: SparkSession, d: str) -> DataFrame:
    return kv.extract_pairs(event_lines(spark, d).withColumnRenamed("x_label", "x1"))


# --- inputs, catalog, registry, items ------------------------------------------------------


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    tails = F.element_at(F.array(F.lit(".xlsx"), F.lit(".zip"), F.lit(".pdf"), F.lit(".txt")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    path = F.concat(F.lit("home/data/"), F.concat(F.lit("T"), F.col("o_custkey") % 97), F.lit("/"), F.year("o_orderdate"), F.lit("/Q"), F.quarter("o_orderdate"), F.lit("/f"), "o_orderkey", tails)
    return table(spark, d, "orders").select(path.alias("path"))


_PATHS = """inputs AS (SELECT 'home/data/T' || (o_custkey % 97) || '/' || year(o_orderdate) || '/Q' || quarter(o_orderdate) || '/f' || o_orderkey || (['.xlsx', '.zip', '.pdf', '.txt'])[o_orderkey % 4 + 1] AS path,
  'T' || (o_custkey % 97) AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year, 'Q' || quarter(o_orderdate) AS period, (['xlsx', 'xbrl', 'pdf', ''])[o_orderkey % 4 + 1] AS format FROM orders)"""


@query(f"WITH {_PATHS} SELECT path, format, ticker, year, period FROM inputs WHERE format <> ''")
def ref_resolve_inputs(spark: SparkSession, d: str) -> DataFrame:
    return filings.resolve_inputs(_inputs(spark, d))


@query(
    f"WITH {_PATHS} SELECT ticker, year, period, path, format FROM (SELECT *, row_number() OVER (PARTITION BY ticker, year, period ORDER BY CASE format WHEN 'xbrl' THEN 3 WHEN 'xlsx' THEN 2 ELSE 1 END DESC, path) AS k FROM inputs WHERE format <> '') WHERE k = 1"
)
def ref_best_format(spark: SparkSession, d: str) -> DataFrame:
    return filings.best_format(filings.resolve_inputs(_inputs(spark, d)), ("ticker", "year", "period"))


@query("SELECT attachment_id, file_name, file_type FROM catalog WHERE lower(file_type) = '.pdf'")
def ref_filter_type(spark: SparkSession, d: str) -> DataFrame:
    return filings.filter_type(table(spark, d, "catalog"), ".PDF").select("attachment_id", "file_name", "file_type")


def _registry(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "registry_snapshots")
    last = r.groupBy("ticker").agg(F.max(F.struct("snapshot_no", "loaded_at", F.to_json("presentations").alias("j"), "presentations")).alias("r"))
    return last.select("ticker", "r.presentations")


@query(
    "WITH last AS (SELECT ticker, presentations FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY snapshot_no DESC, loaded_at DESC) AS k FROM registry_snapshots) WHERE k = 1), wanted AS (SELECT DISTINCT ticker FROM line_items WHERE ticker IS NOT NULL) "
    "SELECT ticker, CAST(i - 1 AS INTEGER) AS pos, p[i].url AS url, p[i].title AS title, p[i].period AS period, p[i].year AS year FROM (SELECT ticker, presentations AS p FROM last JOIN wanted USING (ticker) WHERE presentations IS NOT NULL), unnest(range(1, len(p) + 1)) AS u(i) WHERE lower(p[i].period) = 'audit'"
)
def ref_registry_lookup(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "line_items").where(F.col("ticker").isNotNull()).select("ticker").distinct()
    return filings.registry_lookup(wanted, _registry(spark, d), period="AUDIT").select("ticker", "pos", "url", "title", "period", "year")


@query(
    "WITH c AS (SELECT DISTINCT attachment_id, upper(trim(emiten_code)) AS ticker, coalesce(file_name, '?') AS name, file_size FROM catalog WHERE emiten_code IS NOT NULL) "
    "SELECT ticker, coalesce(string_agg(name, '|' ORDER BY attachment_id, name) FILTER (WHERE coalesce(file_size, 0) % 3 > 0), '') AS downloaded, coalesce(string_agg(name, '|' ORDER BY attachment_id, name) FILTER (WHERE coalesce(file_size, 0) % 3 = 0), '') AS failed FROM c GROUP BY ticker"
)
def ref_fetch_summary(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "catalog").where(F.col("emiten_code").isNotNull()).select("attachment_id", F.upper(F.trim("emiten_code")).alias("ticker"), F.coalesce("file_name", F.lit("?")).alias("name"), "file_size").distinct()
    downloads = c.select("ticker", F.col("attachment_id").alias("pos"), "name", F.when(F.coalesce("file_size", F.lit(0)) % 3 == 0, F.lit("failed")).alias("error"))
    s = filings.fetch_summary(downloads, ("ticker",))
    return s.select("ticker", F.array_join("downloaded", "|").alias("downloaded"), F.array_join("failed", "|").alias("failed"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("file").orderBy("o_orderkey")
    rows = table(spark, d, "orders").withColumn("file", F.floor(F.col("o_orderkey") / 512)).withColumn("row_idx", F.row_number().over(w) - 1)  # files of some hundred rows, more of them at a larger scale
    text = [F.col("o_orderpriority"), F.col("o_totalprice").cast("string"), F.lit("1,000"), F.col("o_orderkey").cast("string"), F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" "))]
    head = ["Account", "2024", "2023", " 2022 ", "2024"]
    cell = F.posexplode(F.array(*[F.when(F.col("row_idx") == 0, F.lit(h)).otherwise(t) for h, t in zip(head, text, strict=True)])).alias("col_idx", "text")
    return rows.select("file", F.lit(0).alias("sheet_idx"), "row_idx", cell)


@query(
    "WITH r AS (SELECT *, CAST(o_orderkey // 512 AS BIGINT) AS file, CAST(row_number() OVER (PARTITION BY o_orderkey // 512 ORDER BY o_orderkey) - 1 AS INTEGER) AS row_idx FROM orders), "
    "cells AS (SELECT file, row_idx, '2024' AS header, CAST(o_custkey AS DOUBLE) AS value FROM r UNION ALL SELECT file, row_idx, '2022', CAST(o_orderkey AS DOUBLE) FROM r) "
    "SELECT cells.file, cells.row_idx, o_orderpriority AS label, header, value FROM cells JOIN r USING (file, row_idx) WHERE cells.row_idx > 0"
)
def ref_items_from_cells(spark: SparkSession, d: str) -> DataFrame:
    return filings.items_from_cells(_cells(spark, d)).select("file", "row_idx", "label", F.explode("values").alias("header", "value"))


@query("SELECT DISTINCT item_id, label FROM line_items WHERE lower(label) LIKE '%total%'")
def ref_items_by_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "line_items").where(F.lower("label").contains("total")).select("item_id", "label").distinct()


@query("SELECT ticker, year, period, count(DISTINCT item_id) AS n_items FROM line_items GROUP BY ticker, year, period")
def ref_count_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "line_items").groupBy("ticker", "year", "period").agg(F.count_distinct("item_id").alias("n_items"))


@query("SELECT DISTINCT item_id, label, item_values['2023'] AS value FROM line_items")
def ref_value_at_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "line_items").select("item_id", "label", F.try_element_at("item_values", F.lit("2023")).alias("value")).distinct()


@query("SELECT filing_id, count(DISTINCT fact_id) AS n_facts FROM facts GROUP BY filing_id")
def ref_count_facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "facts").groupBy("filing_id").agg(F.count_distinct("fact_id").alias("n_facts"))


@query("SELECT DISTINCT attachment_id, file_name, regexp_matches(coalesce(file_name, ''), '[./]') AS is_path FROM catalog")
def ref_input_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "catalog").select("attachment_id", "file_name", exprs.is_path(F.coalesce("file_name", F.lit(""))).alias("is_path")).distinct()


@query(
    "WITH a AS (SELECT DISTINCT attachment_id, k AS attempt, [200, 429, 500, 404, 503, 504, 502][1 + (attachment_id * (k + 2)) % 7] AS status FROM catalog, range(5) AS t(k)), "
    "l AS (SELECT * FROM a WHERE attempt < 3), e AS (SELECT attachment_id, coalesce(min(attempt) FILTER (WHERE status NOT IN (429, 500, 502, 503, 504)), 2) AS stop FROM l GROUP BY attachment_id) "
    "SELECT e.attachment_id, l.status, CAST(stop + 1 AS INTEGER) AS attempts, CAST([0, 1, 3][CAST(stop AS INTEGER) + 1] AS DOUBLE) AS waited FROM e JOIN l ON l.attachment_id = e.attachment_id AND l.attempt = e.stop"
)
def ref_retries(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "catalog").select("attachment_id").distinct()
    answers = ids.select("attachment_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("attempt"))
    status = F.element_at(F.array(*map(F.lit, (200, 429, 500, 404, 503, 504, 502))), ((F.col("attachment_id") * (F.col("attempt") + 2)) % 7 + 1).cast("int"))
    return filings.retry_outcomes(answers.withColumn("status", status), ("attachment_id",))


@query("SELECT DISTINCT t.ticker, c.attachment_id, c.file_name FROM (SELECT DISTINCT ticker FROM registry_snapshots WHERE ticker IS NOT NULL) t JOIN catalog c ON upper(trim(c.emiten_code)) = t.ticker")
def ref_ticker_attachments(spark: SparkSession, d: str) -> DataFrame:
    tickers = table(spark, d, "registry_snapshots").where("ticker is not null").select("ticker").distinct()
    return filings.attachments_of(tickers, table(spark, d, "catalog")).select("ticker", "attachment_id", "file_name").distinct()


@query(
    "WITH a AS (SELECT DISTINCT attachment_id, emiten_code, file_name, file_type, file_size, report_period, report_year FROM catalog WHERE lower(file_type) = '.xlsx'), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY emiten_code ORDER BY attachment_id) AS k FROM a) "
    'SELECT emiten_code AS "TICKER", file_name AS "FILENAME", file_type AS "TYPE", file_size AS "SIZE", report_period AS "PERIOD", report_year AS "YEAR" FROM n WHERE k <= 5'
)
def ref_catalog_listing(spark: SparkSession, d: str) -> DataFrame:
    """The first attachments of each company, in the portal's order, of a type."""
    rows = table(spark, d, "catalog").select("attachment_id", F.col("emiten_code").alias("Emiten_Code"), F.col("file_name").alias("File_Name"), F.col("file_type").alias("File_Type"), F.col("file_size").alias("File_Size"), F.col("report_period").alias("Report_Period"), F.col("report_year").alias("Report_Year")).distinct()
    return filings.listing(rows.withColumn("pos", F.col("attachment_id")), ".xlsx", 5)

"""SQL for p1, p2, p4 and p5, written independently of the operators."""

from __future__ import annotations

_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _t(x: str) -> str:
    return f"coalesce(regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g'), '')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


_P2 = f"""WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, ticker ORDER BY loaded_at DESC) AS k FROM registry_snapshots) WHERE k = 1),
steps AS (SELECT n, lag(n) OVER (ORDER BY n) AS b FROM (SELECT DISTINCT snapshot_no AS n FROM registry_snapshots)),
company AS (SELECT snapshot_no AS n, ticker, {_t("name")} AS name, {_t("ir_page")} AS ir FROM latest),
kids AS (SELECT DISTINCT snapshot_no AS n, ticker, {_t("p.url")} AS url, {_t("p.title")} AS title, {_t("p.period")} AS period, p.year AS year FROM (SELECT snapshot_no, ticker, unnest(presentations) AS p FROM latest)),
kid AS (SELECT n, ticker, url, list_sort(list(title || chr(31) || period || chr(31) || coalesce(CAST(year AS VARCHAR), ''))) AS c FROM kids WHERE url <> '' GROUP BY n, ticker, url),
common AS (SELECT s.n, s.b, a.ticker FROM steps s JOIN company a ON a.n = s.n JOIN company o ON o.n = s.b AND o.ticker = a.ticker)
SELECT s.n AS snapshot_no, a.ticker, '' AS url, 'added' AS change FROM steps s JOIN company a ON a.n = s.n LEFT JOIN company o ON o.n = s.b AND o.ticker = a.ticker WHERE s.b IS NOT NULL AND o.ticker IS NULL
UNION ALL SELECT s.n, o.ticker, '', 'removed' FROM steps s JOIN company o ON o.n = s.b LEFT JOIN company a ON a.n = s.n AND o.ticker = a.ticker WHERE a.ticker IS NULL
UNION ALL SELECT s.n, a.ticker, '', 'changed' FROM steps s JOIN company a ON a.n = s.n JOIN company o ON o.n = s.b AND o.ticker = a.ticker WHERE a.name <> o.name OR a.ir <> o.ir
UNION ALL SELECT x.n, x.ticker, k.url, 'added' FROM common x JOIN kid k ON k.n = x.n AND k.ticker = x.ticker LEFT JOIN kid o ON o.n = x.b AND o.ticker = x.ticker AND o.url = k.url WHERE o.url IS NULL
UNION ALL SELECT x.n, x.ticker, o.url, 'removed' FROM common x JOIN kid o ON o.n = x.b AND o.ticker = x.ticker LEFT JOIN kid k ON k.n = x.n AND k.ticker = x.ticker AND o.url = k.url WHERE k.url IS NULL
UNION ALL SELECT x.n, x.ticker, k.url, 'changed' FROM common x JOIN kid k ON k.n = x.n AND k.ticker = x.ticker JOIN kid o ON o.n = x.b AND o.ticker = x.ticker AND o.url = k.url WHERE o.c <> k.c"""

_RAW = _squeeze("raw_text")
_MONTHS = "map {'jan':1,'feb':2,'mar':3,'apr':4,'may':5,'mei':5,'jun':6,'jul':7,'aug':8,'agu':8,'sep':9,'oct':10,'okt':10,'nov':11,'dec':12,'des':12}"
_P4 = f"""WITH r AS (SELECT ticker, period, c.concept, c.data_type AS t, {_RAW} AS x FROM cover_facts f JOIN concepts c
  ON lower(regexp_replace(regexp_replace(f.concept, '^{_WS}+|{_WS}+$', '', 'g'), '^[A-Za-z][A-Za-z0-9-]*[:_]', '')) = lower(c.concept) WHERE trim(coalesce(ticker, '')) <> ''),
d AS (SELECT *, CASE
    WHEN regexp_full_match(x, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN TRY_CAST(x AS DATE)
    WHEN regexp_full_match(x, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN TRY_CAST(try_strptime(x, '%d/%m/%Y') AS DATE)
    WHEN regexp_full_match(x, '\\d{{8}}') THEN TRY_CAST(try_strptime(x, '%Y%m%d') AS DATE)
    WHEN regexp_full_match(x, '\\d{{1,2}}[- ][A-Za-z]+[- ](\\d{{4}}|\\d{{2}})') THEN TRY_CAST(try_strptime(regexp_extract(x, '^(\\d+)', 1) || '/' || {_MONTHS}[lower(substr(regexp_extract(x, '([A-Za-z]+)', 1), 1, 3))] || '/' ||
         CASE WHEN regexp_matches(x, '\\d{{4}}$') THEN right(x, 4) WHEN right(x, 2) >= '70' THEN '19' || right(x, 2) ELSE '20' || right(x, 2) END, '%d/%m/%Y') AS DATE)
    WHEN regexp_full_match(x, '[A-Za-z]+ \\d{{1,2}},? \\d{{4}}') THEN TRY_CAST(try_strptime(regexp_extract(x, ' (\\d{{1,2}})', 1) || '/' || {_MONTHS}[lower(substr(x, 1, 3))] || '/' || right(x, 4), '%d/%m/%Y') AS DATE) END AS day FROM r),
v AS (SELECT ticker, period, concept, CASE t
    WHEN 'string' THEN nullif(x, '')
    WHEN 'date' THEN CAST(day AS VARCHAR)
    WHEN 'boolean' THEN CASE WHEN lower(x) IN ('true', 'yes', 'y', 'ya', '1') THEN 'true' WHEN lower(x) IN ('false', 'no', 'n', 'tidak', '0') THEN 'false' END
    WHEN 'integer' THEN CASE WHEN regexp_full_match(x, '[+-]?\\d[\\d., ]*') THEN CAST(TRY_CAST(regexp_replace(x, '[., ]', '', 'g') AS BIGINT) AS VARCHAR) END
    WHEN 'double' THEN CASE WHEN regexp_full_match(x, '[+-]?(\\d+([.,]\\d*)?|[.,]\\d+)([eE][+-]?\\d+)?') THEN CAST(TRY_CAST(replace(x, ',', '.') AS DOUBLE) + 0.0 AS VARCHAR) END END AS v FROM d)
SELECT ticker, period, concept FROM v GROUP BY ticker, period, concept HAVING count(DISTINCT v) > 1"""

# a list stands for itself, a single object for a list of one
_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN {0} WHEN 'OBJECT' THEN json_array({0}) ELSE CAST('[]' AS JSON) END"
_RESULTS, _ATTACHMENTS = _LIST.format("json_extract(b, '$.Results')"), _LIST.format("json_extract(r, '$.Attachments')")
_SHEETS, _ITEMS = _LIST.format("json_extract(b, '$.sheets')"), _LIST.format("json_extract(s, '$.items')")


def _unwrapped(x: str) -> str:
    """The JSON in a text, out of one wrapping as a string; null when it isn't complete."""
    text = f"ltrim({x}, chr(65279))"
    inner = f"ltrim(json_extract_string({text}, '$'), chr(65279))"
    return f"CASE WHEN NOT coalesce(json_valid({text}), false) THEN NULL WHEN json_type({text}) <> 'VARCHAR' THEN CAST({text} AS JSON) WHEN json_valid({inner}) THEN CAST({inner} AS JSON) END"


_P5 = f"""WITH a AS (SELECT DISTINCT response_id AS k, {_unwrapped("body")} AS b FROM report_responses),
r AS (SELECT k, {_RESULTS} AS l FROM a WHERE json_type(b) = 'OBJECT'),
x AS (SELECT k, CAST(i AS INTEGER) AS o, json_extract(l, '$[' || i || ']') AS r FROM (SELECT k, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS i FROM r)),
y AS (SELECT k, o, {_ATTACHMENTS} AS l FROM x WHERE json_type(r) = 'OBJECT'),
f AS (SELECT DISTINCT file_id AS k, CAST(body AS JSON) AS b FROM statement_files WHERE json_valid(body)),
g AS (SELECT k, {_SHEETS} AS l FROM f),
h AS (SELECT k, CAST(i AS INTEGER) AS o, json_extract(l, '$[' || i || ']') AS s FROM (SELECT k, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS i FROM g)),
z AS (SELECT k, o, {_ITEMS} AS l FROM h WHERE json_type(s) = 'OBJECT'),
u AS (SELECT 'response' AS src, k, o, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS j FROM y UNION ALL SELECT 'statement', k, o, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) FROM z)
SELECT DISTINCT src, k AS parent_id, o AS outer_no, CAST(j AS INTEGER) AS inner_no FROM u WHERE json_type(json_extract(l, '$[' || j || ']')) = 'OBJECT'"""

_P5_BODY = _P5[: _P5.index("u AS (SELECT")]
_ATTACHMENT = f"""{_P5_BODY}u AS (SELECT k, o, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS j FROM y),
e AS (SELECT DISTINCT k AS parent_id, o AS outer_no, CAST(j AS INTEGER) AS inner_no, json_extract(l, '$[' || j || ']') AS x FROM u) """
_ITEM = f"""{_P5_BODY}u AS (SELECT k, o, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS j FROM z),
e AS (SELECT DISTINCT k AS parent_id, o AS outer_no, CAST(j AS INTEGER) AS inner_no, json_extract(l, '$[' || j || ']') AS x FROM u) """
_TEXTS = ("File_Name", "File_Path", "File_Type", "Emiten_Code", "Report_Period", "Report_Year")


def _text(m: str) -> str:
    return f"json_extract_string(x, '$.{m}') AS \"{m}\""


_P5_ATTACHMENTS = f"{_ATTACHMENT}SELECT parent_id, outer_no, inner_no, {', '.join(map(_text, (*_TEXTS, 'File_Size')))} FROM e WHERE json_type(x) = 'OBJECT'"
_P5_ITEMS = f"{_ITEM}SELECT parent_id, outer_no, inner_no, json_extract_string(x, '$.label') AS label FROM e WHERE json_type(x) = 'OBJECT'"
_P5_SHEETS = f"""{_P5_BODY}e AS (SELECT DISTINCT k AS parent_id, o AS outer_no, s AS x FROM h)
SELECT parent_id, outer_no, {_text("name")}, {_text("currency")}, CAST(json_extract(x, '$.hidden') AS BOOLEAN) AS hidden FROM e WHERE json_type(x) = 'OBJECT'"""
_P5_RESULTS = f"""{_P5_BODY}e AS (SELECT DISTINCT k AS parent_id, o AS outer_no, r AS x FROM x)
SELECT parent_id, outer_no, json_extract_string(x, '$.Emiten.Code') AS emiten, array_to_string(CAST(json_extract(x, '$.Emiten.Boards') AS VARCHAR[]), '|') AS boards FROM e WHERE json_type(x) = 'OBJECT'"""
# the supertype's members in its types, null or absent, and no others but null or empty ones
_P5_VARIANT_ATTACHMENTS = f"""{_ATTACHMENT}, m AS (SELECT *, CAST(json_keys(x) AS VARCHAR[]) AS keys FROM e WHERE json_type(x) = 'OBJECT'),
c AS (SELECT parent_id, outer_no, inner_no, unnest(keys) AS key, x FROM m),
away AS (SELECT DISTINCT parent_id, outer_no, inner_no FROM (SELECT *, json_type(json_extract(x, '$.' || key)) AS t, json_extract(x, '$.' || key) AS v FROM c)
  WHERE t <> 'NULL' AND NOT coalesce(CASE WHEN key IN {_TEXTS} THEN t = 'VARCHAR' WHEN key = 'File_Size' THEN t IN ('BIGINT', 'UBIGINT', 'DOUBLE') ELSE CAST(v AS VARCHAR) IN ('[]', '{{}}') END, false))
SELECT parent_id, outer_no, inner_no, {', '.join(map(_text, _TEXTS))}, CAST(json_extract(x, '$.File_Size') AS DOUBLE) AS "File_Size" FROM m ANTI JOIN away USING (parent_id, outer_no, inner_no)"""
_VALUES = f"""{_ITEM}, v AS (SELECT parent_id, outer_no, inner_no, x, json_extract(x, '$.values') AS h FROM e WHERE json_type(x) = 'OBJECT'),
n AS (SELECT *, unnest(json_keys(h)) AS name FROM v WHERE json_type(h) = 'OBJECT'),
w AS (SELECT parent_id, outer_no, inner_no, x, name, json_extract(h, '/' || replace(replace(name, '~', '~0'), '/', '~1')) AS y FROM n) """
_P5_VALUES = f"""{_VALUES}SELECT parent_id, outer_no, inner_no, name, CASE json_type(y) WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool' WHEN 'VARCHAR' THEN 'str' ELSE 'num' END AS type,
  CASE WHEN json_type(y) <> 'NULL' THEN json_extract_string(y, '$') END AS text, CASE WHEN json_type(y) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(y AS DOUBLE) END AS number, CASE WHEN json_type(y) = 'BOOLEAN' THEN CAST(y AS BOOLEAN) END AS flag FROM w"""
_P5_VARIANT_ITEMS = f"""{_VALUES}, k AS (SELECT parent_id, outer_no, inner_no, unnest(json_keys(x)) AS key, x FROM v),
away AS (SELECT parent_id, outer_no, inner_no FROM w WHERE json_type(y) NOT IN ('NULL', 'BIGINT', 'UBIGINT', 'DOUBLE')
  UNION SELECT parent_id, outer_no, inner_no FROM k WHERE json_type(json_extract(x, '$.' || key)) <> CASE key WHEN 'label' THEN 'VARCHAR' WHEN 'values' THEN 'OBJECT' ELSE '' END AND json_type(json_extract(x, '$.' || key)) <> 'NULL' AND CAST(json_extract(x, '$.' || key) AS VARCHAR) NOT IN (CASE WHEN key IN ('label', 'values') THEN '' ELSE '[]' END, CASE WHEN key IN ('label', 'values') THEN '' ELSE '{{}}' END))
SELECT parent_id, outer_no, inner_no, json_extract_string(x, '$.label') AS label, name, CAST(y AS DOUBLE) AS number FROM w ANTI JOIN away USING (parent_id, outer_no, inner_no) WHERE json_type(y) <> 'NULL'"""
_P5_UNREADABLE = f"""WITH b AS (SELECT 'response' AS src, response_id AS parent_id, body FROM report_responses UNION SELECT 'statement', file_id, body FROM statement_files),
u AS (SELECT src, parent_id, body, {_unwrapped("body")} AS v FROM b)
SELECT DISTINCT src, parent_id, CASE WHEN body IS NULL THEN 'null' WHEN trim(body, chr(65279) || chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN 'empty' WHEN v IS NULL THEN 'no complete JSON' ELSE 'no object' END AS reason FROM u WHERE v IS NULL OR json_type(v) <> 'OBJECT'"""
_P1_UNREADABLE = "SELECT file_id, max(CASE WHEN feed_id IS NULL THEN 'no feed' ELSE 'no statement' END) AS reason FROM statement_files GROUP BY file_id HAVING count(CASE WHEN feed_id IS NOT NULL AND coalesce(json_valid(ltrim(body, chr(65279))), false) AND json_type(ltrim(body, chr(65279))) = 'OBJECT' THEN 1 END) = 0"
_P4_CELLS = _P4[: _P4.index("v AS (SELECT")].replace("WITH r AS (SELECT ticker, period,", "WITH r AS (SELECT ticker, period, loaded_at, cover_id,") + _P4[_P4.index("v AS (SELECT") : _P4.rindex("SELECT ticker")].replace("v AS (SELECT ticker, period,", "v AS (SELECT ticker, period, loaded_at, cover_id,", 1).replace("+ 0.0 AS VARCHAR) END END AS v", "+ 0.0 AS VARCHAR) END END AS v, t") + "SELECT ticker, period, concept, CASE WHEN t <> 'double' THEN v END AS value, CASE WHEN t = 'double' THEN CAST(v AS DOUBLE) END AS number FROM v WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, period, concept ORDER BY loaded_at DESC, cover_id DESC, v DESC) = 1"

_P1 = f"""WITH f0 AS (SELECT DISTINCT file_id AS k, feed_id, delivered_at, CAST(ltrim(body, chr(65279)) AS JSON) AS b FROM statement_files WHERE feed_id IS NOT NULL AND coalesce(json_valid(ltrim(body, chr(65279))), false)),
f AS (SELECT k, lag(k) OVER (PARTITION BY feed_id ORDER BY delivered_at, k) AS p, b FROM f0 WHERE json_type(b) = 'OBJECT'),
g AS (SELECT k, {_SHEETS} AS l FROM f),
h AS (SELECT k, i AS pos, json_extract(l, '$[' || i || ']') AS s FROM (SELECT k, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS i FROM g)),
n AS (SELECT k, pos, CASE json_type(json_extract(s, '$.name')) WHEN 'VARCHAR' THEN json_extract_string(s, '$.name') ELSE '' END AS sheet, s FROM h WHERE json_type(s) = 'OBJECT'),
sh AS (SELECT k, sheet, min(pos) AS pos FROM n GROUP BY k, sheet),
z AS (SELECT k, pos, sheet, {_ITEMS} AS l FROM n),
i AS (SELECT k, pos, sheet, j, json_extract(l, '$[' || j || ']') AS x FROM (SELECT *, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS j FROM z)),
labels AS (SELECT DISTINCT k, sheet, {_squeeze("lower(json_extract_string(x, '$.label'))")} AS label FROM i WHERE json_type(x) = 'OBJECT' AND json_type(json_extract(x, '$.label')) = 'VARCHAR'),
named AS (SELECT * FROM labels WHERE label <> ''),
cells AS (SELECT k, sheet, pos, j, c, keys[c] AS field, json_type(json_extract(v, '/' || replace(replace(keys[c], '~', '~0'), '/', '~1'))) AS t FROM (SELECT *, unnest(range(1, len(keys) + 1)) AS c FROM
  (SELECT k, sheet, pos, j, json_extract(x, '$.values') AS v, json_keys(json_extract(x, '$.values')) AS keys FROM i WHERE json_type(x) = 'OBJECT' AND json_type(json_extract(x, '$.values')) = 'OBJECT'))),
counted AS (SELECT k, sheet, field, min((pos * 1000000 + j) * 1000000 + c) AS started, count(*) FILTER (WHERE t NOT IN ('NULL', 'BOOLEAN', 'VARCHAR', 'OBJECT', 'ARRAY')) AS num, count(*) FILTER (WHERE t IN ('VARCHAR', 'OBJECT', 'ARRAY')) AS txt, count(*) FILTER (WHERE t = 'BOOLEAN') AS bool FROM cells GROUP BY k, sheet, field),
fields AS (SELECT k, sheet, field, row_number() OVER (PARTITION BY k, sheet ORDER BY started) AS place, CASE WHEN num + txt + bool = 0 THEN NULL WHEN num >= txt AND num >= bool THEN 'number' WHEN txt >= bool THEN 'string' ELSE 'boolean' END AS t FROM counted),
step AS (SELECT k, p FROM f WHERE p IS NOT NULL),
fresh AS (SELECT step.k, sheet, pos FROM step JOIN sh ON sh.k = step.k), former AS (SELECT step.k, sheet, pos FROM step JOIN sh ON sh.k = step.p),
come AS (SELECT * FROM fresh ANTI JOIN former USING (k, sheet)), gone AS (SELECT * FROM former ANTI JOIN fresh USING (k, sheet)),
sizes AS (SELECT k, sheet, count(*) AS n FROM named GROUP BY k, sheet),
shared AS (SELECT c.k, step.p, c.sheet, g.sheet AS was, count(*) AS m FROM come c JOIN gone g ON g.k = c.k AND g.pos = c.pos JOIN step ON step.k = c.k
  JOIN named a ON a.k = c.k AND a.sheet = c.sheet JOIN named b ON b.k = step.p AND b.sheet = g.sheet AND b.label = a.label GROUP BY c.k, step.p, c.sheet, g.sheet),
alike AS (SELECT s.k, s.sheet, s.was FROM shared s JOIN sizes x ON x.k = s.k AND x.sheet = s.sheet JOIN sizes y ON y.k = s.p AND y.sheet = s.was WHERE 2 * m > greatest(x.n, y.n)),
pairs AS (SELECT k, sheet, sheet AS was FROM fresh SEMI JOIN former USING (k, sheet) UNION ALL SELECT k, sheet, was FROM alike),
nf AS (SELECT pairs.k, pairs.sheet, field, place, t FROM pairs JOIN fields ON fields.k = pairs.k AND fields.sheet = pairs.sheet),
wf AS (SELECT pairs.k, pairs.sheet, field, place, t FROM pairs JOIN step ON step.k = pairs.k JOIN fields ON fields.k = step.p AND fields.sheet = pairs.was),
cf AS (SELECT * FROM nf ANTI JOIN wf USING (k, sheet, field)), gf AS (SELECT * FROM wf ANTI JOIN nf USING (k, sheet, field)),
moved AS (SELECT cf.k, cf.sheet, cf.field, gf.field AS was FROM cf JOIN gf ON gf.k = cf.k AND gf.sheet = cf.sheet AND gf.place = cf.place AND (gf.t = cf.t OR gf.t IS NULL OR cf.t IS NULL))
SELECT k AS file_id, sheet AS sheet_name, '' AS field, 'renamed' AS change FROM alike
UNION ALL SELECT k, sheet, '', 'added' FROM come ANTI JOIN alike USING (k, sheet)
UNION ALL SELECT k, sheet, '', 'removed' FROM gone WHERE NOT EXISTS (SELECT 1 FROM alike WHERE alike.k = gone.k AND alike.was = gone.sheet)
UNION ALL SELECT nf.k, nf.sheet, nf.field, 'retyped' FROM nf JOIN wf USING (k, sheet, field) WHERE nf.t <> wf.t
UNION ALL SELECT k, sheet, field, 'renamed' FROM moved
UNION ALL SELECT k, sheet, field, 'added' FROM cf ANTI JOIN moved USING (k, sheet, field)
UNION ALL SELECT k, sheet, field, 'removed' FROM gf WHERE NOT EXISTS (SELECT 1 FROM moved WHERE moved.k = gf.k AND moved.sheet = gf.sheet AND moved.was = gf.field)"""

SQL: dict[str, str] = {
    "p1_found": _P1, "p1_unreadable": _P1_UNREADABLE, "p2_found": _P2, "p4_found": _P4, "p4_cells": _P4_CELLS, "p5_found": _P5, "p5_attachments": _P5_ATTACHMENTS, "p5_items": _P5_ITEMS, "p5_sheets": _P5_SHEETS, "p5_results": _P5_RESULTS,
    "p5_values": _P5_VALUES, "p5_variant_attachments": _P5_VARIANT_ATTACHMENTS, "p5_variant_items": _P5_VARIANT_ITEMS, "p5_unreadable": _P5_UNREADABLE,
}

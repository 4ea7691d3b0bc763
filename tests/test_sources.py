from __future__ import annotations

import io
import json
import os
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import filings, layout
from ledgerloom.sources import catalog, files, pdf, sink, xbrl, xlsx
from ledgerloom.streaming import ingest

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
IX = 'xmlns:ix="http://www.xbrl.org/2013/inlineXBRL" xmlns:ifrs="http://xbrl.ifrs.org/taxonomy/2023"'


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def workbook(sheets: dict[str, list[list[object]]], styles: str = "") -> bytes:
    shared: list[str] = []
    parts = {}
    for n, rows in enumerate(sheets.values(), 1):
        xml = ""
        for i, row in enumerate(rows, 1):
            cells = ""
            for j, v in enumerate(row):
                ref = f'r="{chr(65 + j)}{i}"'
                if isinstance(v, str):
                    shared.append(v)
                    cells += f'<c {ref} t="s"><v>{len(shared) - 1}</v></c>'
                elif isinstance(v, tuple):
                    cells += f'<c {ref} s="{v[1]}"><v>{v[0]}</v></c>'
                elif v is not None:
                    cells += f"<c {ref}><v>{v}</v></c>"
            xml += f'<row r="{i}">{cells}</row>'
        parts[f"xl/worksheets/sheet{n}.xml"] = f"<worksheet {MAIN}><sheetData>{xml}</sheetData></worksheet>"
    names = "".join(f'<sheet name="{s}" sheetId="{i}"/>' for i, s in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f"<workbook {MAIN}><sheets>{names}</sheets></workbook>"
    parts["xl/sharedStrings.xml"] = f"<sst {MAIN}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>"
    if styles:
        parts["xl/styles.xml"] = styles
    return zipped(parts)


STATEMENT = {"Balance Sheet": [["Account", "2024", "2023"], ["Total Assets", 1000000, 900000], ["Total Liabilities", 600000, 550000], ["Total Equity", 400000, 350000]], "Empty": []}


def test_workbook_cells():
    cells = list(xlsx.read_cells(workbook(STATEMENT)))
    assert cells[4] == (0, "Balance Sheet", 1, 1, "1000000") and len(cells) == 12
    with pytest.raises(ValueError):
        list(xlsx.read_cells(b"no zip"))
    assert list(xlsx.read_cells(workbook({}))) == []


def test_number_formats():
    styles = f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="3"/><xf numFmtId="10"/><xf numFmtId="170"/></cellXfs></styleSheet>'
    got = [c[4] for c in xlsx.read_cells(workbook({"S": [[(1234567.5, 1), (0.256, 2), (45292, 3), (0.1, 0), ("1E+2", 0)]]}, styles))]
    assert got == ["1,234,568", "25.60%", "2024-01-01", "0.1", "100"]


def test_items_from_a_workbook(spark, tmp_path):
    sheet = [["Account", "2024", " 2023 ", "2024", ""], ["A", 1, 2, 3, 4], ["B", "1,000", "x", None, 5], ["", 1, 2, 3, 4], ["C", 7]]
    (tmp_path / "FinancialStatement-2024-Q3-BBCA.xlsx").write_bytes(workbook({"S": sheet, "One": [["Account", "2024"]]}))
    (tmp_path / "bad.xlsx").write_bytes(b"junk")
    cells = files.scan(spark, str(tmp_path), "xlsx")
    assert cells.where("error is not null").count() == 1
    items = filings.items_from_cells(cells.where("error is null"), ("path", "sheet_idx"))
    got = {r["label"]: r["values"] for r in items.collect()}
    assert got == {"A": {"2024": 3.0, "2023": 2.0}, "B": {}, "C": {"2024": 7.0}}
    meta = files.with_meta(cells.where("error is null")).select("meta_ticker", "meta_year", "meta_period").distinct().collect()
    assert [tuple(r) for r in meta] == [("BBCA", 2024, "Q3")]


INLINE = f"""<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml" {IX}><body><p>Text<br><ix:nonFraction name="ifrs-full:Revenue" unitRef="IDR" contextRef="FY2024" decimals="-6">1,500,000</ix:nonFraction>
<ix:nonFraction name="ifrs-full:CostOfSales" unitRef="IDR" contextRef="FY2024" decimals="-6">800000</ix:nonFraction><ix:nonNumeric name="ifrs-full:NameOfEntity" contextRef="FY2024">PT Example &amp; Tbk<b>deep</b></ix:nonNumeric><ix:header/></body></html>"""
INSTANCE = '<xbrl xmlns:ifrs="http://xbrl.ifrs.org/taxonomy/2023"><ifrs:Revenue contextRef="FY2024" unitRef="IDR" decimals="-6">2500000</ifrs:Revenue><ifrs:Assets contextRef="FY2024" unitRef="IDR" decimals="-6">9000000</ifrs:Assets><other:X xmlns:other="http://x">1</other:X></xbrl>'


def test_facts():
    got = [f for _, f, _ in xbrl.read_facts(zipped({"report.htm": INLINE, "readme.txt": "x"}))]
    assert [(f["concept"], f["value"], f["unit"], f["period"], f["decimals"]) for f in got] == [("ifrs-full:Revenue", 1500000.0, "IDR", "FY2024", "-6"), ("ifrs-full:CostOfSales", 800000.0, "IDR", "FY2024", "-6"), ("ifrs-full:NameOfEntity", 0.0, "", "FY2024", "")]
    assert got[2]["raw_text"] == "PT Example & Tbk" and not got[2]["is_numeric"]
    got = [f for _, f, _ in xbrl.read_facts(zipped({"report.xbrl": INSTANCE}))]
    assert [(f["concept"], f["value"]) for f in got] == [("Revenue", 2500000.0), ("Assets", 9000000.0)]
    for bad in (zipped({}), zipped({"readme.txt": "x"}), b"junk"):
        with pytest.raises(ValueError):
            list(xbrl.read_facts(bad))


def test_nested_and_broken_entries():
    nested = f'<html {IX}><ix:nonFraction name="a">1<ix:nonFraction name="b">2</ix:nonFraction></ix:nonFraction><ifrs-full:Y>3</ifrs-full:Y></html>'
    got = [(e, f and f["concept"], bool(err)) for e, f, err in xbrl.read_facts(zipped({"1.xml": '<?xml version="1.0" encoding="iso-8859-1"?><x/>', "2.html": nested}))]
    assert got == [("1.xml", None, True), ("2.html", "a", False), ("2.html", "Y", False)]


def make_pdf(pages: list[bytes], compress: bool = False, form: bytes | None = None, info: bool = True) -> bytes:
    objs: list[bytes] = [b"", b""]

    def stream(data: bytes, extra: bytes = b"") -> bytes:
        if compress:
            data, extra = zlib.compress(data), extra + b"/Filter/FlateDecode"
        return b"<<%s/Length %d>>stream\n%s\nendstream" % (extra, len(data), data)

    kids = []
    fm = None
    if form is not None:
        objs.append(stream(form, b"/Type/XObject/Subtype/Form"))
        fm = len(objs)
    for content in pages:
        objs.append(stream(content))
        res = b"/Resources<</XObject<</Fm0 %d 0 R>>>>" % fm if fm else b""
        objs.append(b"<</Type/Page/Parent 2 0 R/Contents %d 0 R%s>>" % (len(objs), res))
        kids.append(len(objs))
    objs[0], objs[1] = b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[%s]/Count %d/MediaBox[0 0 595 842]>>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    if info:
        objs.append(b"<</Title(A \\(b\\))/Producer<4869>>>")
    out, at = b"%PDF-1.4\n", []
    for i, o in enumerate(objs, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    xref = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objs) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
    return out + b"trailer\n<</Size %d/Root 1 0 R%s>>\nstartxref\n%d\n%%%%EOF" % (len(objs) + 1, b"/Info %d 0 R" % len(objs) if info else b"", xref)


def block(body: str) -> bytes:
    return f"BT /F1 12 Tf 72 700 Td {body} ET".encode()


@pytest.mark.parametrize("compress", [False, True])
def test_pages_elements_and_meta(compress):
    data = make_pdf([block("(Hello Page 1) Tj"), b""], compress)
    pages = list(pdf.read_pages(data))
    assert [(p, w, h, len(e)) for p, w, h, e in pages] == [(1, 595.0, 842.0, 1), (2, 595.0, 842.0, 0)]
    e = pages[0][3][0]
    assert (e["text"], e["font_name"], e["font_size"], e["x1"], e["y1"], e["x2"]) == ("Hello Page 1", "F1", 12.0, 72.0, 700.0, 72 + 12 * 12 * 0.5)
    assert pdf.read_meta(data) == {"title": "A (b)", "author": "", "creator": "", "producer": "Hi", "pages": 2}
    broken = data.replace(b"startxref", b"startxxxx")
    assert [len(p[3]) for p in pdf.read_pages(broken)] == [1, 0]


def test_form_objects():
    data = make_pdf([b"q /Fm0 Do /Fm0 Do /None Do Q"], form=block("(XObject Text) Tj"))
    assert [e["text"] for _, _, _, es in pdf.read_pages(data) for e in es] == ["XObject Text", "XObject Text"]


@pytest.mark.parametrize(("body", "texts"), [
    ("(Hello) Tj", ["Hello"]), ("[(Hello) -10 (World)] TJ", ["HelloWorld"]), ("[(Kas) -500 (Dana)] TJ", ["Kas Dana"]), ("[(868,) -10 (686,) -10 (210)] TJ", ["868,686,210"]), ("[(a) -300 (b) -301 (c)] TJ", ["ab c"]),
    ("(Line1) Tj T* (Line2) Tj", ["Line1", "Line2"]), ('2 0.5 (Hello) "', ["Hello"]), ("(a\\)b\\n\\x) Tj", ["a)b\nx"]), ("<48 65 6C 6C 6F> Tj <ZZZZ> Tj", ["Hello"]), ("(a(b)c) Tj % (no) Tj\n() Tj", ["a(b)c"]), ("(Hi) 3 Tj", []),
])
def test_content_streams(body, texts):
    assert [e["text"] for e in pdf.run_content(block(body))[0]] == texts


def test_text_positions():
    e = pdf.run_content(block("(A) Tj 0 -14 Td (B) Tj T* (C) Tj 2 0 0 3 10 20 Tm (D) Tj"))[0]
    assert [(x["x1"], x["y1"], x["font_size"]) for x in e] == [(72, 700, 12), (78, 686, 12), (84, 674, 12), (10, 20, 36)]
    assert pdf.run_content(b"BT /F 9 Tf (a) Tj BT (b) Tj ET (c) Tj ET BT (d) Tj")[0][0]["font_size"] == 0.0


def test_no_input_ends_a_reader_badly():
    rng = random.Random(0)
    data = make_pdf([block("(x) Tj")], True)
    for k in range(60):
        b = bytearray(data)
        for _ in range(rng.randint(1, 20)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        for bad in (bytes(b), data[: rng.randrange(len(data))], b"%PDF-1.4\n", b"", b"not a pdf"):
            try:
                list(pdf.read_pages(bad))
            except (ValueError, EOFError, TypeError, KeyError, AttributeError, IndexError):
                pass


def test_data_sources_and_layout(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(make_pdf([block("(Name:) Tj 60 0 Td (PT X) Tj")]))
    (tmp_path / "b.zip").write_bytes(zipped({"r.xbrl": INSTANCE}))
    files.register(spark)
    facts = spark.read.format("ledgerloom_xbrl").load(str(tmp_path / "*.zip"))
    assert facts.count() == 2 and facts.where("error is not null").count() == 0
    rows = spark.read.format("ledgerloom_pdf").load(str(tmp_path / "*.pdf"))
    lines = layout.analyze_pages(rows.drop("error"), ("path", "page")).collect()
    assert [r["text"] for r in lines] == ["Name:\tPT X"]
    assert files.scan(spark, str(tmp_path), "pdf_meta").first()["pages"] == 1


def test_small_files_share_a_partition(tmp_path, monkeypatch):
    for k in range(10):
        (tmp_path / f"{k}.zip").write_bytes(b"x" * 100)
    reader = files._Reader("xbrl", {"path": str(tmp_path)})
    assert [len(p.paths) for p in reader.partitions()] == [10]
    monkeypatch.setattr(files, "PARTITION_BYTES", 250)
    assert [len(p.paths) for p in reader.partitions()] == [2] * 5
    assert sum(len(list(reader.read(p))) for p in reader.partitions()) == 10


def test_fail_fast(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"junk")
    assert files.scan(spark, str(tmp_path), "xbrl").first()["error"]
    with pytest.raises(Exception, match="no archive"):
        files.scan(spark, str(tmp_path), "xbrl", "failfast").collect()


def test_catalog_and_registry(spark):
    body = json.dumps({"Results": [{"Attachments": [{"File_Name": "a.pdf", "File_Size": 1048576, "Emiten_Code": "BBCA"}, {"File_Name": "b.xlsx"}]}, {"Attachments": []}]})
    got = catalog.attachments(spark.createDataFrame([(1, body), (2, "x"), (3, None)], "id int, body string"), keep=("id",)).collect()
    assert [(r["id"], r["attachment_no"], r["File_Name"], r["File_Size"]) for r in got] == [(1, 0, "a.pdf", 1048576), (1, 1, "b.xlsx", None)]
    text = json.dumps({"BBCA": {"name": "B", "ir_page": "x", "presentations": [{"url": "u", "year": 2024, "period": "annual", "title": "t"}]}, "TLKM": {"name": "T", "presentations": []}})
    reg = catalog.registry(spark.createDataFrame([(text,)], "value string"))
    assert [r["url"] for r in filings.presentations(reg, 2024, "ANNUAL").collect()] == ["u"]
    assert filings.presentations(reg, 2023).count() == 0 and reg.count() == 2


def test_result_documents(spark, tmp_path):
    assert sink.document([]) == "" and sink.document(['{"a":1}']) == '{"a":1}\n' and sink.document(['{"a":1}', '{"b":2}']) == '[{"a":1},{"b":2}]\n'
    assert sink.document(['{"a":1}'], pretty=True) == '{\n  "a": 1\n}\n'
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert df.select(sink.result_json(F.col("a"), F.col("b"))).first()[0] == '{"a":1,"b":null}'
    sink.write_results(df, str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).first()[0] == '{"a":1,"b":null}'


def test_stream_of_files(spark, tmp_path):
    src = tmp_path / "in"
    os.makedirs(src)
    (src / "a.zip").write_bytes(zipped({"r.xbrl": INSTANCE}))
    stream = ingest.stream_files(spark, str(src), "xbrl", "*.zip")
    for extra in (None, "b.zip"):
        if extra:
            (src / extra).write_bytes(zipped({"r.xbrl": INSTANCE}))
        ingest.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_best_format(spark):
    df = spark.createDataFrame([("home/data/T/2024/Q1/" + f,) for f in ("a.pdf", "b.zip", "c.zip", "d.txt")] + [("home/data/U/2024/Q1/x.PDF",)], "path string")
    inputs = filings.resolve_inputs(df)
    got = {r["ticker"]: (r["path"][-5:], r["year"]) for r in filings.best_format(inputs, ("ticker", "year", "period")).collect()}
    assert inputs.count() == 4 and got == {"T": ("b.zip", 2024), "U": ("x.PDF", 2024)}

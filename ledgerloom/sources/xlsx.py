"""Spreadsheet workbooks as cells.

``read_cells`` decodes a workbook with the standard library alone (a workbook is a
ZIP of XML parts) and yields one tuple per stored cell. The text of a cell is what
a reader sees for general, fixed-decimal, thousands, percent, text and ISO-like
date formats; other number formats fall back to the general one.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from xml.etree import ElementTree

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_DOC_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
#: Built-in number formats that change how a number reads.
_BUILT_IN = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "mm-dd-yy", 15: "d-mmm-yy", 22: "m/d/yy h:mm", 37: "#,##0", 38: "#,##0", 39: "#,##0.00", 40: "#,##0.00", 49: "@"}


def column_index(ref: str) -> int:
    """0-based column of a cell reference such as ``BC12``."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    """Text of a string item: its own and its runs', without phonetic guides."""
    out = [t.text or "" for t in node.findall(f"{_MAIN}t")]
    for run in node.findall(f"{_MAIN}r"):
        out += [t.text or "" for t in run.findall(f"{_MAIN}t")]
    return "".join(out)


def general(value: str) -> str:
    """A stored number in the general format: no trailing zeros, no exponent below 1e21."""
    try:
        d = Decimal(value)
    except ArithmeticError:
        return value
    if d == d.to_integral() and abs(d) < Decimal(10) ** 21:
        return str(int(d))
    return repr(float(d)) if abs(d) >= Decimal("1e-5") else str(d)


def formatted(value: str, code: str | None, epoch_1904: bool = False) -> str:
    """A stored number under a number format."""
    if not code or code.lower() == "general" or code == "@":
        return general(value)
    section = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.', "", code.split(";")[0])
    if re.search(r"[ymdhs]", section, re.I):
        try:
            day = datetime(1904, 1, 1) if epoch_1904 else datetime(1899, 12, 30)
            at = day + timedelta(seconds=round(float(value) * 86400))
        except (ValueError, OverflowError):
            return value
        return at.strftime("%Y-%m-%d" if at.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")
    m = re.fullmatch(r"\s*([#0,]*)(?:\.([0#]+))?(%)?\s*", section)
    if not m:
        return general(value)
    try:
        d = Decimal(value) * (100 if m[3] else 1)
    except ArithmeticError:
        return value
    places = len(m[2] or "")
    d = d.quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)
    return f"{d:,f}" + (m[3] or "") if "," in m[1] else f"{d:f}" + (m[3] or "")


def read_cells(content: bytes) -> Iterator[tuple[int, str, int, int, str]]:
    """(sheet_idx, sheet_name, row_idx, col_idx, text) of every stored cell, sheets in
    workbook order. Raises ValueError for content that is no workbook."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError(f"no workbook: {e}") from e
    names = set(book.namelist())
    links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(_REL)} if "xl/_rels/workbook.xml.rels" in names else {}
    shared = [_text(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
    codes = _formats(ElementTree.fromstring(book.read("xl/styles.xml"))) if "xl/styles.xml" in names else []
    props = workbook.find(f"{_MAIN}workbookPr")
    epoch = props is not None and props.get("date1904") in ("1", "true")
    for k, sheet in enumerate(workbook.iter(f"{_MAIN}sheet")):
        target = links.get(sheet.get(_DOC_REL) or "", f"worksheets/sheet{k + 1}.xml")
        path = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target))
        if path not in names:
            raise ValueError(f"sheet {sheet.get('name')} has no part {path}")
        try:
            with book.open(path) as part:
                for row, col, text in _sheet(part, shared, codes, epoch):
                    yield k, sheet.get("name", ""), row, col, text
        except ElementTree.ParseError as e:
            raise ValueError(f"sheet {sheet.get('name')}: {e}") from e


def _formats(styles: ElementTree.Element) -> list[str | None]:
    own = {int(f.get("numFmtId", "0")): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
    cells = styles.find(f"{_MAIN}cellXfs")
    ids = [int(x.get("numFmtId", "0")) for x in cells] if cells is not None else []
    return [own.get(i, _BUILT_IN.get(i)) for i in ids]


def _sheet(part, shared: list[str], codes: list[str | None], epoch: bool) -> Iterator[tuple[int, int, str]]:
    row, col = -1, -1
    for event, node in ElementTree.iterparse(part, ("start", "end")):
        if node.tag == f"{_MAIN}row" and event == "start":
            row, col = int(node.get("r", row + 2)) - 1, -1
        elif node.tag == f"{_MAIN}c" and event == "end":
            ref = node.get("r")
            col = column_index(ref) if ref else col + 1
            kind, value = node.get("t", "n"), node.findtext(f"{_MAIN}v")
            if kind == "inlineStr":
                inline = node.find(f"{_MAIN}is")
                text = _text(inline) if inline is not None else ""
            elif value is None:
                continue
            elif kind == "s":
                at = int(value)
                text = shared[at] if 0 <= at < len(shared) else ""
            elif kind == "b":
                text = "TRUE" if value == "1" else "FALSE"
            elif kind in ("str", "e", "d"):
                text = value
            else:
                style = int(node.get("s", "0"))
                text = formatted(value, codes[style] if style < len(codes) else None, epoch)
            yield row, col, text
        elif node.tag == f"{_MAIN}row" and event == "end":
            node.clear()

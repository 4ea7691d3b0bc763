"""Small workbooks, tagged archives and page documents as bytes, for rows of tables.

What is written is what the decoders of this package read back."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
#: Characters that no XML document can hold.
NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def archive(parts: Iterable[tuple[str, str]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for name, text in parts:
            z.writestr(zipfile.ZipInfo(name), text.encode("utf-8", "replace"))
    return out.getvalue()


def xml_text(text: str) -> str:
    return escape(NO_XML.sub("", text), {"\r": "&#13;"})


def _attribute(text: str) -> str:
    return quoteattr(NO_XML.sub("", text), {"\r": "&#13;", "\n": "&#10;", "\t": "&#9;"})


def _column(k: int) -> str:
    name, k = "", k + 1
    while k:
        k, r = divmod(k - 1, 26)
        name = chr(65 + r) + name
    return name


def workbook(sheets: list[tuple[str, dict[int, list[object]]]]) -> bytes:
    """Sheets of (name, cells by row): texts as shared or inline strings in turn, numbers
    and booleans as such, None as no cell."""
    shared: dict[str, int] = {}
    parts = []
    for n, (_, rows) in enumerate(sheets, 1):
        xml = []
        for i, row in rows.items():
            xml.append(f'<row r="{i + 1}">')
            for j, v in enumerate(row):
                at = f'r="{_column(j)}{i + 1}"'
                if isinstance(v, bool):
                    xml.append(f'<c {at} t="b"><v>{int(v)}</v></c>')
                elif isinstance(v, int | float):
                    xml.append(f"<c {at}><v>{v!r}</v></c>")
                elif isinstance(v, str) and (i + j) % 2:
                    xml.append(f'<c {at} t="inlineStr"><is><t xml:space="preserve">{xml_text(v)}</t></is></c>')
                elif isinstance(v, str):
                    xml.append(f'<c {at} t="s"><v>{shared.setdefault(v, len(shared))}</v></c>')
            xml.append("</row>")
        parts.append((f"xl/worksheets/sheet{n}.xml", f"<worksheet {_MAIN}><sheetData>{''.join(xml)}</sheetData></worksheet>"))
    names = "".join(f'<sheet name={_attribute(s)} sheetId="{i}"/>' for i, (s, _) in enumerate(sheets, 1))
    strings = "".join(f'<si><t xml:space="preserve">{xml_text(s)}</t></si>' for s in shared)
    return archive([("xl/workbook.xml", f"<workbook {_MAIN}><sheets>{names}</sheets></workbook>"), ("xl/sharedStrings.xml", f"<sst {_MAIN}>{strings}</sst>"), *parts])


def inline_facts(facts: list[dict[str, str | None]]) -> str:
    """A document with tagged facts of ``concept``, ``text``, ``unit``, ``period``, ``decimals``."""
    out = []
    for f in facts:
        attrs = "".join(f" {k}={_attribute(v)}" for k, v in (("name", f["concept"]), ("contextRef", f["period"]), ("unitRef", f["unit"]), ("decimals", f["decimals"])) if v is not None)
        out.append(f"<p>of which <ix:nonFraction{attrs}>{xml_text(f['text'] or '')}</ix:nonFraction> in all</p>")
    return f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:ix="http://www.xbrl.org/2013/inlineXBRL"><body>{"".join(out)}</body></html>'


def literal(text: str) -> bytes:
    """A literal string; characters beyond one byte become question marks."""
    return b"(" + re.sub(rb"([\\()])", rb"\\\1", text.encode("latin-1", "replace")).replace(b"\r", b"\\r").replace(b"\n", b"\\n") + b")"


def hexed(text: str) -> bytes:
    return b"<" + text.encode("latin-1", "replace").hex().encode() + b">"


def pages(contents: list[bytes], form: bytes | None = None, title: str = "", compress: bool = False) -> bytes:
    """A document of one content stream a page; ``form`` is the form object Fm0 of all."""

    def stream(data: bytes, extra: bytes = b"") -> bytes:
        if compress:
            data, extra = zlib.compress(data, 1), extra + b"/Filter/FlateDecode"
        return b"<<%s/Length %d>>stream\n%s\nendstream" % (extra, len(data), data)

    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b""]
    uses = b""
    if form is not None:
        objects.append(stream(form, b"/Type/XObject/Subtype/Form"))
        uses = b"/Resources<</XObject<</Fm0 3 0 R>>>>"
    kids = []
    for content in contents:
        objects += [stream(content), b"<</Type/Page/Parent 2 0 R/Contents %d 0 R%s>>" % (len(objects) + 1, uses)]
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<</Type/Pages/Kids[%s]/Count %d/MediaBox[0 0 595 842]>>" % (b" ".join(kids), len(kids))
    objects.append(b"<</Title%s>>" % literal(title))
    out, at = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    table = b"".join(b"%010d 00000 n \n" % a for a in at)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<</Size %d/Root 1 0 R/Info %d 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, table, len(objects) + 1, len(objects), len(out))

"""Tagged facts from the XML and HTML entries of a filing archive.

Entries are read with a tolerant event parser that keeps prefixes and resolves
them against the ``xmlns`` declarations in scope, since what makes an element a
fact is its namespace. The text of a fact is its direct text; elements inside a
fact are consumed with it.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

EXTENSIONS = (".xbrl", ".xml", ".htm", ".html")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_ENCODING = re.compile(rb"<\?xml[^>]*encoding=[\"']([A-Za-z0-9._-]+)[\"']")
#: HTML elements that have no end tag.
_VOID = frozenset("area base br col embed frame hr img input isindex link meta param source wbr".split())
_RAW = re.compile(r"<(/?)([A-Za-z_][\w.:-]*)")


def number(text: str) -> float:
    """Commas dropped; 0 when the rest is no finite decimal number."""
    t = text.strip().replace(",", "")
    if not _NUMBER.fullmatch(t):
        return 0.0
    v = float(t)
    return v if abs(v) != float("inf") else 0.0


def is_fact(namespace: str, local: str) -> bool:
    inline = (namespace.endswith("/inlineXBRL") or "inline" in namespace) and local in ("nonFraction", "nonNumeric")
    return inline or "ifrs" in namespace


class _Facts(HTMLParser):
    """Streams elements; HTML's parser lowers names, so the written form is read from
    the source text of each tag."""

    CDATA_CONTENT_ELEMENTS = ()

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.scopes: list[tuple[str, dict[str, str]]] = []
        self.facts: list[dict] = []
        self.open: dict | None = None
        self.depth = 0

    def _written(self) -> tuple[str, dict[str, str]]:
        raw = self.get_starttag_text() or ""
        name = _RAW.match(raw)
        attrs = {}
        for m in re.finditer(r"([\w.:-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", raw[name.end() :] if name else ""):
            attrs[m[1]] = m[2].strip("\"'")
        return name[2] if name else "", attrs

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._start(tag, closed=tag in _VOID)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._start(tag, closed=True)

    def _start(self, tag: str, closed: bool) -> None:
        written, attrs = self._written()
        scope = dict(self.scopes[-1][1]) if self.scopes else {}
        for k, v in attrs.items():
            if k == "xmlns":
                scope[""] = v
            elif k.startswith("xmlns:"):
                scope[k[6:]] = v
        if self.open is not None:
            self.depth += 0 if closed else 1
        else:
            prefix, _, local = written.rpartition(":")
            # a prefix that nothing declares stands for itself
            if is_fact(scope.get(prefix, prefix), local):
                from html import unescape

                by_local = {k.rpartition(":")[2]: unescape(v) for k, v in attrs.items() if not k.startswith("xmlns")}
                fact = {"concept": by_local.get("name") or local, "unit": by_local.get("unitRef", ""), "period": by_local.get("contextRef", ""), "decimals": by_local.get("decimals", ""), "text": []}
                if closed:
                    self._close(fact)
                else:
                    self.open, self.depth = fact, 0
        if not closed:
            self.scopes.append((tag, scope))

    def handle_endtag(self, tag: str) -> None:
        # an end tag closes what is still open inside it; one that nothing opened is dropped
        if not any(t == tag for t, _ in self.scopes):
            return
        while self.scopes:
            t, _ = self.scopes.pop()
            if self.open is not None:
                if self.depth == 0:
                    self._close(self.open)
                    self.open = None
                else:
                    self.depth -= 1
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.open is not None and self.depth == 0:
            self.open["text"].append(data)

    def _close(self, fact: dict) -> None:
        text = "".join(fact.pop("text"))
        stripped = text.strip()
        self.facts.append(fact | {"raw_text": text, "value": number(text), "is_numeric": bool(_NUMBER.fullmatch(stripped.replace(",", "")))})


def parse_entry(content: bytes) -> list[dict]:
    """Facts of one entry. Raises ValueError when it can't be decoded."""
    declared = _ENCODING.search(content[:200])
    name = declared[1].decode().lower() if declared else "utf-8"
    if name not in ("utf-8", "utf8", "us-ascii", "ascii"):
        raise ValueError(f"encoding {name} is not supported")
    parser = _Facts()
    parser.feed(content.decode("utf-8-sig", "replace"))
    parser.close()
    if parser.open is not None:
        raise ValueError("a fact is cut off")
    return parser.facts


def read_facts(content: bytes) -> Iterator[tuple[str, dict | None, str | None]]:
    """(entry, fact, error) of an archive, entries in archive order. An entry that
    can't be read gives its error instead of facts, and the others still count.
    Raises ValueError for content that is no archive or has no entry to read."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ValueError(f"no archive: {e}") from e
    entries = [i for i in archive.infolist() if not i.is_dir() and i.filename.lower().endswith(EXTENSIONS)]
    if not entries:
        raise ValueError("the archive has no XBRL entry")
    for entry in entries:
        try:
            for fact in parse_entry(archive.read(entry)):
                yield entry.filename, fact, None
        except (ValueError, zipfile.BadZipFile, RuntimeError) as e:
            yield entry.filename, None, str(e)

"""Evaluation texts that stand, whole or in part, in a corpus.

Texts are brought to a canonical form in which layout, markup, page furniture,
letter case, punctuation and character forms are gone. Words are then typed:
numbers, units and names are slots of a template, all other words its fixed part.
Item windows are hash-joined with the corpus's windows in one pass over the
corpus, without a shuffle: the items' windows are small, checked, and go to the
tasks in blocks. The slots of a window that joins are then checked: their values map
one to one. Two results come from this:

* ``find_leaks``: windows of five words. Those whose slots agree in value are aligned
  with the item, exactly; re-parameterised ones beside them are counted;
* ``find_templates``: wide windows of which some slots have other values, which map one
  to one over the whole passage.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tokens import slices

#: A leak: so many successive words of an item, at most so many changed, dropped or added.
WORDS, EDITS = 20, 3
#: Words of a seed window: WORDS - EDITS words of a leak agree, in at most EDITS + 1
#: runs, so one of the runs has at least ceil(17 / 4) = 5 words.
SEED = 5
#: Fixed words that let a seed window join by its template; one with fewer (of names
#: and numbers mostly) says nothing without their values, and joins by these.
FIXED = 3
#: Tokens of a template window.
TEMPLATE = 14
#: Bytes of text that are searched at once.
SLICE = 3_000_000
#: Windows of items that go to the tasks at once; more items are taken in blocks.
BLOCK_WINDOWS = 2_000_000

_TAG_BLOCK = re.compile(r"(?i)</?(?:p|div|br|hr|td|th|tr|table|tbody|thead|ul|ol|li|h[1-6]|section|article|pre|blockquote)\b[^<>]*>")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9A-Fa-f]{1,6}|[A-Za-z]{2,8});")
#: Lines that belong to a page, not to its text.
FURNITURE = re.compile(
    r"(?i)\s*(?:page\s+\d+(?:\s*(?:of|/)\s*\d+)?|hal(?:aman|\.)?\s+\d+(?:\s*(?:dari|/)\s*\d+)?|[-–—]+\s*\d+\s*[-–—]+|(?:laporan tahunan|annual report)\s+\d{4}\s*\|\s*\d+|\d+\s*\|\s*(?:laporan tahunan|annual report)\s+\d{4})\s*"
)
#: Characters without a form of their own (zero width and the like).
_FORMAT = {chr(c) for c in (*range(0x110), *range(0x600, 0x2070), *range(0xFE00, 0x10000), *range(0xE0000, 0xE0080)) if unicodedata.category(chr(c)) == "Cf"}
_HYPHEN = re.compile(r"(?<=\w)[-‐­]\s*\n\s*(?=[^\W\d])")
_BROKEN = re.compile(r"[-‐­]\s*\n")
#: Quotes, brackets and the like before a word.
_LEAD = re.compile(r"^[\W_]+")
_LINES = ("\r\n", "\r", "\x0b", "\f", "\x85", "\u2028", "\u2029")


def canonical(text: str) -> str:
    """The text without layout, markup, furniture and odd character forms; case and
    punctuation stay until words are folded."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if not text.isascii():
            for c in _FORMAT.intersection(text):
                text = text.replace(c, "")
    if "<" in text:
        text = _TAG.sub("", _TAG_BLOCK.sub(" ", text))
    if "&" in text and _ENTITY.search(text):
        import html

        text = html.unescape(text)
    for c in _LINES:
        if c in text:
            text = text.replace(c, "\n")
    if "\n" not in text:
        return "" if FURNITURE.fullmatch(text) else text
    text = "\n".join([x for x in text.split("\n") if not FURNITURE.fullmatch(x)])
    return _HYPHEN.sub("", text) if _BROKEN.search(text) else text


def fold(token: str) -> str:
    """Letters and digits of a token, without case and accents."""
    t = token.casefold()
    if t.isalnum() and t.isascii():
        return t
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return "".join(c for c in t if c.isalnum())


def words(text: str | None) -> list[str]:
    return [w for w in map(fold, canonical(text or "").split()) if w]


# Words that state a unit or scale, in the languages of the texts.
UNITS = frozenset("idr rp rupiah usd us percent persen bps million billion trillion thousand juta miliar milyar triliun ribu mn bn tn tonnes ton kg kwh mwh gwh ha hectares hektar km m2 km2 bbl barrels barel litres liter".split())
_NUMBER, _UNIT, _NAME, _OTHER = 0, 1, 2, 3
#: Between rows; matches nothing.
_GAP = -9


class ItemIndex:
    """Windows of a block of items: vocabulary, seeds and templates."""

    def __init__(self, items: list[tuple[int, str]], wide: int = TEMPLATE) -> None:
        raw = [(k, [(t, f) for t in canonical(x or "").split() if (f := fold(t))]) for k, x in items]
        self.ids = [k for k, _ in raw]
        texts = [[f for _, f in ws] for _, ws in raw]
        self.code = {w: i + 4 for i, w in enumerate(sorted({w for t in texts for w in t}))}
        # names: words that never stand in lower case in the items
        lower = {f for _, ws in raw for t, f in ws if not (s := _LEAD.sub("", t))[:1].isupper() and not s[1:2].isupper()}
        first = {ws[i][1] for _, ws in raw for i in range(len(ws)) if i == 0 or ws[i - 1][0][-1:] in ".!?"}
        mid = {ws[i][1] for _, ws in raw for i in range(1, len(ws)) if ws[i - 1][0][-1:] not in ".!?" and _LEAD.sub("", ws[i][0])[:1].isupper()}
        self.names = {w for w in mid - lower if w not in UNITS and not w[:1].isdigit()} - (first - mid)
        self.texts = [[self.code[w] for w in t] for t in texts]
        slot = self.slot_of()
        at = np.concatenate([[0], np.cumsum([len(t) for t in self.texts])]).astype(np.int64)
        exact = np.array([c for t in self.texts for c in t], np.int64)
        # item words with ``wide`` unmatched ones around, enough for any window
        self.padded = np.full(len(exact) + wide * (len(self.texts) + 1), _GAP + 1, np.int32)
        self.padded_at = at[:-1] + wide * np.arange(1, len(self.texts) + 1)
        for t, begin in zip(self.texts, self.padded_at.tolist(), strict=True):
            self.padded[begin : begin + len(t)] = t
        item = np.repeat(np.arange(len(self.texts)), np.diff(at))
        place = np.arange(len(exact)) - at[item]
        left = np.diff(at)[item] - place  # words from here to the item's end
        template = np.where(slot[exact] < _OTHER, slot[exact], exact) if len(exact) else exact
        self.slot = slot
        self.seeds = self._index(seed_hash(exact, template), item, place, left >= SEED)
        self.form = np.full(len(self.padded), _GAP + 1, np.int32)  # as padded, slots by type
        self.form[self.padded_at[item] + place] = template
        self.templates = self._templates(template, item, place, np.flatnonzero(left >= TEMPLATE))
        self.n_windows = len(self.seeds[0])

    def slot_of(self) -> np.ndarray:
        """The slot type of each code; placeholders keep codes 0 to 3."""
        out = np.full(len(self.code) + 4, _OTHER, np.int64)
        out[:4] = range(4)
        for w, c in self.code.items():
            out[c] = slot_type(w, w in self.names)
        return out

    def _templates(self, template: np.ndarray, item: np.ndarray, place: np.ndarray, todo: np.ndarray) -> dict[int, tuple]:
        """By width, the run of words other than names that seeds each template window:
        of at most ``SEED`` words, the one with the most fixed words. Its place is
        window * TEMPLATE + offset. A window of names alone fixes nothing and has none."""
        names, fixed = (np.concatenate([[0], np.cumsum(x)]) for x in (template == _NAME, template > _OTHER))
        out = {}
        for width in range(SEED, 0, -1):
            best, off = np.full(len(todo), -1), np.zeros(len(todo), np.int64)
            for o in range(TEMPLATE - width + 1):
                at = todo + o
                score = np.where(names[at + width] == names[at], fixed[at + width] - fixed[at], -1)
                off = np.where(score > best, o, off)
                best = np.maximum(best, score)
            ok = best >= 0
            if ok.any():
                begin, o = todo[ok], off[ok]
                h = window_hash(template, width)[begin + o]
                order = np.argsort(h, kind="stable")
                key, start = np.unique(h[order], return_index=True)
                out[width] = h[order], item[begin][order], (place[begin] * TEMPLATE + o)[order], key, np.concatenate([start, [len(h)]])
            todo = todo[~ok]
        return out

    @staticmethod
    def _index(h: np.ndarray, item: np.ndarray, place: np.ndarray, ok: np.ndarray) -> tuple:
        keep = np.flatnonzero(ok[: len(h)])
        keep = keep[np.argsort(h[keep], kind="stable")]
        key, start = np.unique(h[keep], return_index=True)
        return h[keep], item[keep], place[keep], key, np.concatenate([start, [len(keep)]])


def slot_type(word: str, named: bool) -> int:
    if word[:1].isdigit():
        return _NUMBER
    if word in UNITS:
        return _UNIT
    return _NAME if named else _OTHER


def window_hash(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = codes.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(width):
            h = (h ^ (c[i : i + n] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
    return h


def seed_hash(codes: np.ndarray, template: np.ndarray) -> np.ndarray:
    """A hash of each run of ``SEED`` words: of its template, with placeholders for
    slots, or of the words themselves where fewer than ``FIXED`` are fixed. Runs of the
    same words have the same hash either way."""
    fixed = np.concatenate([[0], np.cumsum(template > _NAME)])
    enough = fixed[SEED:] - fixed[:-SEED] >= FIXED
    return np.where(enough, window_hash(template, SEED), ~window_hash(codes, SEED))


#: Least code of an unknown word's value.
_VALUE = 1 << 62


class _Codes(dict):
    """Raw token to code: its item word's; of an unknown word a 60-bit hash of its value
    with, in the last two bits, its slot type, whatever its case; -1 for none."""

    LIMIT = 1_000_000

    def __init__(self, index: ItemIndex) -> None:
        super().__init__()
        self.index = index

    def __missing__(self, token: str) -> int:
        w = fold(token)
        code = self.index.code.get(w) if w else -1
        if code is None:
            h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            code = _VALUE | h >> 4 << 2 | slot_type(w, True)
        if len(self) < self.LIMIT:
            self[token] = code
        return code


def kinds(flat: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """The slot type of each code; ``_GAP`` between rows."""
    known = slot[np.where((flat >= 0) & (flat < _VALUE), flat, 0)]
    return np.where(flat >= _VALUE, flat & 3, np.where(flat >= 0, known, _GAP))


def _matches(h: np.ndarray, index: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(corpus position, item, item position) of every window that agrees."""
    _, item, place, key, start = index
    if not len(key) or not len(h):
        none = np.zeros(0, np.int64)
        return none, none, none
    k = np.searchsorted(key, h)
    k[k == len(key)] = 0
    at = np.flatnonzero(key[k] == h)
    k = k[at]
    n = start[k + 1] - start[k]
    pos = np.repeat(at, n)
    entry = np.repeat(start[k], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return pos, item[entry], place[entry]


def reach(a: list[int], b: list[int], i: int, j: int, step: int, edits: int = EDITS) -> list[int]:
    """How many words of ``a`` from ``i`` on (in direction ``step``) can be covered in
    ``b`` from ``j`` on with 0, 1, ... ``edits`` words changed, dropped or added."""
    room_a = len(a) - i if step > 0 else i + 1
    room_b = len(b) - j if step > 0 else j + 1

    def run(x: int, d: int) -> int:
        y = x + d
        while x < room_a and y < room_b and a[i + step * x] == b[j + step * y]:
            x, y = x + 1, y + 1
        return x

    far = {0: run(0, 0)}
    best = [far[0]]
    for _ in range(edits):
        new: dict[int, int] = {}
        for d in range(min(far) - 1, max(far) + 2):
            x = max(far.get(d, -2) + 1, far.get(d + 1, -2) + 1, far.get(d - 1, -1))
            if x >= 0 and 0 <= x + d <= room_b and x <= room_a:
                new[d] = run(x, d)
            elif x > room_a and d in far:
                new[d] = room_a
        far = new or far
        best.append(max(best[-1], *far.values()))
    return best


def longest(a: list[int], b: list[int], seeds: list[tuple[int, int]], edits: int = EDITS) -> int:
    """The most successive words of ``a`` covered in ``b`` around any seed (i, j)."""
    most, seen = 0, set()
    for i, j in seeds:
        while i and j and a[i - 1] == b[j - 1]:  # the seed run's first word
            i, j = i - 1, j - 1
        if (i, j) in seen:
            continue
        seen.add((i, j))
        right, left = reach(a, b, i, j, 1, edits), reach(a, b, i - 1, j - 1, -1, edits)
        most = max(most, *(right[e] + left[edits - e] for e in range(edits + 1)))
    return most


def _documents(b: pa.RecordBatch, codes: _Codes, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words of a batch, with ``pad`` codes that match nothing around
    every row; start of each row's words, then one end more)."""
    gap = np.full(pad, _GAP, np.int64)
    parts, bounds = [gap], [pad]
    for x in b.column(1).to_pylist():
        arr = np.array(list(map(codes.__getitem__, canonical(x).split())) if x else [], np.int64)
        arr = arr[arr >= 0]
        parts += [arr, gap]
        bounds.append(bounds[-1] + len(arr) + pad)
    return np.concatenate(parts), np.array(bounds, np.int64)


def _consistent(flat: np.ndarray, kind: np.ndarray, index: ItemIndex, pos: np.ndarray, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of seed windows that join: (whether their slots map one to one, how many slots
    they have, how many of these have another value)."""
    off = np.arange(SEED)
    x, y = index.padded[(index.padded_at[item] + place)[:, None] + off], flat[pos[:, None] + off]
    slots = kind[pos[:, None] + off] < _OTHER
    ok = (slots | (x == y)).all(axis=1)
    for i in range(SEED):
        for j in range(i):
            ok &= ~(slots[:, i] & slots[:, j]) | ((x[:, i] == x[:, j]) == (y[:, i] == y[:, j]))
    return ok, slots.sum(axis=1), (slots & (x != y)).sum(axis=1)


def leaks_of_batch(b: pa.RecordBatch, index: ItemIndex, codes: _Codes, least: int, edits: int) -> dict[tuple[int, int], list[int]]:
    """(row, item) of the leaks in a batch: words covered, template windows, their
    slots, and the slots of another value."""
    pad = least + edits
    flat, bounds = _documents(b, codes, pad)
    kind = kinds(flat, index.slot)
    template = np.where((kind >= 0) & (kind < _OTHER), kind, flat)
    pos, item, place = _matches(seed_hash(flat, template), index.seeds)
    ok, slots, changed = _consistent(flat, kind, index, pos, item, place)
    pos, item, place, slots, changed = (x[ok] for x in (pos, item, place, slots, changed))
    doc = np.searchsorted(bounds, pos, "right") - 1
    found: dict[tuple[int, int], list[int]] = {}
    same = np.flatnonzero(changed == 0)  # slots agree in value: seeds of an alignment
    for k, at, n in _aligned(flat, bounds, pad, index, doc[same], pos[same], item[same], place[same], least, edits):
        row = found.setdefault((k, at), [0, 0, 0, 0])
        row[0] = max(n, row[0])
    if found:
        pairs, which, n = np.unique(doc * len(index.ids) + item, return_inverse=True, return_counts=True)
        sums = [np.bincount(which, w) for w in (slots, changed)]
        for p, *row in zip(pairs.tolist(), n.tolist(), *(s.astype(np.int64).tolist() for s in sums), strict=True):
            if (got := found.get(divmod(p, len(index.ids)))) is not None:
                got[1:] = row
    return found


def _aligned(flat: np.ndarray, bounds: np.ndarray, pad: int, index: ItemIndex, doc: np.ndarray, pos: np.ndarray, item: np.ndarray, place: np.ndarray, least: int, edits: int) -> Iterator[tuple[int, int, int]]:
    """(row, item, words covered) around seeds, where these are enough."""
    if not len(doc):
        return
    # runs: agreeing windows that follow each other on one diagonal are one
    diagonal = pos - place
    order = np.lexsort((pos, diagonal, item, doc))
    doc, pos, item, place, diagonal = doc[order], pos[order], item[order], place[order], diagonal[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (pos[1:] != pos[:-1] + 1)
    doc, pos, item, place = doc[new], pos[new], item[new], place[new]
    for lo in range(0, len(doc), 100_000):
        part = slice(lo, lo + 100_000)
        for r in np.flatnonzero(_enough(flat, index, pos[part], item[part], place[part], least, edits)).tolist():
            k, at = int(doc[lo + r]), int(item[lo + r])
            a, here = index.texts[at], int(pos[lo + r])
            left = max(int(bounds[k]), here - len(a) - edits)
            view = flat[left : min(int(bounds[k + 1]) - pad, here + len(a) + edits)].tolist()
            got = longest(a, view, [(int(place[lo + r]), here - left)], edits)
            if got >= least:
                yield k, at, got


def _enough(flat: np.ndarray, index: ItemIndex, pos: np.ndarray, item: np.ndarray, place: np.ndarray, least: int, edits: int) -> np.ndarray:
    """Whether some ``least`` successive item words around a run have all but ``edits``
    of them in the document, at most ``edits`` places off the run's diagonal. Every
    leak has; what remains is aligned."""
    off = np.arange(SEED - least, least)  # item words that can share a window with the run's first
    code = index.padded[(index.padded_at[item] + place)[:, None] + off]
    hit = np.zeros(code.shape, bool)
    at = pos[:, None] + off
    for d in range(-edits, edits + 1):
        hit |= flat[at + d] == code
    total = np.concatenate([np.zeros((len(pos), 1), np.int32), np.cumsum(hit, axis=1, dtype=np.int32)], axis=1)
    return (total[:, least:] - total[:, :-least]).max(axis=1) >= least - edits


def template_runs(flat: np.ndarray, kind: np.ndarray, bounds: np.ndarray, index: ItemIndex) -> Iterator[tuple[int, int, list[tuple]]]:
    """(row, item, runs) of the template windows that agree; windows that overlap
    or touch on one diagonal are a run: (position, item place, windows, inner).
    ``inner`` is the part, from the run's first word on, in which names count: between
    the first and the last agreeing word other than a name, or to the item's ends."""
    form = np.where((kind == _NUMBER) | (kind == _UNIT), kind, flat)
    off = np.arange(TEMPLATE)
    hits = []
    for width, seeds in index.templates.items():
        pos, item, place = _matches(window_hash(form, width), seeds)
        for lo in range(0, len(pos), 100_000):
            part = slice(lo, lo + 100_000)
            q, o = np.divmod(place[part], TEMPLATE)
            p, i = pos[part] - o, item[part]
            want = index.form[(index.padded_at[i] + q)[:, None] + off]
            at = p[:, None] + off
            ok = np.where(want == _NAME, kind[at] >= _NAME, form[at] == want).all(axis=1)
            hits.append(np.stack([np.searchsorted(bounds, p[ok], "right") - 1, i[ok], p[ok] - q[ok], p[ok]]))
    if not hits:
        return
    hits = np.concatenate(hits, axis=1)
    hits = hits[:, np.lexsort(hits[::-1])]
    new = np.ones(hits.shape[1], bool)
    new[1:] = (hits[:3, 1:] != hits[:3, :-1]).any(axis=0) | (hits[3, 1:] > hits[3, :-1] + TEMPLATE)
    begin = np.flatnonzero(new)
    last, runs = None, []
    end = np.append(begin[1:], hits.shape[1]) - 1
    for (k, i, d, p), n in zip(hits[:, begin].T.tolist(), (hits[3, end] - hits[3, begin] + 1).tolist(), strict=True):
        if (k, i) != last:
            if runs:
                yield *last, runs
            last, runs = (k, i), []
        q, size = p - d, n + TEMPLATE - 1
        sure = np.flatnonzero(index.form[index.padded_at[i] + q :][:size] != _NAME)
        runs.append((p, q, n, (0 if not q else int(sure[0]), size if q + size == len(index.texts[i]) else int(sure[-1]) + 1)))
    if runs:
        yield *last, runs


def passages(runs: list[tuple]) -> list[list[tuple]]:
    """The runs of a row and item put together to alignments: a run goes on where an
    earlier one ended, in the item as in the document, if words dropped or added
    between them shift it by at most ``EDITS``."""
    out: list[list[tuple]] = []
    last: dict[int, list[list[tuple]]] = {}  # passages by the diagonal of their last run
    for r in sorted(runs):
        diagonal, best = r[0] - r[1], None
        for d in range(diagonal - EDITS, diagonal + EDITS + 1):
            for passage in last.get(d, ()):
                p, q, n, _ = passage[-1]
                end = n + TEMPLATE - 1 - EDITS  # an added word can look like the next one
                if r[0] >= p + end and r[1] >= q + end and (best is None or p > best[-1][0]):
                    best, was = passage, d
        if best is None:
            out.append(best := [])
        else:
            last[was] = [x for x in last[was] if x is not best]
        best.append(r)
        last.setdefault(diagonal, []).append(best)
    return out


def slot_pairs(flat: np.ndarray, slot: np.ndarray, text: list[int], run: tuple) -> list[tuple[int, int, int]]:
    """(place in the run, item word, document word) of the slots of a run that count."""
    p, q, n, inner = run
    here = zip(text[q : q + n + TEMPLATE - 1], flat[p : p + n + TEMPLATE - 1].tolist(), strict=True)
    return [(at, x, y) for at, (x, y) in enumerate(here) if slot[x] < _NAME or slot[x] == _NAME and inner[0] <= at < inner[1]]


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", wide: int = TEMPLATE) -> Iterator[ItemIndex]:
    """The stated items in blocks whose windows fit a task; rows sent again count once."""
    block, size = [], 0
    rows = items.where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).groupBy(F.col(item_id).alias("k")).agg(F.max(text).alias("t")).orderBy("k")
    for r in rows.toLocalIterator():
        n = len(r["t"].split())
        if block and size + n > BLOCK_WINDOWS:
            yield ItemIndex(block, wide)
            block, size = [], 0
        block.append((r["k"], r["t"]))
        size += n
    if block:
        yield ItemIndex(block, wide)


def _scan(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, schema: str, each, wide: int = TEMPLATE) -> DataFrame:
    """``each(batch, index, codes)`` over the corpus for every block of items."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    kinds = dict(src.dtypes)["doc_id"], dict(items.dtypes)[item_id]
    out = None
    for index in item_blocks(items, item_id, item_text, wide):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            codes = _Codes(index)
            for b in batches:
                for at, n in slices(b.column(1), SLICE):
                    yield each(b.slice(at, n), index, codes)

        part = src.mapInArrow(run, schema.format(*kinds))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema.format(*kinds))


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = WORDS, edits: int = EDITS) -> DataFrame:
    """``doc_id``, ``item_id`` and ``n_words`` of the documents that carry at least
    ``least`` successive words of an item, at most ``edits`` of them changed, dropped
    or added; beside them ``n_windows`` (template windows of the pair whose slots are
    consistent), ``n_slots`` and ``n_changed`` (their slots, and those of another value).

    ``n_words`` is the most words of the item so covered. Null and empty texts, and
    items shorter than ``least`` words, give none. Rows with one ``doc_id`` and text
    sent again come out once. Whole texts are read, whatever their length; a document
    is decided on its own row, so neither a republished text nor a frequent passage
    makes a hot group.

    No leak is missed: of ``least`` words all but ``edits`` agree in at most ``edits`` + 1
    runs, so a window of ``SEED`` agrees word for word, and windows of the same words
    always join. Other parameters are refused."""
    if -(-(least - edits) // (edits + 1)) < SEED:
        raise ValueError(f"windows of {SEED} words would miss passages of {least} words with {edits} edits")

    def each(b: pa.RecordBatch, index: ItemIndex, codes: _Codes) -> pa.RecordBatch:
        best = leaks_of_batch(b, index, codes, least, edits)
        rows = sorted(best)
        keys = b.column(0).take(pa.array([k for k, _ in rows], pa.int64()))
        return pa.RecordBatch.from_arrays([keys, pa.array([index.ids[i] for _, i in rows], pa.int64()), *(pa.array([best[r][c] for r in rows], pa.int32()) for c in range(4))], ["doc_id", "item_id", *_COUNTS])

    found = _scan(docs, items, doc_id, text, item_id, item_text, "doc_id {0}, item_id bigint, " + ", ".join(f"{c} int" for c in _COUNTS), each, least + edits)
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in _COUNTS))


_COUNTS = ("n_words", "n_windows", "n_slots", "n_changed")


def find_templates(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents with re-parameterised passages of an item: ``doc_id``, ``item_id``,
    ``n_windows`` (template windows that agree), ``n_slots`` and ``n_changed`` (their
    slots, and those with another value).

    A window counts if its fixed words agree, at least one slot differs, and the
    slots of the whole passage (``passages``) are consistent: one value of the item
    always maps to one value of the document and back. A number or
    unit stands for one of its type, a name for any other word, whatever its case:
    in upper-case passages nothing tells names. A name at the end of a run of agreeing
    windows, with no agreeing word beyond, is not counted unless the item ends there."""

    def each(b: pa.RecordBatch, index: ItemIndex, codes: _Codes) -> pa.RecordBatch:
        slot = index.slot
        flat, bounds = _documents(b, codes, TEMPLATE)
        got: dict[tuple[int, int], list[int]] = {}
        for k, i, runs in template_runs(flat, kinds(flat, slot), bounds, index):
            for passage in passages(runs):
                pairs = [slot_pairs(flat, slot, index.texts[i], r) for r in passage]
                there, back = {}, {}
                if any(there.setdefault(x, y) != y or back.setdefault(y, x) != x for part in pairs for _, x, y in part):
                    continue
                for (_, _, n, _), part in zip(passage, pairs, strict=True):
                    sums = np.zeros((2, n + TEMPLATE), np.int64)  # slots and changed ones before each place
                    for at, x, y in part:
                        sums[:, at + 1] = 1, x != y
                    sums = sums.cumsum(axis=1)
                    own = (sums[:, TEMPLATE:] - sums[:, :-TEMPLATE])[:, :n]
                    own = own[:, own[1] > 0]
                    if own.size:
                        s = got.setdefault((k, i), [0, 0, 0])
                        s[0], s[1], s[2] = s[0] + own.shape[1], s[1] + int(own[0].sum()), s[2] + int(own[1].sum())
        rows = sorted(got)
        keys = b.column(0).take(pa.array([k for k, _ in rows], pa.int64()))
        return pa.RecordBatch.from_arrays([keys, pa.array([index.ids[i] for _, i in rows], pa.int64()), *(pa.array([got[r][c] for r in rows], pa.int32()) for c in range(3))], ["doc_id", "item_id", "n_windows", "n_slots", "n_changed"])

    found = _scan(docs, items, doc_id, text, item_id, item_text, "doc_id {0}, item_id bigint, n_windows int, n_slots int, n_changed int", each)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("n_slots").alias("n_slots"), F.max("n_changed").alias("n_changed"))

"""Mapping freely entered values to a reference list.

Values and reference entries are brought to one squashed form: numbering, notes,
units and brackets off, abbreviations and synonyms spelled out, characters that
scanners confuse folded together. On squashed forms the Levenshtein distance is a
true metric, so a BK-tree prunes by the triangle inequality and returns every entry
within the threshold. The reference is cut into shards, one tree each; the winners
of the shards are merged by stage and distance. Only distinct values are looked up,
each once, a whole batch of them going down a tree level by level; results are joined
back to the rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a tree; a longer reference makes more shards.
SHARD = 5_000
#: A reference above this goes through ``match_large`` instead of to every task, with the same results.
MOST_ENTRIES = 100_000
#: Share of an entry's squashed length that may differ; entries shorter than
#: ``SHORT`` must agree exactly, as a letter more is another code.
THRESHOLD, SHORT = 0.29, 6
#: A cut off value must still have this share of its entry, and may differ by this share.
CUT_OFF, CUT_THRESHOLD = 0.6, 0.19

# Abbreviations and synonyms in both languages, by word.
WORDS = {
    "exp": "expenses", "exps": "expenses", "admin": "administrative", "adm": "administrasi", "mkt": "market", "addr": "address", "prsh": "perusahaan", "vol": "volume", "liabs": "liabilities", "liab": "liabilities",
    "no": "number", "dir": "director", "corp": "corporate", "rcvbl": "receivables", "rec": "receivables", "recv": "receivables", "pybl": "payables", "inv": "investment", "prop": "property", "int": "interests", "oblig": "obligations",
    "empl": "employees", "avg": "average", "co": "company", "cap": "capital", "ttl": "total", "tot": "total", "compr": "comprehensive", "depr": "depreciation", "amort": "amortization", "fin": "finance", "acq": "acquisition",
    "hutang": "utang", "aktiva": "aset", "pjk": "pajak", "jml": "jumlah", "jlh": "jumlah", "jm": "jumlah", "tgl": "tanggal", "pend": "pendapatan", "pengh": "penghasilan", "bln": "bulan", "thn": "tahun", "sekr": "sekretaris",
}
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4}
_FOLD = str.maketrans({"@": "a", "0": "o", "1": "i", "l": "i", "|": "i", "5": "s", "$": "s", "c": "e", "3": "e", "8": "b", "6": "b"})

_PREFIX = re.compile(r"^\s*(?:[-•*·–—]+\s*|\(?\d{1,3}(?:\.\d{1,3})*[.)]\s*|\(\d{1,3}\)\s*|\d{1,2}(?:\.\d{1,2})*\s+(?=\S)|\(?[ivx]{1,5}[.)]\s*|[a-z][.)]\s*)", re.I)
_NOTE = re.compile(r"\s*(?:\((?:note|notes|catatan|cat\.?|lihat catatan|see note)\s*\d*\)|\((?:un)?audited\)|\((?:tidak )?diaudit\)|\((?:in |dalam )?(?:rp|idr|usd|us\$)[^()]*\)|[-–—]\s*(?:rp|idr|usd)\b[\w .]*$|\d{0,2}\s?\*?\)\s*$|\*+\)?\s*$|(?<=[^\d\s])\s*\d\)\s*$|[.:…]+\s*$)", re.I)
_ACCENTS = re.compile(r"[̀-ͯ]")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def plain(text: str) -> str:
    """Lower case without accents and odd forms, white space and joiners as blanks."""
    text = unicodedata.normalize("NFKD", text)
    text = _ACCENTS.sub("", text)
    if " " not in text.strip():
        text = _CAMEL.sub(" ", text)
    return re.sub(r"\s", " ", text.casefold().replace("_", " ")).strip()


def bare(text: str) -> str:
    """Without numbering before and notes behind, as often as there are any."""
    while True:
        cut = _NOTE.sub("", _PREFIX.sub("", text, count=1)).strip(" ,;/")
        if cut == text or not cut:
            return cut or text
        text = cut


def squash(text: str, joined: bool = False) -> str:
    """Letters of the words, synonyms spelled out, confusable characters folded;
    words for "and" are left out, unless ``joined``."""
    words = [w for w in re.split(r"[^\w@$|&]+", text) if w]
    out = []
    for w in words:
        if w == "&" or not joined and w in ("and", "dan"):
            continue
        out.append("shortterm" if w == "st" and len(words) > 1 else WORDS.get(w, w))
    return "".join(c for c in "".join(out).replace("rn", "m").translate(_FOLD) if c.isalnum())


def readings(value: str) -> list[str]:
    """Squashed forms a value may stand for: itself, with the halves around a comma,
    dash or gap turned round, and each either side of a bilingual pair."""
    whole = bare(plain(value))
    turned = [whole]
    for m in re.finditer(r",|\s-\s|-|\s{3,}", whole):
        head, tail = whole[: m.start()].strip(), whole[m.end() :].strip()
        turned += [f"{tail} {head}", f"{bare(tail)} {bare(head)}"]
    out: dict[str, None] = {}
    for t in turned:
        parts = [t]
        if "(" in t:
            parts += [bare(p) for p in re.findall(r"\(([^()]{3,})\)", t)] + [bare(re.sub(r"\([^()]*\)?", " ", t))]
        parts += [bare(p) for q in parts[:] if "/" in q for p in q.split("/") if p.strip()]
        for p in parts:
            # entries stand in the trees with and without "and", so one form is enough here
            if s := squash(p):
                out.setdefault(s)
    return list(out)


def distance(a: str, b: str, peq: dict[str, int] | None = None) -> int:
    """Levenshtein distance, bit-parallel over ``a``."""
    m = len(a)
    if not m or not b:
        return m or len(b)
    if peq is None:
        peq = bits(a)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    get = peq.get
    for c in b:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ((ph << 1) | 1) & mask
        mh = (mh << 1) & mask
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv
    return score


def bits(a: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


class BKTree:
    """Entries under the edit metric; each node's children by distance to it."""

    def __init__(self, entries: list[str]) -> None:
        self.root: list | None = None
        for e in entries:
            self.add(e)

    def add(self, entry: str) -> None:
        if self.root is None:
            self.root = [entry, {}]
            return
        node = self.root
        while True:
            d = distance(node[0], entry)
            if d == 0:
                return
            if d not in node[1]:
                node[1][d] = [entry, {}]
                return
            node = node[1][d]

    def within(self, query: str, radius: int) -> list[tuple[int, str]]:
        """Every entry at most ``radius`` away. A child at distance c of its parent can
        hold such an entry only if c is within ``radius`` of the parent's distance."""
        if self.root is None:
            return []
        peq, out, stack = bits(query), [], [self.root]
        while stack:
            entry, kids = stack.pop()
            d = distance(query, entry, peq)
            if d <= radius:
                out.append((d, entry))
            for c, kid in kids.items():
                if d - radius <= c <= d + radius:
                    stack.append(kid)
        return out


class BatchTree:
    """A ``BKTree`` that takes many queries at once: a level of the tree is one set of
    (query, node) pairs, whose distances are computed together."""

    def __init__(self, tree: BKTree) -> None:
        nodes, kids = [tree.root] if tree.root else [], []
        at = 0
        while at < len(nodes):
            begin = len(nodes)
            below = sorted(nodes[at][1].items())
            nodes += [k for _, k in below]
            kids.append(([d for d, _ in below], begin))
            at += 1
        self.entries = [n[0] for n in nodes]
        self.size = np.array([len(e) for e in self.entries], np.int64)
        letters = sorted({c for e in self.entries for c in e})
        self.letter = {c: i for i, c in enumerate(letters)}
        self.text = np.zeros((len(nodes), int(self.size.max()) if nodes else 0), np.int64)
        for i, e in enumerate(self.entries):
            self.text[i, : len(e)] = [self.letter[c] for c in e]
        self.n_kids = np.array([len(d) for d, _ in kids], np.int64)
        self.first = np.array([b for _, b in kids], np.int64)  # children stand end to end
        self.apart = np.array([0, *(d for ds, _ in kids for d in ds)], np.int64)  # distance of each node to its parent

    def within(self, queries: list[str], radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, distance, node) of every entry within each query's radius; queries
        of at most 64 characters."""
        if not self.entries or not queries:
            return (np.zeros(0, np.int64),) * 3
        peq = np.zeros((len(queries), len(self.letter)), np.uint64)
        for i, q in enumerate(queries):
            for j, c in enumerate(q):
                k = self.letter.get(c)
                if k is not None:
                    peq[i, k] |= np.uint64(1 << j)
        length = np.array([len(q) for q in queries], np.int64)
        q, node, out = np.arange(len(queries)), np.zeros(len(queries), np.int64), []
        while len(q):
            below_q, below = [], []
            for lo in range(0, len(q), 200_000):
                a, n = q[lo : lo + 200_000], node[lo : lo + 200_000]
                d = self._distances(peq, length, a, n)
                hit = d <= radius[a]
                out.append(np.stack([a[hit], d[hit], n[hit]]))
                many = self.n_kids[n]
                parent = np.repeat(np.arange(len(a)), many)
                kid = np.repeat(self.first[n], many) + np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many)
                near = np.abs(self.apart[kid] - d[parent]) <= radius[a[parent]]
                below_q.append(a[parent[near]])
                below.append(kid[near])
            q, node = np.concatenate(below_q), np.concatenate(below)
        return tuple(np.concatenate(out, axis=1))

    def _distances(self, peq: np.ndarray, length: np.ndarray, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Levenshtein distances of pairs, bit-parallel over the query."""
        order = np.argsort(-self.size[node], kind="stable")  # pairs whose entry has ended are at the end
        q, node = q[order], node[order]
        one = np.uint64(1)
        size, m = self.size[node], length[q]
        top = (m - 1).astype(np.uint64)
        mask = np.where(m == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (one << m.astype(np.uint64) % np.uint64(64)) - one)
        pv, mv, score = mask.copy(), np.zeros(len(q), np.uint64), m.copy()
        with np.errstate(over="ignore"):
            for t in range(int(size[0]) if len(size) else 0):
                live = int(np.searchsorted(-size, -t, "left"))  # entries longer than t
                p, v = pv[:live], mv[:live]
                eq = peq[q[:live], self.text[node[:live], t]]
                xv = eq | v
                xh = (((eq & p) + p) ^ p) | eq
                ph = v | ~(xh | p)
                mh = p & xh
                score[:live] += ((ph >> top[:live]) & one).astype(np.int64) - ((mh >> top[:live]) & one).astype(np.int64)
                ph = (ph << one) | one
                pv[:live] = ((mh << one) | ~(xv | ph)) & mask[:live]
                mv[:live] = ph & xv & mask[:live]
        out = np.empty(len(q), np.int64)
        out[order] = score
        return out


def _period_aliases() -> dict[str, list[str]]:
    """Spellings of the report periods, from the grammar of quarters, months and dates."""
    out: dict[str, list[str]] = {"Audit": ["audit", "audited", "auditan", "annual", "annual report", "tahunan", "laporan tahunan", "tahunan audit", "full year", "fy", "year end", "yearend", "12m", "12 months", "twelve months", "dua belas bulan", "12 bulan", "fullyear", "akhir tahun"]}
    days = {3: 31, 6: 30, 9: 30, 12: 31}
    names = {3: ("march", "mar", "maret"), 6: ("june", "jun", "juni"), 9: ("september", "sep", "sept"), 12: ("december", "dec", "desember", "des")}
    out["Audit"] += [f"{days[12]} {m}" for m in names[12]]
    english = {1: ("first", "1st", "one", "three"), 2: ("second", "2nd", "two", "six"), 3: ("third", "3rd", "three", "nine")}
    local = {1: ("pertama", "kesatu", "satu", "tiga"), 2: ("kedua", "dua", "enam"), 3: ("ketiga", "tiga", "sembilan")}
    for n, roman in ((1, "i"), (2, "ii"), (3, "iii")):
        a = [f"{q}{s}{x}" for q in ("q", "qtr", "tw", "triwulan", "kuartal", "quarter", "qtr.", "tw.") for s in ("", " ", "-") for x in (n, roman)]
        a += [f"{n}q", f"{n}q", f"{english[n][0]} quarter", f"{english[n][1]} quarter", f"quarter {english[n][2]}", f"{3 * n}m", f"{3 * n} months", f"{3 * n} bulan", f"{english[n][3]} months", f"{local[n][-1]} bulan"]
        a += [f"{q} {x}" for q in ("triwulan", "kuartal", "tw") for x in local[n][:-1]]
        a += [f"{days[3 * n]} {m}" for m in names[3 * n]]
        out[f"Q{n}"] = a
    return out


def squash_exact(text: str) -> str:
    """For codes: letters and digits only; nothing is folded, one letter counts."""
    text = re.sub(r"^(?:per|as of|as at|untuk|for the)\s+", "", plain(text))
    return "".join(c for c in text if c.isalnum())


def entry_forms(exact: bool, aliases: dict[str, list[str]], term: str, alt: str | None) -> Iterator[tuple[str, str]]:
    """(spelling, form) of an entry."""
    for t in [term, alt, *aliases.get(term, ())]:
        for f in () if not t else (squash_exact(t),) if exact else (squash(plain(t)), squash(plain(t), True)):
            if f:
                yield t, f


def cut_forms(form: str) -> Iterator[str]:
    """What a cut off value may keep of a form."""
    for n in range(max(SHORT, int(CUT_OFF * len(form) + 0.999)), len(form)):
        yield form[:n]


@dataclass
class Matcher:
    """The entries of one field."""

    exact: bool
    entries: dict[str, tuple[int, str]] = field(default_factory=dict)
    cut_off: dict[str, tuple[int, str]] = field(default_factory=dict)
    shards: list[BKTree] = field(default_factory=list)
    short: list[BKTree] = field(default_factory=list)
    batch: tuple[list[BatchTree], list[BatchTree]] = ((), ())

    def build(self, terms: list[tuple[int, str, str | None]]) -> Matcher:
        aliases = _period_aliases() if self.exact else {}
        for k, term, alt in sorted(terms, key=lambda x: x[0]):
            for t, f in entry_forms(self.exact, aliases, term, alt):
                self.entries.setdefault(f, (k, t))
        if not self.exact:
            for s, at in list(self.entries.items()):
                for p in cut_forms(s):
                    # a cut off form that two entries share tells nothing
                    if p in self.cut_off and self.cut_off[p][0] != at[0]:
                        self.cut_off[p] = (-1, "")
                    else:
                        self.cut_off.setdefault(p, at)
            for p in [p for p, at in self.cut_off.items() if at[0] < 0 or p in self.entries]:
                del self.cut_off[p]
        return self.plant()

    def plant(self) -> Matcher:
        """The trees of the forms."""
        whole, cuts = sorted(self.entries), sorted(self.cut_off)
        self.shards = [BKTree(whole[i::n]) for n in [max(1, -(-len(whole) // SHARD))] for i in range(n)]
        self.short = [BKTree(cuts[i::n]) for n in [max(1, -(-len(cuts) // SHARD))] for i in range(n)]
        self.batch = [BatchTree(t) for t in self.shards], [BatchTree(t) for t in self.short]
        return self

    def find_many(self, values: list[str]) -> list[tuple[int, float, int] | None]:
        """``find`` for each of many values."""
        if self.exact:
            return [self.find(v) for v in values]
        forms = [readings(v) for v in values]
        out: list[tuple[int, float, int] | None] = [(min(same), 0.0, 1) if (same := [self.entries[f][0] for f in fs if f in self.entries]) else None for fs in forms]
        for stage, scalar, trees, table, most in ((1, self.shards, self.batch[0], self.entries, THRESHOLD), (2, self.short, self.batch[1], self.cut_off, CUT_THRESHOLD)):
            open_ = list(dict.fromkeys(f for fs, got in zip(forms, out, strict=True) if got is None for f in fs))
            best = self._closest_many([f for f in open_ if len(f) <= 64], trees, table, most)
            best |= {f: self._closest(f, scalar, table, most) for f in open_ if len(f) > 64}
            for i, fs in enumerate(forms):
                if out[i] is None and (hits := [h for f in fs if (h := best[f]) is not None]):
                    share, k = min(hits)
                    out[i] = k, share, stage
        return out

    @staticmethod
    def _closest_many(forms: list[str], trees: list[BatchTree], table: dict[str, tuple[int, str]], most: float) -> dict[str, tuple[float, int] | None]:
        """``_closest`` of each form; the radius grows for those that need it."""
        best: dict[str, tuple[float, int] | None] = dict.fromkeys(forms)
        todo = [(f, min(2, last), last) for f in forms for last in [int(most / (1 - most) * len(f) + 1e-9)]]
        while todo:
            texts, radius = [f for f, _, _ in todo], np.array([r for _, r, _ in todo], np.int64)
            for tree in trees:
                for q, d, node in zip(*(x.tolist() for x in tree.within(texts, radius)), strict=True):
                    f, e = texts[q], tree.entries[node]
                    share = d / max(len(e), len(f))
                    if share <= most and (not d or len(e) >= SHORT) and (best[f] is None or (share, table[e][0]) < best[f]):
                        best[f] = share, table[e][0]
            more = []
            for f, r, last in todo:
                b = best[f]
                reach = last if b is None else min(last, int(b[0] / (1 - b[0]) * len(f) + 1e-9))
                if r < reach:
                    more.append((f, reach if b is not None else min(last, 2 * r + 1), last))
            todo = more
        return best

    def find(self, value: str) -> tuple[int, float, int] | None:
        """(term id, distance as a share of the entry's length, stage) of the closest
        entry: stage 1 for whole entries, 2 for cut off ones, which count after them."""
        if self.exact:
            form = squash_exact(value)
            got = [(d, self.entries[e][0]) for t in self.shards for d, e in t.within(form, 0)] if form else []
            return (min(got)[1], 0.0, 1) if got else None
        forms = readings(value)
        same = [self.entries[f][0] for f in forms if f in self.entries]
        if same:  # distance 0 can't be beaten
            return min(same), 0.0, 1
        for stage, trees, table, most in ((1, self.shards, self.entries, THRESHOLD), (2, self.short, self.cut_off, CUT_THRESHOLD)):
            best: tuple[float, int] | None = None
            for form in forms:
                got = self._closest(form, trees, table, most if best is None else best[0])
                if got is not None and (best is None or got < best):
                    best = got
            if best is not None:
                return best[1], best[0], stage
        return None

    @staticmethod
    def _closest(form: str, trees: list[BKTree], table: dict[str, tuple[int, str]], most: float) -> tuple[float, int] | None:
        """(share, term id) of the closest entry at a share of at most ``most``: the
        winners of the shards, merged. The radius grows until no entry outside it can
        be closer; an entry of another length has at least that distance, so a share
        of s reaches no further than s / (1 - s) of the form's length."""
        last = int(most / (1 - most) * len(form) + 1e-9)
        best, radius = None, min(2, last)
        while True:
            for tree in trees:
                for d, e in tree.within(form, radius):
                    share = d / max(len(e), len(form))
                    if share <= most and (not d or len(e) >= SHORT) and (best is None or (share, table[e][0]) < best):
                        best = (share, table[e][0])
            reach = last if best is None else min(last, int(best[0] / (1 - best[0]) * len(form) + 1e-9))
            if radius >= reach:
                return best
            radius = reach if best is not None else min(last, 2 * radius + 1)


#: Fields whose entries are codes.
CODES = ("report_period",)


class Reference:
    """Matchers by field; what a task found for a value is kept."""

    def __init__(self, rows: list[tuple[int, str, str, str | None]], codes: tuple[str, ...] = CODES) -> None:
        by: dict[str, list[tuple[int, str, str | None]]] = {}
        for k, f, term, alt in rows:
            by.setdefault(f, []).append((k, term, alt))
        self.matchers = {f: Matcher(f in codes).build(terms) for f, terms in by.items()}
        # of equal entries the smaller id
        self.letters = {f: {t: k for k, *ts in sorted(terms, key=lambda x: -x[0]) for t in ts if t} for f, terms in by.items()}

    @classmethod
    def of_forms(cls, rows: list[tuple[str, str, str, int]], codes: tuple[str, ...] = CODES) -> Reference:
        """From (field, kind, form, term id): "entry", "cut" or, letter for letter, "letter"."""
        self = cls([], codes)
        for f, kind, form, k in rows:
            if kind == "letter":
                self.letters.setdefault(f, {})[form] = k
            else:
                m = self.matchers.setdefault(f, Matcher(f in codes))
                (m.entries if kind == "entry" else m.cut_off)[form] = k, form
        for m in self.matchers.values():
            m.plant()
        return self

    def lookup(self, pairs: list[tuple[str, str | None]]) -> list[tuple[int | None, str, float | None, int | None]]:
        """(term id, how, share, stage) of each (field, value): how is "letter" (stage
        0), "matched" (1 or 2), "unmatched" or "empty"."""
        out: list = [None] * len(pairs)
        open_: dict[str, list[int]] = {}
        for i, (name, value) in enumerate(pairs):
            if value is None or not value.strip():
                out[i] = None, "empty", None, None
            elif value in self.letters.get(name, {}):
                out[i] = self.letters[name][value], "letter", 0.0, 0
            elif name in self.matchers:
                open_.setdefault(name, []).append(i)
            else:
                out[i] = None, "unmatched", None, None
        for name, at in open_.items():
            for i, hit in zip(at, self.matchers[name].find_many([pairs[i][1] for i in at]), strict=True):
                out[i] = (hit[0], "matched", hit[1], hit[2]) if hit else (None, "unmatched", None, None)
        return out


def _stated(terms: DataFrame) -> DataFrame:
    return terms.where(F.col("term").isNotNull()).groupBy("term_id", "field_name", "term").agg(F.max("alt_term").alias("alt_term"))


def reference_rows(terms: DataFrame) -> list[tuple[int, str, str, str | None]] | None:
    """The reference list, rows sent again once; None above ``MOST_ENTRIES``."""
    rows = _stated(terms).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        return None
    return [(r["term_id"], r["field_name"], r["term"], r["alt_term"]) for r in rows]


#: Columns of a looked up value.
_FOUND = "field_name string, value string, term_id bigint, how string, share double"


def match_values(values: DataFrame, terms: DataFrame) -> DataFrame:
    """``field_name``, ``row_id``, ``value`` rows with ``term_id``, ``how`` and ``share``.

    ``how`` tells values that are an entry letter for letter, values matched to the
    closest entry (``share`` is the distance over the longer length; of equally close
    entries the smaller id), unmatched values and empty ones (null or blank). Every
    row comes out. Distinct values are found map-side first, so one on a third of all
    rows is looked up once; the join back splits such a value's rows adaptively."""
    src = values.select("field_name", "row_id", F.col("value").cast("string").alias("value"))
    distinct = src.where(F.trim("value") != "").select("field_name", "value").distinct()
    found = match_distinct(distinct, terms)
    joined = src.join(found, ["field_name", "value"], "left")
    blank = F.col("value").isNull() | F.col("value").rlike(r"(?U)^[\s\x1c-\x1f]*$")
    return joined.select("field_name", "row_id", "value", "term_id", F.when(blank, F.lit("empty")).otherwise(F.coalesce("how", F.lit("unmatched"))).alias("how"), "share")


def match_distinct(distinct: DataFrame, terms: DataFrame) -> DataFrame:
    """``field_name``, ``value``, ``term_id``, ``how`` and ``share`` of distinct values."""
    rows = reference_rows(terms)
    if rows is None:
        return match_large(distinct, terms)
    spark = distinct.sparkSession
    reference = spark.sparkContext.broadcast(Reference(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = reference.value
        for b in batches:
            pairs = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            yield _batch([(*p, *hit[:3]) for p, hit in zip(pairs, ref.lookup(pairs), strict=True)], ("field_name", "value", "term_id", "how", "share"))

    # few bytes but much to do for each: a stated number of partitions isn't coalesced
    return distinct.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, _FOUND)


def reference_forms(terms: DataFrame) -> DataFrame:
    """``field_name``, ``kind``, ``form``, ``term_id`` of a reference of any size, as
    ``Reference.of_forms`` takes it. A form of several entries is the smaller id's; cut
    off forms that entries share, or that are entries, are left out over the whole
    reference, so a part of the rows decides as all of them do."""
    rows = _stated(terms).select(F.col("term_id").cast("bigint").alias("term_id"), "field_name", "term", "alt_term")

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aliases = _period_aliases()
        for b in batches:
            yield _batch([(f, form, k) for k, f, term, alt in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True) for _, form in entry_forms(f in CODES, aliases if f in CODES else {}, term, alt)], ("field_name", "form", "term_id"))

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([(f, p, k) for f, form, k in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) if f not in CODES for p in cut_forms(form)], ("field_name", "form", "term_id"))

    schema = "field_name string, form string, term_id bigint"
    entries = rows.mapInArrow(forms, schema).groupBy("field_name", "form").agg(F.min("term_id").alias("term_id"))
    both = entries.withColumn("whole", F.lit(True)).unionByName(entries.mapInArrow(cuts, schema).withColumn("whole", F.lit(False)))
    met = both.groupBy("field_name", "form").agg(F.max("whole").alias("whole"), F.min(F.when(F.col("whole"), F.col("term_id"))).alias("own"), F.min("term_id").alias("lo"), F.max("term_id").alias("hi"))
    told = met.where(F.col("whole") | (F.col("lo") == F.col("hi"))).select("field_name", F.when(F.col("whole"), "entry").otherwise("cut").alias("kind"), "form", F.coalesce("own", "lo").alias("term_id"))
    letters = rows.select("field_name", F.explode(F.array("term", "alt_term")).alias("form"), "term_id").where(F.col("form") != "").groupBy("field_name", "form").agg(F.min("term_id").alias("term_id"))
    return told.unionByName(letters.select("field_name", F.lit("letter").alias("kind"), "form", "term_id"))


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    types = {"term_id": pa.int64(), "share": pa.float64(), "stage": pa.int32()}
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, cols, strict=True)], list(names))


def match_large(values: DataFrame, terms: DataFrame, shards: int = 64) -> DataFrame:
    """``match_distinct`` for a reference of any size: every distinct value meets every
    shard of the reference's forms, each shard's trees are built where its forms are,
    and the winners of the shards are merged by (stage, share, term_id). What is shared
    between entries is settled before (``reference_forms``), so the number of shards
    changes nothing. Unmatched values come out with null."""
    distinct = values.where(F.trim("value") != "").select("field_name", "value").distinct()
    a = distinct.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("shard", "field_name", "value", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("bigint").alias("term_id"))
    b = reference_forms(terms).select(F.pmod(F.xxhash64("field_name", "form"), F.lit(shards)).cast("int").alias("shard"), "field_name", F.lit(None).cast("string").alias("value"), "kind", "form", "term_id")
    spread = b.unionByName(a).repartition(shards, "shard").sortWithinPartitions("shard", F.col("value").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, ref, pairs = None, [], None, []

        def found() -> pa.RecordBatch:
            nonlocal ref, pairs
            if pairs and ref is None:
                ref = Reference.of_forms(rows)
            out = [(*p, hit[0], hit[2], hit[3]) for p, hit in zip(pairs, ref.lookup(pairs) if pairs else [], strict=True)]
            pairs = []
            return _batch(out, ("field_name", "value", "term_id", "share", "stage"))

        for b in batches:
            for s, f, v, kind, form, k in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if s != shard:
                    yield found()
                    shard, rows, ref = s, [], None
                if v is None:
                    rows.append((f, kind, form, k))
                else:
                    pairs.append((f, v))
            yield found()

    won = spread.mapInArrow(run, "field_name string, value string, term_id bigint, share double, stage int")
    best = won.groupBy("field_name", "value").agg(F.min(F.when(F.col("term_id").isNotNull(), F.struct("stage", "share", "term_id"))).alias("w"))
    how = F.when(F.col("w").isNull(), F.lit("unmatched")).when(F.col("w.stage") == 0, F.lit("letter")).otherwise(F.lit("matched"))
    return best.select("field_name", "value", "w.term_id", how.alias("how"), "w.share")

"""Cutting oversized texts into pieces at natural boundaries.

Sizes are tokens of a public tokenizer. A text within the limit is one piece. A
larger one is encoded once and split down a hierarchy of separators: into sections,
those that are larger than a piece into paragraphs, these into lines, sentences, words
and at last characters. The parts are packed into pieces greedily, in order, as long as
they fit; a piece ends before a part that doesn't, and only a part at the beginning of a
piece is split further. Each piece after the first begins with the last ``overlap``
tokens of the piece before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tokens import TOKENIZERS, VOCABULARY, WordTable, encoder, slices

LIMIT, OVERLAP = 1024, 64
#: Patterns whose end (or group 1's start) is a natural boundary, highest level first.
SEPARATORS = (
    re.compile(r"\f|\n\s*\n(?=[ \t]*(?:#|[IVX]+\.\s|\d+(?:\.\d+)*\.?\s+[A-Z]))|\n(?=#+ )"),  # section
    re.compile(r"(?:\r?\n[^\S\r\n]*){2,}"),  # paragraph
    re.compile(r"\r\n|[\n\r\v\x85  ]"),  # line
    re.compile(r"[.!?…][\"'”’)\]]*(?=\s)|[。！？]"),  # sentence
    re.compile(r"(?=\s\S)|(?<=\s)(?=\S)"),  # word
)


def token_ends(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters that are complete after each token, whether it ends one)."""
    ends = np.cumsum(sizes[ids])
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) == len(text):
        return ends, np.ones(len(ends), bool)
    begins = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80  # first bytes of characters
    before = np.concatenate([[0], np.cumsum(begins)])
    whole = np.concatenate([begins, [True]])[ends]
    return np.where(whole, before[ends], before[ends] - 1), whole


class _Parts:
    """A text's parts by separators, as ranges of tokens."""

    def __init__(self, text: str, ends: np.ndarray, whole: np.ndarray) -> None:
        self.text, self.ends = text, ends
        self.cuts = np.flatnonzero(whole) + 1  # token counts that end on a character
        self.chars = ends[whole]  # increasing: where they end

    def split(self, low: int, high: int, level: int) -> list[tuple[int, int, int]]:
        """The parts of tokens low to high at a level, last one first, with the level
        that would split them further."""
        begin, end = int(self.ends[low - 1]) if low else 0, int(self.ends[high - 1])
        found = np.array([m.end() for m in SEPARATORS[level].finditer(self.text, begin, min(len(self.text), end + 80))], np.int64)
        at = np.searchsorted(self.chars, found[found < end])
        cuts = self.cuts[at][self.chars[at] == found[found < end]]
        bounds = [low, *cuts[(cuts > low) & (cuts < high)].tolist(), high]
        return [(a, b, level + 1) for a, b in zip(bounds[-2::-1], bounds[:0:-1], strict=True)]

    def characters(self, low: int, room: int, most: int) -> int:
        """The last token up to low + room that ends a character; if none does, the
        first up to low + most; else low + room."""
        k = int(np.searchsorted(self.cuts, low + room, "right")) - 1
        if k >= 0 and self.cuts[k] > low:
            return int(self.cuts[k])
        return int(self.cuts[k + 1]) if k + 1 < len(self.cuts) and self.cuts[k + 1] <= low + most else low + room


def split_text(text: str, enc, limit: int = LIMIT, overlap: int = OVERLAP, ids: np.ndarray | None = None, sizes: np.ndarray | None = None) -> list[tuple[int, int, int, np.ndarray]]:
    """(start, fresh, end, ids) of each piece: characters start to end, of which those
    before ``fresh`` repeat the piece before. The ids are the text's own, so without
    their overlaps they add up to the ids of the whole text, and no piece has more than
    ``limit``. Room is left where the repeated part, read on its own, encodes longer; a
    limit that leaves no such room is kept in the text's own ids only. A piece that can't
    hold a whole character ends inside one, which then counts to the piece behind."""
    if limit <= overlap:
        raise ValueError("the limit must exceed the overlap")
    ids = np.asarray(enc.encode_ordinary(text) if ids is None else ids, np.int32)
    n = len(ids)
    if n <= limit:
        return [(0, 0, len(text), ids)]
    ends, whole = token_ends(text, ids, piece_sizes(enc) if sizes is None else sizes)
    starts, clean = np.concatenate([[0], ends]), np.concatenate([[True], whole])
    parts, todo = _Parts(text, ends, whole), [(0, n, 0)]
    out, done = [], 0
    while done < n:
        first = max(0, done - overlap)
        a = first
        while not clean[a]:  # a token that begins inside a character: take the character whole
            a -= 1
        most = limit - (done - first)
        longer = len(enc.encode_ordinary(text[starts[a] : starts[done]])) - (done - first) if done else 0  # it may begin inside a word
        room, stop = min(most, max(1, most - max(0, longer))), done
        while todo:
            low, high, level = todo[-1]
            if high <= done + room:
                stop = high
                todo.pop()
            elif stop > done:
                break  # the piece ends before a part that doesn't fit
            elif level < len(SEPARATORS):
                todo[-1:] = parts.split(low, high, level)
            else:
                stop = parts.characters(low, room, most)
                todo[-1] = (stop, high, level)
                break
        out.append((int(starts[a]), int(starts[done]), int(starts[stop]), ids[first:stop]))
        done = stop
    return out


def piece_sizes(enc) -> np.ndarray:
    """Bytes of each id of the vocabulary."""
    return np.array([len(p) for p in enc.decode_tokens_bytes(range(enc.n_vocab))], np.int64)


_SCHEMA = "doc_id {kind}, piece_no int, n_pieces int, char_start int, char_fresh int, char_end int, n_tokens int, text string, ids array<int>"


def split_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, folder: str = TOKENIZERS, name: str = VOCABULARY, only_oversized: bool = False) -> DataFrame:
    """The pieces of every text: ``doc_id``, ``piece_no`` from 0, ``n_pieces``, the
    characters ``char_start`` to ``char_end`` (fresh from ``char_fresh``), ``n_tokens``,
    ``text`` and ``ids``.

    A null or empty text is one empty piece (``text`` '' and no ids); a text within
    the limit is one piece. With ``only_oversized`` only texts of two or more pieces
    come out; a text of at most ``limit`` bytes cannot be one of them and is not even
    encoded. Whole texts are split, each in one pass on its own row."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    if only_oversized:
        src = src.where(F.octet_length("text") > limit)
    kind = dict(src.dtypes)["doc_id"]
    fields = [pa.int32()] * 6 + [pa.string(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        table, sizes = WordTable(enc.encode_ordinary), piece_sizes(enc)

        def batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [id_type, *fields], strict=True)], ["doc_id", "piece_no", "n_pieces", "char_start", "char_fresh", "char_end", "n_tokens", "text", "ids"])

        for b in batches:
            rows: list[tuple] = []
            for at, m in slices(b.column(1)):
                keys, texts = b.column(0).slice(at, m), b.column(1).slice(at, m)
                coded = table.encode_batch(texts)
                pick = pc.indices_nonzero(pc.greater(coded.value_lengths(), limit)) if only_oversized else pa.array(range(m), pa.uint64())
                for k, x, i in zip(keys.take(pick).to_pylist(), texts.take(pick).to_pylist(), pick.to_pylist(), strict=True):
                    x = x or ""
                    parts = split_text(x, enc, limit, overlap, coded[i].values.to_numpy(), sizes)
                    rows += [(k, n, len(parts), s, f, e, len(own), x[s:e], own) for n, (s, f, e, own) in enumerate(parts)]
                    if len(rows) > 2000:
                        yield batch(rows, b.schema.field(0).type)
                        rows = []
            yield batch(rows, b.schema.field(0).type)

    return src.mapInArrow(run, _SCHEMA.format(kind=kind))


def oversized(docs: DataFrame, **options) -> DataFrame:
    """``doc_id`` of the texts that the splitter cuts: those above the limit."""
    return split_corpus(docs, only_oversized=True, **options).where(F.col("piece_no") == 1).select("doc_id")

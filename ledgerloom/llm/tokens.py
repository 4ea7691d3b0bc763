"""Encoding a whole corpus with a public byte-level BPE, and back.

A text's ids are those of its pre-tokens in order, and a corpus has few distinct
ones. ``encode_corpus`` splits words in the JVM, encodes each distinct word of the
corpus once, and joins ids back by position: the frequent words' table (bounded by
``SHARED_WORDS``) lies in every task, so each batch of texts is one vectorised
lookup and take, and no text is shuffled. ``encode_by_join`` does the same with
nothing but joins.

``WordTable`` serves passes that have no table beforehand: it splits at blanks (a
blank before a non-blank always starts a pre-token) and keeps what a task has met.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabularies lie; a parameter of every function that needs one.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the vocabulary's published pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words a task keeps; beyond it the table starts anew and words met again are encoded again.
TABLE_WORDS = 1_000_000
#: Words of the corpus-wide table that go to every task: some tens of MB at most.
SHARED_WORDS = 500_000
#: Words of texts that are joined to their ids at once.
SLICE_WORDS = 1_000_000
#: The pre-token pattern in the JVM's dialect.
_JVM_PATTERN = r"(?U)'(?:s|t|re|ve|m|ll|d)| ?(?:\p{L}++|\p{N}++|[^\s\p{L}\p{N}]++)|\s+(?!\S)|\s++"
#: Code points that the JVM's Unicode version does not know; texts with any are encoded whole.
_JVM_UNKNOWN = r"\p{Cn}"
#: Words longer than this are encoded but not kept.
LONGEST_KEPT = 64
#: Other white space than blanks. Where it meets two blanks, or stands on both sides
#: of one, or of one before the end, a blank need not start a pre-token; such texts
#: are encoded whole.
_WS = r"[\t\n\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNSAFE = f"{_WS}  |  {_WS}|{_WS} {_WS}|{_WS} $"


def load_ranks(folder: str = TOKENIZERS, name: str = VOCABULARY) -> dict[bytes, int]:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, name: str = VOCABULARY):
    """One encoder per process."""
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=load_ranks(folder, name), special_tokens={})


class WordTable:
    """Distinct words to ids, filled as words are met."""

    def __init__(self, encode, limit: int = TABLE_WORDS) -> None:
        self.encode, self.limit, self.known = encode, limit, {}

    def ids(self, word: str) -> list[int]:
        got = self.known.get(word)
        if got is None:
            got = self.encode(word)
            if len(word) <= LONGEST_KEPT:
                if len(self.known) >= self.limit:
                    self.known.clear()
                self.known[word] = got
        return got

    def slots(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[int]], np.ndarray]:
        """(bounds of each text, slot of each word, ids of each used slot, used slots).

        A word's slot tells whether a blank precedes it; a run of m further blanks
        is one word of m blanks."""
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        words = split.values.dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = words.dictionary.to_pylist()
        head = np.zeros(len(codes) + 1, bool)
        head[bounds] = True  # the first word of a text has no blank before it
        head = head[:-1]
        slot = codes * 2 + head
        empty = distinct.index("") if "" in distinct else -1
        blanks: list[int] = []
        if empty >= 0:
            # a run of m empty words after the first word of a text stands for m blanks
            void = (codes == empty) & ~head
            start = void & ~np.concatenate([[False], void[:-1]])
            at = np.flatnonzero(start)
            if len(at):
                stop = np.flatnonzero(void & ~np.concatenate([void[1:], [False]]) | (void & np.concatenate([head[1:], [True]])))
                m = stop[np.searchsorted(stop, at)] - at + 1
                sizes, which = np.unique(m, return_inverse=True)
                blanks = sizes.tolist()
                slot[void] = codes[void] * 2 + 1  # nothing: the ids of an empty first word
                slot[at] = 2 * len(distinct) + which
        used = np.unique(slot)
        got = []
        for s in used.tolist():
            w = " " * blanks[s - 2 * len(distinct)] if s >= 2 * len(distinct) else distinct[s >> 1] if s & 1 else " " + distinct[s >> 1]
            got.append(self.ids(w) if w else [])
        return bounds, slot, got, used

    def _plain(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        return texts, pc.invert(pc.match_substring_regex(texts, UNSAFE))

    def encode_batch(self, texts: pa.Array) -> pa.ListArray:
        """Lists of ids of a batch of texts; null and empty texts give empty lists."""
        texts, plain = self._plain(texts)
        bounds, slot, got, used = self.slots(pc.if_else(plain, texts, pa.scalar("", pa.large_string())))
        sizes = np.array([len(g) for g in got], np.int64)
        pool = np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum()))
        which = np.searchsorted(used, slot)
        starts = (np.cumsum(sizes) - sizes)[which]
        n = sizes[which]
        ends = np.cumsum(n)
        flat = pool[np.repeat(starts - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[bounds]
        whole = np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist()
        if whole:
            alone = {k: np.array(self.encode(texts[k].as_py()), np.int32) for k in whole}
            parts = [alone[k] if k in alone else flat[cuts[k] : cuts[k + 1]] for k in range(len(texts))]
            cuts, flat = np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(parts)
        return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat.astype(np.int32)))


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY, most: int = SHARED_WORDS) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every row, without special tokens.

    Words are split in the JVM; the corpus's distinct words are each encoded once; the
    ``most`` frequent of them go to the tasks, where ids are joined back by position. A
    word beyond them (fewer occurrences each) is encoded where it stands.
    Null and empty texts have the defined ids of an empty list. A text is encoded
    whole, however long; strings of special tokens are ordinary text. Rows come out
    one for one, rows with a null id too; other columns are not read."""
    frequent = word_table(split_words(docs, doc_id, text), folder, name).orderBy(F.desc("n"), "word").select("word", "ids").limit(most).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(frequent.combine_chunks())
    t = F.col(text).cast("string")
    src = docs.select(F.col(doc_id).alias("doc_id"), F.regexp_extract_all(t, F.lit(_JVM_PATTERN), F.lit(0)).alias("words"), F.when(t.rlike(_JVM_UNKNOWN), t).alias("odd"))
    kind = dict(src.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, name).encode_ordinary
        joiner = WordJoin(shared.value, WordTable(encode))
        for whole in batches:
            for at, m in parts(pc.fill_null(pc.list_value_length(whole.column(1)), 0).to_numpy(zero_copy_only=False), SLICE_WORDS):
                b = whole.slice(at, m)
                ids, odd = joiner.join(b.column(1)), b.column(2)
                if odd.null_count < len(odd):
                    ids = pa.array([encode(o) if o is not None else i for i, o in zip(ids.to_pylist(), odd.to_pylist(), strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return src.mapInArrow(run, f"doc_id {kind}, ids array<int>")


class WordJoin:
    """Words of texts to ids, by position, with a table of words."""

    def __init__(self, table: pa.Table, rest: WordTable) -> None:
        one = lambda c, kind: table.column(c).combine_chunks() if table.num_rows else pa.array([], kind)
        words, ids = one("word", pa.string()), one("ids", pa.list_(pa.int32()))
        self.words, self.rest = words.cast(pa.string()), rest
        self.sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.pool = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)

    def join(self, lists: pa.ListArray) -> pa.ListArray:
        lists = pc.fill_null(lists, [])
        bounds = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds = bounds - bounds[0]
        at = pc.index_in(words, value_set=self.words)
        which = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes, pool = self.sizes, self.pool
        missing = np.flatnonzero(which < 0)
        if len(missing):
            rare = words.take(pa.array(missing)).dictionary_encode()
            got = [self.rest.ids(w) for w in rare.dictionary.to_pylist()]
            which[missing] = len(sizes) + rare.indices.to_numpy(zero_copy_only=False)
            sizes = np.concatenate([sizes, [len(g) for g in got]]).astype(np.int64)
            pool = np.concatenate([pool, np.fromiter(chain.from_iterable(got), np.int32)])
        n = sizes[which]
        starts, ends = (np.cumsum(sizes) - sizes)[which], np.cumsum(n)
        flat = pool[np.repeat(starts - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[bounds]
        return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat.astype(np.int32)))


def parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) parts of rows of at most ``most`` size together, one row at least."""
    at, total = 0, 0
    for k, s in enumerate(sizes.tolist()):
        if k > at and total + s > most:
            yield at, k - at
            at, total = k, 0
        total += s
    if len(sizes) > at:
        yield at, len(sizes) - at


def slices(texts: pa.Array, most: int = 16_000_000) -> Iterator[tuple[int, int]]:
    """(start, length) parts of a batch of at most ``most`` bytes of text each, one row at least."""
    return parts(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), most)


def word_table(words: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``word``, ``n`` (how often it occurs) and ``ids`` of the distinct words of a
    corpus, each encoded once; counts combine map-side."""
    distinct = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, name).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([encode(w) for w in b.column(0).to_pylist()], pa.list_(pa.int32()))], ["word", "n", "ids"])

    return distinct.mapInArrow(run, "word string, n bigint, ids array<int>")


def split_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``pos`` and ``word`` of every pre-token, split inside the JVM. Code
    points that the JVM's Unicode version does not know yet count as symbols."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.regexp_extract_all(text, F.lit(_JVM_PATTERN), F.lit(0))).alias("pos", "word"))


def encode_by_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``encode_corpus`` with one word table for the whole corpus: all words are joined
    to their ids and brought back to their documents by position. Every word of the
    corpus is shuffled twice (README has the figures); ``doc_id`` must be unique."""
    words = split_words(docs, doc_id, text)
    back = words.join(word_table(words, folder, name).drop("n"), "word").groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("ids"))
    ids = docs.select(F.col(doc_id).alias("doc_id")).join(back, "doc_id", "left")
    return ids.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def pieces_table(spark: SparkSession, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``id``, ``piece`` (binary) of the vocabulary; its size is the vocabulary's."""
    ranks = load_ranks(folder, name)
    rows = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "piece": pa.array(list(ranks), pa.binary())})
    return spark.createDataFrame(rows)


def decode_corpus(encoded: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``text`` back from ids, without a shuffle.

    A batch's ids are joined to their pieces by one vectorised take; pieces lie end to
    end, so a text is the bytes between the first piece of its row and the last. Null
    and empty lists give the empty text; an id that is no piece gives a null text, and
    bytes that are no UTF-8 (a list cut inside a character) the replacement character."""
    kind = dict(encoded.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(folder, name)
        pieces = [b""] * (max(ranks.values()) + 2)  # the last stands for ids that are no piece
        for piece, i in ranks.items():
            pieces[i] = piece
        known, table = np.array([p != b"" for p in pieces]), pa.array(pieces, pa.large_binary())
        for b in batches:
            lists = pc.fill_null(b.column(1), [])
            starts = lists.offsets.to_numpy()
            flat = pc.fill_null(lists.values, -1).to_numpy(zero_copy_only=False)
            flat = np.where((flat < 0) | (flat >= len(pieces) - 1), len(pieces) - 1, flat)
            taken = table.take(pa.array(flat))
            ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
            data = (taken.buffers()[2] or pa.py_buffer(b"")).to_pybytes() if len(taken) else b""
            unknown = np.concatenate([[0], np.cumsum(~known[flat])]) if len(flat) else np.zeros(1, np.int64)
            texts = [data[ends[s] : ends[e]].decode("utf-8", "replace") if unknown[s] == unknown[e] else None for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def decode_by_join(encoded: DataFrame, pieces: DataFrame) -> DataFrame:
    """``decode_corpus`` as a join of exploded ids with the table of pieces.

    An empty list gives the empty text; an id that is no piece gives a null text.
    The vocabulary is the bounded side of the join; documents meet again in one
    shuffle of their own pieces."""
    tokens = encoded.select("doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    joined = tokens.join(F.broadcast(pieces), "id", "left")
    got = joined.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"), F.count_if(F.col("id").isNotNull() & F.col("piece").isNull()).alias("unknown")
    )
    hexed = F.array_join(F.transform(F.filter("p", lambda x: x["piece"].isNotNull()), lambda x: F.hex(x["piece"])), "")
    return got.select("doc_id", F.when(F.col("unknown") == 0, F.decode(F.unhex(hexed), "UTF-8")).alias("text"))

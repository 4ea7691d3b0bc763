from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import queries, split, tokens

pytest.importorskip("tiktoken")
ENC = tokens.encoder()
TRICKY = [None, "", " ", "  ", "\n", " \n ", "a  b", "a   b", "a \n b", "x\n\n  y", "tab\t\tx  ", "don't we'll", "１２ ﬁ　x", "👷🏽‍♀️ é", "<|endoftext|> x", "a" * 5000, " " * 300 + "x", "word " * 2000, "\x85 x", "\x1c y  z", "Kas   1.234   (5)", "new \U0001fae8 letter \U00011f04\U00011f05 end", "\U0001e030x"]


def test_batch_equals_the_tokenizer():
    table = tokens.WordTable(ENC.encode_ordinary)
    assert table.encode_batch(pa.array(TRICKY, pa.string())).to_pylist() == [ENC.encode_ordinary(t or "") for t in TRICKY]
    assert table.encode_batch(pa.array([], pa.string())).to_pylist() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t\r\x0b  ab1.,'é漢 ") | st.characters(codec="utf-8"), max_size=30), max_size=4))
def test_batch_equals_the_tokenizer_on_any_text(texts):
    table = tokens.WordTable(ENC.encode_ordinary, limit=3)
    assert table.encode_batch(pa.array(texts, pa.string())).to_pylist() == [ENC.encode_ordinary(t) for t in texts]


def test_slices_cover_a_batch():
    a = pa.array(["x" * 10, None, "y" * 100, "", "z"])
    assert list(tokens.slices(a, 20)) == [(0, 2), (2, 1), (3, 2)]
    assert list(tokens.slices(a.slice(0, 0))) == []


def test_corpus_round_trip(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TRICKY)] + [(None, "null id", "x"), (0, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = tokens.encode_corpus(docs)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"]) for r in got.collect())
    assert found == sorted((i if i is not None else -1, ENC.encode_ordinary(t or "")) for i, t, _ in rows)
    for most in (0, 3):  # words beyond the shared table
        few = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"]) for r in tokens.encode_corpus(docs, most=most).collect())
        assert few == found
    distinct = tokens.encode_corpus(docs.where("ids = 'clash'"))
    for decoded in (tokens.decode_corpus(distinct), tokens.decode_by_join(distinct, tokens.pieces_table(spark))):
        assert {r["doc_id"]: r["text"] for r in decoded.collect()} == {i: t or "" for i, t in enumerate(TRICKY)}
    assert tokens.encode_corpus(docs.limit(0)).count() == 0


def test_one_table_for_the_corpus_agrees(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_by_join(docs).collect()}
    assert got == {i: ENC.encode_ordinary(t or "") for i, t in enumerate(TRICKY)}
    words = {r["word"]: (r["n"], r["ids"]) for r in tokens.word_table(tokens.split_words(docs)).collect()}
    assert words[" word"] == (1999, ENC.encode_ordinary(" word"))
    assert tokens.encode_by_join(docs.limit(0)).count() == 0


def test_unknown_ids_decode_to_null(spark):
    df = spark.createDataFrame([(1, [99_999]), (2, []), (3, None), (4, [64, -1]), (5, [64])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(df).collect()}
    assert got == {1: None, 2: "", 3: "", 4: None, 5: ENC.decode([64])}
    assert tokens.decode_corpus(df.limit(0)).count() == 0
    joined = tokens.decode_by_join(df.where("doc_id in (1, 2)"), tokens.pieces_table(spark))
    assert {r["doc_id"]: r["text"] for r in joined.collect()} == {1: None, 2: ""}


def check(text: str, limit: int, overlap: int) -> list:
    parts = split.split_text(text, ENC, limit, overlap)
    ids = ENC.encode_ordinary(text)
    assert "".join(text[f:e] for _, f, e, _ in parts) == text
    flat = list(parts[0][3])
    for (_, _, _, a), (s, f, _, b) in zip(parts, parts[1:], strict=False):
        assert list(b[:overlap]) == list(a[-overlap:]) or len(a) < overlap
        assert s <= f
        flat += list(b[min(overlap, len(a)) :])
    assert flat == ids and all(len(p[3]) <= limit for p in parts)
    assert (len(parts) > 1) == (len(ids) > limit)
    return parts


def test_pieces_of_many_texts():
    sentence = "The board approved the plan of Rovan, and costs fell by 3.4 percent. "
    for text in (sentence * 200, (sentence * 5 + "\n\n") * 40, "x" * 9000, "漢字かな" * 900, "👷🏽‍♀️" * 500, " " * 4000 + "x", "\n" * 3000, "a b " * 3000):
        check(text, 1024, 64)
        check(text, 100, 10)
    assert split.split_text("", ENC)[0][:3] == (0, 0, 0)


def test_cuts_stand_at_natural_boundaries():
    paragraph = "Sentence one is here. Sentence two is there. " * 4
    text = "\n\n".join([paragraph] * 12)
    for _, _, e, _ in check(text, 120, 8)[:-1]:
        assert text[:e].endswith(("\n\n", ". ", "."))
    words = check("word " * 500, 100, 5)
    assert all(("word " * 500)[e - 1 : e + 1] in ("d ", " w") for _, _, e, _ in words[:-1])


def test_boundaries_in_the_first_half_of_the_room_count():
    prose = "Sentence one is here. Sentence two is there. " * 4
    for before in (prose.strip() + "\n\n", prose, "word " * 20):
        first = check(before + "x" * 9000, 100, 5)[0]
        assert len(before) - 1 <= first[2] <= len(before)
    section, paragraphs = "## One\n" + prose, "## Two\n" + (prose + "\n\n") * 8
    assert check(section + "\n" + paragraphs, 120, 5)[0][2] == len(section) + 1


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab .\n漢é") | st.characters(codec="utf-8"), min_size=50, max_size=400))
def test_any_text_is_covered(text):
    check(text, 30, 6)


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("ab .\n漢é🙂\U00020000") | st.characters(codec="utf-8"), max_size=300), st.sampled_from([0, 1, 7, 64]), st.integers(1, 9))
def test_any_limit_comes_to_an_end(text, overlap, more):
    limit, ids = overlap + more, ENC.encode_ordinary(text)
    parts = split.split_text(text, ENC, limit, overlap)
    assert "".join(text[f:e] for _, f, e, _ in parts) == text
    flat: list[int] = []
    for s, f, e, own in parts:
        assert s <= f <= e and (len(own) <= limit or len(parts) == 1)
        flat += list(own[min(overlap, len(flat)) :])
    assert flat == ids


def test_every_level_is_reached():
    para = "One went out. Two came in. "
    text = "\n\n".join(["# A\n" + para * 3, "# B\n" + (para * 4 + "\n\n") * 4, "# C\n" + (para + "\n") * 12, "# D\n" + para * 20, "# E\n" + "word " * 300, "# F\n" + "x" * 3000])
    ends = {e for _, _, e, _ in check(text, 60, 5)[:-1]}
    kinds = {"section": any(text[e:].startswith("# ") for e in ends), "paragraph": any(text[:e].endswith("\n\n") and text[e:].startswith("One") for e in ends), "line": any(text[:e].endswith("in. \n") and text[e:].startswith("One") for e in ends), "sentence": any(text[:e].endswith(".") for e in ends), "word": any(text[:e].endswith("word") for e in ends), "character": any(text[e - 1 : e + 1] == "xx" for e in ends)}
    assert all(kinds.values()), kinds


def test_small_parts_are_packed_together():
    text = "\n\n".join(f"# {i}\nA section of few words." for i in range(100))
    parts = check(text, 100, 10)
    assert all(len(own) > 75 for *_, own in parts[:-1]) and all(text[e:].startswith("#") for _, _, e, _ in parts[:-1])


def test_a_limit_must_exceed_the_overlap():
    with pytest.raises(ValueError):
        split.split_text("x", ENC, 10, 10)


def test_split_corpus(spark):
    rows = [(1, "word " * 1500, "c"), (2, "short", "c"), (3, None, "c"), (4, "", "c"), (5, "x" * 1025, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_pieces string")
    got = split.split_corpus(docs).collect()
    assert {r["doc_id"]: r["n_pieces"] for r in got} == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1}
    assert [r["doc_id"] for r in split.oversized(docs).collect()] == [1]
    assert split.oversized(docs.limit(0)).count() == 0


def test_found_against_the_tokenizer(spark, sf):
    docs = queries.table(spark, sf, "documents").select("doc_id", "text").collect()
    want = {r["doc_id"] for r in docs if r["text"] and len(ENC.encode_ordinary(r["text"])) > 1024}
    got = [r["doc_id"] for r in queries.p9_found(spark, sf).collect()]
    assert sorted(got) == sorted(want) and want
    ids = {r["doc_id"]: r["ids"] for r in queries.p7_ids(spark, sf).collect()}
    assert all(ids[r["doc_id"]] == ENC.encode_ordinary(r["text"] or "") for r in docs)
    assert queries.p7_ids(spark, sf).count() == len(docs)


def test_sizes_of_pieces():
    assert (split.piece_sizes(ENC)[ENC.encode_ordinary("hello wörld")].sum()) == len("hello wörld".encode())
    assert np.all(split.piece_sizes(ENC) > 0)

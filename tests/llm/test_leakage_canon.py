from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerloom.llm import canon, leakage, queries

WORDS = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(5)]


def leaks(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string, task string")
    return {(r["doc_id"], r["item_id"]): r["n_words"] for r in leakage.find_leaks(d, i, **options).collect()}


def passage(seed: int, n: int = 40) -> list[str]:
    return random.Random(seed).sample(WORDS, n)


def brute(item: list[str], doc: list[str], least: int = 20, edits: int = 3) -> bool:
    """Whether any window of the item is within the edits of any window of the document."""
    for s in range(len(item) - least + 1):
        w = item[s : s + least]
        # Sellers' algorithm: the best match of the whole window anywhere in the document
        row = list(range(least + 1))
        best = row[least]
        for x in doc:
            new = [0]
            for k in range(1, least + 1):
                new.append(min(row[k - 1] + (w[k - 1] != x), row[k] + 1, new[k - 1] + 1))
            row = new
            best = min(best, row[least])
        if best <= edits:
            return True
    return False


def test_forms_that_do_not_count():
    clean = "the net cost of rovan fell by 345 percent"
    for text in ("The  net cost of Rovan\nfell by 34.5 percent.", "<p>THE <b>net</b> cost</p> of ro​van, fell - by ３４.５ percent!", "The net cost\r\nPage 3 of 10\r\nof Rovan fell\n— 12 —\nby 34,5 per-\ncent", "“The net cost of ﻿Rovan” &amp; fell by 34.5 percent"):
        assert " ".join(leakage.words(text)) == clean


def test_edits_up_to_three(spark):
    p = passage(1)
    noise = [f"zz{i}" for i in range(30)]
    base = p[5:25]
    changed = base[:]
    changed[4], changed[9], changed[15] = "q1", "q2", "q3"
    four = changed[:]
    four[12] = "q4"
    docs = {1: base, 2: base[:19], 3: changed, 4: four, 5: base[:6] + ["new"] + base[6:12] + base[13:17] + ["x"] + base[17:], 6: base[:6] + noise[:4] + base[6:]}
    rows = [(k, " ".join(noise + d + noise), "x") for k, d in docs.items()]
    got = leaks(spark, rows, [(7, " ".join(p[5:25]), "t")])
    assert {k for k, _ in got} == {k for k, d in docs.items() if brute(base, noise + d + noise)}
    assert got[1, 7] == 20 and (3, 7) in got and (4, 7) not in got and (6, 7) not in got


def test_against_brute_force(spark):
    rng = random.Random(5)
    items = {i: passage(100 + i, 45) for i in range(4)}
    docs = {}
    for k in range(60):
        p = list(items[k % 4])
        s, n = rng.randint(0, 20), rng.randint(16, 25)
        part = p[s : s + n]
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(part))
            part[at : at + 1] = rng.choice([["chg"], [], [part[at], "add"]])
        docs[k] = rng.choices(WORDS, k=15) + part + rng.choices(WORDS, k=15)
    got = leaks(spark, [(k, " ".join(d), "x") for k, d in docs.items()], [(i, " ".join(p), "t") for i, p in items.items()])
    want = {(k, i) for k, d in docs.items() for i, p in items.items() if brute(p, d)}
    assert set(got) == want and 10 < len(want) < 60


def test_template_windows_join_and_slots_are_checked(spark):
    item = "the net fee of Rovan was cut by 345 percent after the review by the board of Sulimer in the month of May and by 17 percent in June as the court had asked"
    copy = item.replace("345", "712").replace("17", "29")
    rows = [(1, item, "x"), (2, copy, "x"), (3, item.replace("345", "712").replace("17", "29").replace("Rovan", "Belmi").replace("Sulimer", "Kestar"), "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = {r["doc_id"]: r.asDict() for r in leakage.find_leaks(d, spark.createDataFrame([(7, item, "t")], "item_id long, text string, task string")).collect()}
    # two changed numbers are two changed words: still a leak; four changed words over all, but not in every twenty
    assert set(got) == {1, 2, 3} and got[1]["n_words"] == got[2]["n_words"] == len(item.split())
    assert got[1]["n_changed"] == 0 and got[1]["n_slots"] >= got[2]["n_slots"] > got[2]["n_changed"] > 0
    index = leakage.ItemIndex([(7, item)])
    same = leakage.seed_hash(np.array([9, 8, 7, 6, 5]), np.array([0, 8, 7, 6, 2])), leakage.seed_hash(np.array([3, 8, 7, 6, 1]), np.array([0, 8, 7, 6, 2]))
    assert same[0] == same[1] and index.n_windows
    assert leakage.seed_hash(np.array([9, 8, 7, 6, 5]), np.array([0, 2, 7, 6, 2])) != leakage.seed_hash(np.array([3, 8, 7, 6, 5]), np.array([0, 2, 7, 6, 2]))


def test_parameters_that_would_miss_passages_are_refused(spark):
    with pytest.raises(ValueError):
        leaks(spark, [], [], least=18, edits=3)


def test_markup_and_furniture_of_any_length():
    tag = '<span class="' + "x" * 900 + '">'
    assert leakage.words(f"a {tag}b</span> c<div style='{'y' * 400}'>d") == ["a", "b", "c", "d"]
    for line in ("HAL 12", "hal 12", "Hal. 3 dari 9", "- 12 -", "-- 7 --", "PAGE 3 OF 10", "Page" + " " * 90 + "4", "Annual Report 2020 | 7", "12 | LAPORAN TAHUNAN 2020"):
        for text in (f"a\n{line}\nb", f"a b\n{line}", f"{line}\r\na b"):
            assert leakage.words(text) == ["a", "b"], (line, text)
    assert leakage.words("Page 3") == [] and leakage.words("see page 3") == ["see", "page", "3"]


def test_long_passages_need_long_windows(spark):
    p = ["".join(chr(97 + int(c)) for c in str(i)) for i in range(3000)]
    half = p[:1100] + ["zz"] * 20 + p[1120:2400]
    got = leaks(spark, [(1, " ".join(half), "x"), (2, " ".join(p[:1050]), "x")], [(5, " ".join(p), "t")], least=1200, edits=3)
    assert set(got) == {(1, 5)}


def test_reach_is_exact():
    a, b = list("abcdefgh"), list("abXcdfgh")
    assert leakage.reach([ord(c) for c in a], [ord(c) for c in b], 0, 0, 1) == [2, 4, 8, 8]


def test_nulls_long_texts_and_blocks(spark, monkeypatch):
    p, q = passage(1), passage(2)
    long = " ".join(["filler"] * 50_000 + p + ["filler"] * 50_000)
    rows = [(1, long, "x"), (1, long, "x"), (2, None, "x"), (3, "", "x"), (None, long, "x"), (4, " ".join(q), "x")]
    items = [(1, " ".join(p), "t"), (1, " ".join(p), "t"), (2, " ".join(q), "t"), (3, None, "t"), (4, "too short", "t"), (5, "", "t")]
    want = {(1, 1): 40, (4, 2): 40}
    assert leaks(spark, rows, items) == want
    monkeypatch.setattr(leakage, "BLOCK_WINDOWS", 1)
    assert leaks(spark, rows, items) == want
    assert leaks(spark, [], items) == {} and leaks(spark, rows, []) == {}


def test_templates(spark):
    item = "The board cut the fee of Rovanka by 34.5 percent after the review at Sulimer and the court of Rovanka agreed in the end"
    other = item.replace("Rovanka", "Belmira").replace("34.5", "71.2").replace("Sulimer", "Kestar")
    mixed = item.replace("Rovanka", "Belmira", 1)
    d = spark.createDataFrame([(1, other), (2, item), (3, mixed), (4, None)], "doc_id long, text string")
    i = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r["doc_id"] for r in leakage.find_templates(d, i).collect()}
    assert 1 in got and 2 not in got and 4 not in got


def templates(spark, docs, items):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {r["doc_id"]: (r["n_windows"], r["n_slots"], r["n_changed"]) for r in leakage.find_templates(d, i).collect()}


def test_new_names_in_any_case_fill_slots(spark):
    item = "The board cut the fee of Rovanka by 34.5 percent after the review at Sulimer and the court of Rovanka agreed in the end"
    copy = item.replace("Rovanka", "Belmira").replace("34.5", "71.2").replace("Sulimer", "Kestar")
    forms = {1: copy, 2: copy.upper(), 3: copy.lower(), 4: copy.replace("Belmira", "(Belmira)").replace("Kestar", '"Kestar"'), 5: copy.replace("Belmira", "BBCA").replace("Kestar", "eNd-x")}
    got = templates(spark, list(forms.items()), [(9, item)])
    assert set(got) == set(forms) and len(set(got.values())) == 1
    # names of the item in brackets are names as well; a verbatim part is no changed one, whatever follows it
    got = templates(spark, [(1, copy), (2, item.split(" at ")[0] + " at dawn on the coast")], [(9, item.replace("Rovanka", '("Rovanka")').replace("Sulimer", "(Sulimer)"))])
    assert set(got) == {1}


def test_slots_map_one_to_one_over_the_passage(spark):
    item = "The board cut the fee of Rovanka by 34.5 percent after the review at Sulimer and the court of Rovanka agreed in the end"
    copy = item.replace("Rovanka", "Belmira").replace("34.5", "71.2").replace("Sulimer", "Kestar")
    split = {2: item.replace("Rovanka", "Belmira", 1), 3: copy.replace("Belmira", "Dalgata", 1), 4: copy.replace("Kestar", "Belmira")}
    # an added word, or a fixed word changed, cuts the windows but not the passage
    long = "It paid 5 units of gas to the mill on the river in the spring of that year while the other plant was shut and sold 6 units of coal to the same mill on the hill in the autumn of that year"
    two = long.replace("6 units", "5 units")
    docs = {11: long.replace("5 ", "7 ").replace("6 ", "9 "), 12: long.replace("5 ", "7 ").replace("6 ", "7 "), 21: two.replace("5 ", "7 "), 22: two.replace("5 ", "7 ", 1).replace("5 ", "9 ")}
    docs |= {k + 100: t.replace("plant was", "big plant was") for k, t in docs.items()} | {k + 200: t.replace("plant", "depot") for k, t in docs.items()}
    got = templates(spark, [(1, copy), *split.items()], [(9, item)])
    assert set(got) == {1}
    assert {k for k in templates(spark, list(docs.items()), [(1, long)]) if k % 100 < 20} == {11, 111, 211}
    assert {k for k in templates(spark, list(docs.items()), [(1, two)]) if k % 100 > 20} == {21, 121, 221}
    # two copies with values of their own are two passages; a word added before a name is not its value
    filler = " ".join(f"zz{chr(97 + i)}" for i in range(20))
    assert set(templates(spark, [(1, f"{copy} {filler} {copy.replace('Belmira', 'Dalgata')}"), (2, copy.replace("of Belmira agreed", "of new Belmira agreed"))], [(9, item)])) == {1, 2}


def test_templates_find_items_with_other_values(spark, sf):
    rng, items = random.Random(1), [(r["item_id"], r["text"]) for r in queries.table(spark, sf, "eval_items").collect()]
    names, docs = leakage.ItemIndex(items).names, []
    for k, text in items:
        new: dict = {}
        out = []
        for token in leakage.canonical(text).split():
            f = leakage.fold(token)
            if f[:1].isdigit():
                token = new.setdefault(f, str(rng.randint(100, 99_999)))
            elif f in names:
                token = new.setdefault(f, "".join(rng.choices("bdfgklmnprstvz", k=9)))
            out.append(token)
        if new:
            docs.append((k, "before it " + " ".join(out) + " and after"))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_templates(d, i).collect()}
    assert sum((k, k) in got for k, _ in docs) >= 0.95 * len(docs) > 100


def test_found_holds_copies(spark, sf):
    got = {tuple(r) for r in queries.p8_found(spark, sf).collect()}
    texts = {r["doc_id"]: leakage.words(r["text"]) for r in queries.table(spark, sf, "documents").collect()}
    items = {r["item_id"]: leakage.words(r["text"]) for r in queries.table(spark, sf, "eval_items").collect()}
    for k, w in texts.items():
        runs = {tuple(w[j : j + 20]) for j in range(len(w) - 19)}
        for i, t in items.items():
            if any(tuple(t[j : j + 20]) in runs for j in range(len(t) - 19)):
                assert (k, i) in got
    assert all(brute(items[i], texts[k]) for k, i in got)


# --- mapping to the reference list -----------------------------------------------------


def test_distance_is_levenshtein():
    rng = random.Random(2)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(400):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(2))
        assert canon.distance(a, b) == plain(a, b)


def test_tree_returns_every_entry_within_the_radius():
    rng = random.Random(4)
    entries = ["".join(rng.choices("abcd", k=rng.randint(3, 9))) for _ in range(300)]
    tree = canon.BKTree(entries)
    for q in ["".join(rng.choices("abcd", k=6)) for _ in range(60)]:
        for r in (0, 1, 3):
            assert sorted(tree.within(q, r)) == sorted((d, e) for e in set(entries) if (d := canon.distance(q, e)) <= r)
    assert canon.BKTree([]).within("x", 3) == []


TERMS = [(1, "label", "Cash and cash equivalents", "Kas dan setara kas"), (2, "label", "Total assets", "Jumlah aset"), (3, "label", "Goodwill", None), (4, "report_period", "Q2", "Triwulan II"), (5, "report_period", "Audit", "Tahunan"), (6, "key", "Ticker symbol", "Kode saham")]


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame([*TERMS, TERMS[0], (7, "label", None, None)], "term_id long, field_name string, term string, alt_term string")


CASES = [
    ("label", "Cash and cash equivalents", 1, "letter"), ("label", "KAS & SETARA KAS (Note 12)", 1, "matched"), ("label", "assets, Total", 2, "matched"), ("label", "1.2 T0tal asset5 *)", 2, "matched"), ("label", "jumlah aktiva", 2, "matched"), ("label", "Jumlah aset / Total assets", 2, "matched"),
    ("label", "Ｇｏｏｄｗｉｌｌ", 3, "matched"), ("label", "Total access points", None, "unmatched"), ("label", " ", None, "empty"), ("label", None, None, "empty"), ("report_period", "six months", 4, "matched"), ("report_period", "per 31 Desember", 5, "matched"), ("report_period", "FY.", 5, "matched"),
    ("report_period", "Q7", None, "unmatched"), ("key", "Kode asham", 6, "matched"), ("key", "Kode parkir", None, "unmatched"), ("other", "x", None, "unmatched"), ("label", "x" * 20_000, None, "unmatched"),
]


def test_matches(spark, terms):
    rows = [(f, i, v, "clash") for i, (f, v, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "field_name string, row_id long, value string, term string")
    got = {r["row_id"]: (r["term_id"], r["how"]) for r in canon.match_values(df, terms).collect()}
    assert got == {i: (k, how) for i, (_, _, k, how) in enumerate(CASES)}
    assert canon.match_values(df.limit(0), terms).count() == 0
    assert {r["how"] for r in canon.match_values(df, terms.limit(0)).collect()} == {"unmatched", "empty"}


def test_large_reference_agrees(spark, terms):
    rows = [(f, v) for f, v, _, _ in CASES if v and v.strip()] * 2
    df = spark.createDataFrame(rows, "field_name string, value string")
    got = {(r["field_name"], r["value"]): r["term_id"] for r in canon.match_large(df, terms, shards=5).collect()}
    assert got == {(f, v): k for f, v, k, _ in CASES if v and v.strip()}


@pytest.mark.parametrize("shards", [1, 7, 64])
def test_large_reference_agrees_however_it_is_cut(spark, shards):
    rng = random.Random(8)
    stems = [["Trade", "Other", "Current", "Deferred"], ["tax", "lease", "loan"], ["receivables", "liabilities", "payables"], ["affiliate", "third party", "non-current", "related party", ""]]
    names = ["Trade receivables", "Trade receivables affiliate", "Interest income of government bonds", "Interest income of government loans"] + sorted({" ".join(rng.choice(s) for s in stems).strip() for _ in range(40)})
    rows = [(k, "label", t, None) for k, t in enumerate(names, 1)] + [(90, "label", "trade  RECEIVABLES", "Piutang usaha"), (91, "label", names[5], "Piutang lain"), (92, "label", "x", "Beban A"), (92, "label", "x", "Beban B yang lain"), (93, "report_period", "Q2", None)]
    terms = spark.createDataFrame(rows, "term_id long, field_name string, term string, alt_term string")
    values = ["Trade receivable", "Interest income of gove", "Beban A", "trade  RECEIVABLES", *names, *(t.upper() for t in names[:9])]
    for t in names:
        cut = t[: rng.randint(len(t) // 2, len(t))]
        at = rng.randrange(len(cut))
        values += [cut, cut[:at] + rng.choice("xyz") + cut[at + 1 :]]
    df = spark.createDataFrame([("label", i, v) for i, v in enumerate(values)] + [("report_period", 999, "six months")], "field_name string, row_id long, value string")
    want = {(r["field_name"], r["value"]): (r["term_id"], r["share"]) for r in canon.match_values(df, terms).collect()}
    assert want["label", "Trade receivable"][0] == 1 and want["label", "Interest income of gove"][0] is None
    assert {(r["field_name"], r["value"]): (r["term_id"], r["share"]) for r in canon.match_large(df, terms, shards=shards).collect()} == want


def test_a_reference_too_large_for_tasks_is_sharded(spark, terms, monkeypatch):
    rows = [(f, i, v) for i, (f, v, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "field_name string, row_id long, value string")
    monkeypatch.setattr(canon, "MOST_ENTRIES", 3)
    assert canon.reference_rows(terms) is None
    got = {r["row_id"]: (r["term_id"], r["how"]) for r in canon.match_values(df, terms).collect()}
    assert got == {i: (k, how) for i, (_, _, k, how) in enumerate(CASES)}


def test_many_values_are_found_as_one_by_one(monkeypatch):
    rng = random.Random(5)
    words = ["total", "current", "assets", "receivables", "perusahaan", "penghasilan", "komprehensif", "tax", "é", "utang", "jangka", "panjang"]
    terms = [(k, " ".join(rng.choices(words, k=rng.randint(1, 9))), None if k % 3 else " ".join(rng.choices(words, k=2))) for k in range(80)]
    values = []
    for _, t, _ in terms * 3:
        x = list(t[: rng.randint(1, len(t))] if rng.random() < 0.3 else t)
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(len(x))] = rng.choice("abcxyz ")
        values.append("".join(x))
    for shard in (5_000, 7):
        monkeypatch.setattr(canon, "SHARD", shard)
        m = canon.Matcher(False).build(terms)
        assert m.find_many([*values, ""]) == [m.find(v) for v in [*values, ""]]
        trees = [canon.BatchTree(canon.BKTree(sorted({v for v in values if v})))]
        texts = sorted({v[:64] for v in values if v})[:60]
        q, d, node = trees[0].within(texts, np.full(len(texts), 9))
        assert set(zip(q.tolist(), d.tolist(), node.tolist())) == {(i, n, j) for i, a in enumerate(texts) for j, e in enumerate(trees[0].entries) if (n := canon.distance(a, e)) <= 9}


def test_columns_of_the_stated_queries(spark, sf):
    want = {"p6_found": [("field_name", "string"), ("row_id", "bigint"), ("term_id", "bigint")], "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p8_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p9_found": [("doc_id", "bigint")]}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, sf).dtypes == columns


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() >= 0

"""Statement files whose sheets and fields drift from delivery to delivery.

Three steps, each a DataFrame:

* ``fingerprints``: one pass over the bodies gives each file a compact schema
  (sheets, fields in order of first appearance, types, labels) and its hash.
* ``schema_changes``: each file against the one before it in its feed. Files of
  an unchanged fingerprint drop out before any comparison.
* ``migrations``: for each file, the chain of rename steps after it folded into one
  map from its names to the feed's latest.
* ``consistent_items``: every item under its feed's latest names and types: each file
  meets its map, then rename, cast and default rules apply.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.sequence import with_previous

#: Precedence where equally many values of a field are of two types.
_TYPES = ("number", "string", "boolean")


def _type(v: object) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    return "number" if isinstance(v, int | float) else "string"


def parse_statement(body: str | None) -> dict | None:
    """The statement object in ``body``; None for anything else."""
    try:
        got = json.loads(body.lstrip("﻿")) if body else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def sheets_of(statement: dict) -> Iterator[tuple[int, dict]]:
    sheets = statement.get("sheets")
    for at, sheet in enumerate(sheets if isinstance(sheets, list) else [sheets]):
        if isinstance(sheet, dict):
            yield at, sheet


def items_of(sheet: dict) -> Iterator[tuple[int, dict]]:
    items = sheet.get("items")
    for at, item in enumerate(items if isinstance(items, list) else [items]):
        if isinstance(item, dict):
            yield at, item


def describe(body: str | None) -> list | None:
    """[[sheet, position, [[field, type], ...], [label, ...]], ...] of a body.

    Sheets of one name count as one, at the first's position; a sheet without a
    name is called ''. A field with only nulls has the type None."""
    statement = parse_statement(body)
    if statement is None:
        return None
    out: dict[str, list] = {}
    for at, sheet in sheets_of(statement):
        name = sheet.get("name")
        mine = out.setdefault(name if isinstance(name, str) else "", [at, {}, {}])
        for _, item in items_of(sheet):
            label = item.get("label")
            if isinstance(label, str) and label.strip():
                mine[2][" ".join(label.casefold().split())] = None
            values = item.get("values")
            for field, v in values.items() if isinstance(values, dict) else ():
                mine[1].setdefault(field, Counter())[_type(v)] += 1
    return [
        [name, at, [[f, max(_TYPES, key=lambda t: (c[t], -_TYPES.index(t))) if any(c[t] for t in _TYPES) else None] for f, c in fields.items()], list(labels)]
        for name, (at, fields, labels) in out.items()
    ]


def _alike(a: list, b: list) -> bool:
    """Mostly the same labels: more than half of the larger set."""
    x, y = set(a[3]), set(b[3])
    return bool(x and y) and 2 * len(x & y) > max(len(x), len(y))


def compare(old: list, new: list) -> list[tuple[str, str, str, str]]:
    """(sheet, field, change, former name or type) from one schema to the next."""
    was, now = {s[0]: s for s in old}, {s[0]: s for s in new}
    gone, come = [s for s in old if s[0] not in now], [s for s in new if s[0] not in was]
    pairs, out = [(was[n], s) for n, s in now.items() if n in was], []
    for s in come:
        match = next((g for g in gone if g[1] == s[1] and _alike(g, s)), None)
        if match:
            gone.remove(match)
            pairs.append((match, s))
            out.append((s[0], "", "renamed", match[0]))
        else:
            out.append((s[0], "", "added", ""))
    out += [(g[0], "", "removed", "") for g in gone]
    for a, b in pairs:
        before, after = {f: (i, t) for i, (f, t) in enumerate(a[2])}, {f: (i, t) for i, (f, t) in enumerate(b[2])}
        places = {i: (f, t) for f, (i, t) in before.items() if f not in after}
        for f, (i, t) in after.items():
            if f in before:
                if t and before[f][1] and t != before[f][1]:
                    out.append((b[0], f, "retyped", before[f][1]))
            elif i in places and (places[i][1] == t or not places[i][1] or not t):
                out.append((b[0], f, "renamed", places.pop(i)[0]))
            else:
                out.append((b[0], f, "added", ""))
        out += [(b[0], f, "removed", "") for f, _ in places.values()]
    return out


def fingerprints(df: DataFrame, file_id: str = "file_id", feed: str = "feed_id", at: str = "delivered_at", body: str = "body") -> DataFrame:
    """One row a file: ``file_id``, ``feed_id``, ``delivered_at``, ``schema`` (JSON)
    and ``fingerprint`` (of names and types in order, without labels).

    Rows sent again count once. Files without a feed or whose body is no complete
    JSON object have no schema and are left out, so the next file is compared with
    the last one that could be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for f, g, t, x in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (d := describe(x)) is not None:
                    bare = json.dumps([s[:3] for s in d], ensure_ascii=False)
                    rows.append((f, g, t, json.dumps(d, ensure_ascii=False), hashlib.blake2b(bare.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [b.schema.field(0).type, b.schema.field(1).type, b.schema.field(2).type, pa.string(), pa.string()], strict=True)],
                ["file_id", "feed_id", "delivered_at", "schema", "fingerprint"],
            )

    src = df.where(F.col(feed).isNotNull()).select(F.col(file_id).alias("file_id"), F.col(feed).alias("feed_id"), F.col(at).alias("delivered_at"), F.col(body).alias("body"))
    kinds = dict(src.dtypes)
    parsed = src.mapInArrow(run, f"file_id {kinds['file_id']}, feed_id {kinds['feed_id']}, delivered_at {kinds['delivered_at']}, schema string, fingerprint string")
    return (
        parsed.groupBy("file_id").agg(F.max(F.struct("delivered_at", "feed_id", "schema", "fingerprint")).alias("r")).select("file_id", "r.feed_id", "r.delivered_at", "r.schema", "r.fingerprint")
    )


def schema_changes(prints: DataFrame) -> DataFrame:
    """``feed_id``, ``file_id``, ``delivered_at``, ``sheet_name``, ``field``,
    ``change`` and ``former`` (old name or type) of each file against the one before
    it in its feed; the first file of a feed gives no rows. At equal delivery times
    the smaller file id is the earlier."""
    chained = with_previous(prints, ["feed_id"], ["delivered_at", "file_id"], F.date_trunc("month", "delivered_at"), F.struct("schema", "fingerprint"), "p")
    moved = chained.where(F.col("p").isNotNull() & (F.col("p.fingerprint") != F.col("fingerprint"))).select("feed_id", "file_id", "delivered_at", F.col("p.schema").alias("old"), F.col("schema").alias("new"))
    kinds = dict(moved.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*head, *c) for *head, o, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True) for c in compare(json.loads(o), json.loads(n))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [b.schema.field(i).type for i in range(3)] + [pa.string()] * 4, strict=True)],
                ["feed_id", "file_id", "delivered_at", "sheet_name", "field", "change", "former"],
            )

    return moved.mapInArrow(run, f"feed_id {kinds['feed_id']}, file_id {kinds['file_id']}, delivered_at {kinds['delivered_at']}, sheet_name string, field string, change string, former string")


def compose(old: list, new: list, names: dict) -> dict:
    """The map of the file before: ``names`` maps the newer schema's (sheet, field) to
    (latest name, rules); field None stands for the sheet. Removed names keep theirs."""
    renamed: dict = {}
    for sheet, field, change, former in compare(old, new):
        if change == "renamed":
            renamed[(former, None) if not field else (sheet, former)] = (sheet, field or None)
    out: dict = {}
    for sheet, _, fields, _ in old:
        moved = renamed.get((sheet, None))
        here = moved[0] if moved else sheet
        last, rules = names.get((here, None), (here, ()))
        out[sheet, None] = last, (("rename sheet", *rules) if moved else rules)
        for field, _ in fields:
            other = renamed.get((here, field))
            name, rules = names.get((here, other[1] if other else field), (other[1] if other else field, ()))
            out[sheet, field] = name, (("rename field", *rules) if other else rules)
    return out


def _identity(schema: list) -> dict:
    return {(s, None): (s, ()) for s, *_ in schema} | {(s, f): (f, ()) for s, _, fields, _ in schema for f, _ in fields}


def migrations(prints: DataFrame) -> DataFrame:
    """``file_id``, ``names`` and ``final`` (JSON): the map of each file's names to its
    feed's latest, and the latest schema.

    A feed's fingerprints, not its bodies, stream by from the latest back, the map
    growing by one step wherever two neighbours differ; only one schema and one map are
    held, however long the feed."""
    kinds = dict(prints.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feed, newer, mark, names, final, text = None, None, None, {}, "", ""
        for b in batches:
            rows = []
            for file, g, schema, fingerprint in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if g != feed or newer is None:
                    feed, newer = g, json.loads(schema)
                    names, final = _identity(newer), json.dumps([[s, fields] for s, _, fields, _ in newer], ensure_ascii=False)
                    text = ""
                elif fingerprint != mark:
                    older = json.loads(schema)
                    names, newer, text = compose(older, newer, names), older, ""
                else:
                    newer = json.loads(schema)  # the same names and types; labels may differ
                mark = fingerprint
                text = text or json.dumps([[s, f, n, r] for (s, f), (n, r) in names.items()], ensure_ascii=False)
                rows.append((file, text, final))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [b.schema.field(0).type, pa.string(), pa.string()], strict=True)], ["file_id", "names", "final"])

    back = prints.repartition("feed_id").sortWithinPartitions("feed_id", F.desc_nulls_last("delivered_at"), F.desc("file_id"))
    return back.select("file_id", "feed_id", "schema", "fingerprint").mapInArrow(run, f"file_id {kinds['file_id']}, names string, final string")


@lru_cache(maxsize=2_000)
def _rules(names: str, final: str) -> tuple[dict, dict, dict]:
    """(map of names, type of each final (sheet, field), fields of each final sheet)."""
    types = {(s, f): t for s, fs in json.loads(final) for f, t in fs}
    wanted: dict[str, list[str]] = {}
    for s, f in types:
        wanted.setdefault(s, []).append(f)
    return {(s, f): (n, r) for s, f, n, r in json.loads(names)}, types, wanted


def cast(v: object, kind: str | None) -> tuple[float | None, str | None, bool | None, str | None]:
    """(number, text, flag, rule applied) of a value in a field of type ``kind``."""
    number = text = flag = rule = None
    if isinstance(v, bool):
        flag, text, number = v, str(v).lower(), float(v) if kind == "number" else None
    elif isinstance(v, int | float):
        number, text = float(v), json.dumps(v)
    elif v is not None:
        text = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if v is not None and kind and _type(v) != kind:
        rule = f"cast {kind}"
        if kind == "boolean" and text and text.casefold() in ("ya", "yes", "true", "y", "1", "tidak", "no", "false", "n", "0"):
            flag = text.casefold() in ("ya", "yes", "true", "y", "1")
        elif kind == "number" and number is None:
            try:
                number = float(text.replace(",", ""))
            except (ValueError, AttributeError):
                rule = "cast number: unreadable"
    return number, text, flag, rule


def migrate(sheet: str, values: dict, names: dict, types: dict, wanted: dict) -> Iterator[tuple]:
    """(sheet, field, type, number, text, flag, rules) of an item's values under their
    latest names and types, and of the fields it lacks."""
    here, sheet_rules = names.get((sheet, None), (sheet, ()))
    have = set()
    for f, v in values.items():
        field, rules = names.get((sheet, f), (f, ()))
        kind = types.get((here, field))
        number, text, flag, rule = cast(v, kind)
        have.add(field)
        yield here, field, kind, number, text, flag, (*sheet_rules, *rules, *((rule,) if rule else ()))
    for field in wanted.get(here, ()):
        if field not in have:
            yield here, field, types[here, field], None, None, None, ("default",)


def consistent_items(df: DataFrame, file_id: str = "file_id", feed: str = "feed_id", at: str = "delivered_at", body: str = "body") -> DataFrame:
    """The line items of all files of a feed as one long table under its latest schema.

    One row per (file, item, field) with ``sheet_name`` and ``field`` as the feed
    calls them now, ``type`` and the value as ``number``, ``text`` and ``flag``;
    ``rules`` lists the rename, cast and default rules applied to it. Fields the
    latest schema has and an item lacks come as null under the rule "default"; a
    field removed for good keeps its last name and has no type. Each file is joined
    with its own map (``migrations``), so a hot feed's bodies stay spread. Bodies that
    can't be read have no rows here; ``unreadable_statements`` lists them."""
    maps = migrations(fingerprints(df, file_id, feed, at, body))
    src = (
        df.where(F.col(feed).isNotNull())
        .groupBy(F.col(file_id).alias("file_id"))
        .agg(F.max(F.struct(F.col(at).alias("delivered_at"), F.col(feed).alias("feed_id"), F.col(body).alias("body"))).alias("r"))
        .select("file_id", "r.feed_id", "r.body")
    )
    joined = src.join(maps, "file_id").select("file_id", "feed_id", "body", "names", "final")
    kinds = dict(joined.dtypes)
    fields = [("sheet_name", pa.string()), ("item_no", pa.int32()), ("label", pa.string()), ("field", pa.string()), ("type", pa.string()), ("number", pa.float64()), ("text", pa.string()), ("flag", pa.bool_()), ("rules", pa.list_(pa.string()))]

    def batch(rows: list[tuple], b: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 11
        known: dict[tuple, int] = {}  # few lists of rules are different
        which = pa.array([known.setdefault(r, len(known)) for r in cols[-1]], pa.int32())
        arrays = [pa.array(c, t) for c, t in zip(cols[:-1], [b.schema.field(0).type, b.schema.field(1).type, *[t for _, t in fields[:-1]]], strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(list(map(list, known)), fields[-1][1]).take(which)], ["file_id", "feed_id", *[n for n, _ in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for f, g, x, texts, final in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                statement = parse_statement(x)
                rules = _rules(texts, final)
                for _, sheet in sheets_of(statement):
                    name = sheet.get("name") if isinstance(sheet.get("name"), str) else ""
                    for n, item in items_of(sheet):
                        values = item.get("values") if isinstance(item.get("values"), dict) else {}
                        label = item.get("label") if isinstance(item.get("label"), str) else None
                        rows += [(f, g, r[0], n, label, *r[1:]) for r in migrate(name, values, *rules)]
                if len(rows) > 20_000:
                    yield batch(rows, b)
                    rows = []
            yield batch(rows, b)

    return joined.mapInArrow(run, f"file_id {kinds['file_id']}, feed_id {kinds['feed_id']}, sheet_name string, item_no int, label string, field string, type string, number double, text string, flag boolean, rules array<string>")


def unreadable_statements(df: DataFrame, file_id: str = "file_id", feed: str = "feed_id", body: str = "body") -> DataFrame:
    """``file_id`` and ``reason`` of the files that no table of this module holds: "no
    feed", or "no statement" for a body that is no complete JSON object. Rows sent again
    count once; a file counts if none of its rows can be read."""
    src = df.select(F.col(file_id).alias("file_id"), F.col(feed).isNull().alias("lost"), F.col(body).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            why = ["no feed" if lost else "no statement" if parse_statement(x) is None else None for lost, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(why, pa.string())], ["file_id", "reason"])

    told = src.mapInArrow(run, f"file_id {dict(src.dtypes)['file_id']}, reason string")
    return told.groupBy("file_id").agg(F.count_if(F.col("reason").isNull()).alias("n"), F.max("reason").alias("reason")).where(F.col("n") == 0).drop("n")

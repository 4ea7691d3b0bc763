"""Nested JSON records as flat tables that keep parent and position.

A bottom-up tree automaton reads every body. Leaves are in the states null, bool,
num or str. An array's state is the set of its elements' states. An object whose
members are all scalars, or all in one state, is a dictionary: its state is the set of
its members' states, whatever their names (years, say). Any other object is a record
of its members with their states. Nulls tell nothing and are left out everywhere, as
are missing members.

A level of the record (``Level``) says under which member its objects stand, and which
members its supertype has in which states. An object of a level is classified by where
it departs from the supertype: optional members that are absent or null don't count,
members in another state and members of its own do. That is its *variant*; every
variant is a typed subtype table (``variant_table``) with the supertype's keys: parent
id and the positions on the way down.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Level:
    """Objects under ``outer`` (kind ``outer_kind``) and under ``inner`` of each, with
    the supertype of each kind: (member, state) pairs."""

    outer: str
    inner: str
    outer_kind: str
    inner_kind: str
    outer_members: tuple[tuple[str, str], ...] = ()
    inner_members: tuple[tuple[str, str], ...] = ()

    def supertype(self, kind: str) -> dict[str, str]:
        return dict(self.outer_members if kind == self.outer_kind else self.inner_members)


STATEMENT = Level("sheets", "items", "sheet", "item", (("name", "str"),), (("label", "str"), ("values", "<num>")))
RESPONSE = Level(
    "Results", "Attachments", "result", "attachment", (),
    (("File_Name", "str"), ("File_Path", "str"), ("File_Type", "str"), ("File_Size", "num"), ("Emiten_Code", "str"), ("Report_Period", "str"), ("Report_Year", "str")),
)


def _no_constant(x: str) -> float:
    raise ValueError(x)


def unwrap(body: str | None) -> object:
    """The JSON value in ``body`` after undoing byte order marks, outer white space
    and encodings of JSON as a JSON string, however often; raises ValueError when
    incomplete. Each unwrapping takes two quotes away, so there is an end."""
    x: object = body
    while isinstance(x, str):
        x = json.loads(x.strip().lstrip("﻿").strip(), parse_constant=_no_constant)
    return x


_SCALARS = {type(None): "null", bool: "bool", int: "num", float: "num", str: "str"}


def _list_state(states: set[str]) -> str:
    return "[" + "|".join(sorted(states - {"null"})) + "]"


def _object_state(members: dict[str, str]) -> str:
    told = {m: s for m, s in members.items() if s != "null"}
    states = set(told.values())
    if len(states) < 2 or states <= {"bool", "num", "str"}:
        return "<" + "|".join(sorted(states)) + ">"
    return "{" + ",".join(f"{json.dumps(m)}:{s}" for m, s in sorted(told.items())) + "}"


def state(x: object) -> str:
    """The automaton's state of a value, from its children's states, at any depth."""
    leaf = _SCALARS.get(type(x))
    if leaf:
        return leaf
    stack: list[tuple[bool, Iterator, object]] = []
    node, result = x, None
    while True:
        if node is not None:  # go down
            kids = iter(node.items()) if isinstance(node, dict) else iter(enumerate(node))
            stack.append((isinstance(node, dict), kids, {} if isinstance(node, dict) else set(), [None]))
            node = None
        record, kids, got, at = stack[-1]
        if result is not None:  # come up
            if record:
                got[at[0]] = result
            else:
                got.add(result)
            result = None
        for k, v in kids:
            leaf = _SCALARS.get(type(v))
            if leaf is None:
                at[0], node = k, v
                break
            if record:
                got[k] = leaf
            else:
                got.add(leaf)
        else:
            stack.pop()
            result = _object_state(got) if record else _list_state(got)
            if not stack:
                return result


#: States that say nothing of their elements: they conform to any of their kind.
_EMPTY = {"[]": "[", "<>": "<{"}


def departures(obj: dict, supertype: dict[str, str], nested: str | None) -> tuple[tuple[str, str], ...]:
    """(member, state) of an object wherever it departs from its supertype, by name.
    The member that holds the level below is classified there."""
    out = []
    for m, v in obj.items():
        if v is None or m == nested:
            continue
        s = _SCALARS.get(type(v)) or state(v)
        want = supertype.get(m)
        if s != want and not (s in _EMPTY and (want is None or want[0] in _EMPTY[s])):
            out.append((m, s))
    return tuple(sorted(out))


def variant_name(kind: str, away: tuple[tuple[str, str], ...]) -> str:
    """The kind alone for objects of the supertype; else with the departures as JSON."""
    return kind + (json.dumps(dict(away), ensure_ascii=False, separators=(",", ":")) if away else "")


def _members(x: object) -> Iterator[tuple[int, dict]]:
    """Objects of a list with their places; a single object stands at place 0."""
    for at, y in enumerate(x if isinstance(x, list) else [x]):
        if isinstance(y, dict):
            yield at, y


def read_body(body: str | None) -> tuple[dict | None, str]:
    """(the record in a body, "") or (None, why there is none)."""
    if body is None:
        return None, "null"
    if not body.strip("﻿ \t\r\n"):
        return None, "empty"
    try:
        root = unwrap(body)
    except (ValueError, RecursionError):
        return None, "no complete JSON"
    return (root, "") if isinstance(root, dict) else (None, "no object")


def nodes(body: str | None, level: Level) -> Iterator[tuple[str, int, int, dict]]:
    """(kind, outer_no, inner_no, object) of a body; inner_no is -1 for outer
    objects. Nulls and scalars keep their place in a list but are not listed."""
    root, _ = read_body(body)
    if root is None:
        return
    for i, outer in _members(root.get(level.outer)):
        yield level.outer_kind, i, -1, outer
        for j, inner in _members(outer.get(level.inner)):
            yield level.inner_kind, i, j, inner


def flatten(df: DataFrame, key: str, body: str, level: Level, kinds: tuple[str, ...] = (), payload: bool = True) -> DataFrame:
    """``parent_id``, ``kind``, ``outer_no``, ``inner_no``, ``variant``, ``members``.

    Every object is classified by the automaton and so routed to its variant.
    ``members`` holds the object's own members as JSON, without those that are
    levels of their own. Rows sent again count once: the same key, place and content
    come out once. A null, empty, cut off or non-JSON body has no rows here
    (``unreadable`` lists it), and rows with a null key keep it. ``kinds`` keeps only
    some levels, ``payload=False`` leaves ``members`` out."""
    wanted, nested = set(kinds or (level.outer_kind, level.inner_kind)), {level.outer_kind: level.inner}
    src = df.select(F.col(key).alias("parent_id"), F.col(body).alias("body"))
    kind = dict(src.dtypes)["parent_id"]
    names = ["parent_id", "kind", "outer_no", "inner_no", "variant", *(["members"] if payload else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        supertypes, known = {k: level.supertype(k) for k in wanted}, {}
        for b in batches:
            rows = []
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for what, i, j, obj in nodes(x, level):
                    if what not in wanted:
                        continue
                    away = departures(obj, supertypes[what], nested.get(what))
                    variant = known.get((what, away))
                    if variant is None:
                        variant = variant_name(what, away)
                        if len(known) < 10_000:
                            known[what, away] = variant
                    if payload:
                        rows.append((k, what, i, j, variant, json.dumps({m: v for m, v in obj.items() if m != nested.get(what)}, ensure_ascii=False)))
                    else:
                        rows.append((k, what, i, j, variant))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            types = [b.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names)

    schema = f"parent_id {kind}, kind string, outer_no int, inner_no int, variant string" + (", members string" if payload else "")
    return src.mapInArrow(run, schema).distinct()


def unreadable(df: DataFrame, key: str, body: str) -> DataFrame:
    """``parent_id`` and ``reason`` of the bodies that hold no record: "null", "empty",
    "no complete JSON" or "no object". Rows sent again count once."""
    src = df.select(F.col(key).alias("parent_id"), F.col(body).alias("body"))
    kind = dict(src.dtypes)["parent_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            why = pa.array([read_body(x)[1] for x in b.column(1).to_pylist()], pa.string())
            got = pa.RecordBatch.from_arrays([b.column(0), why], ["parent_id", "reason"])
            yield got.filter(pa.array([w != "" for w in why.to_pylist()], pa.bool_()))

    return src.mapInArrow(run, f"parent_id {kind}, reason string").distinct()


def variant_tables(flat: DataFrame) -> DataFrame:
    """The variants that occur and how many objects each holds: ``kind``, ``variant``,
    ``n_objects``. Counts combine map-side."""
    return flat.groupBy("kind", "variant").agg(F.count(F.lit(1)).alias("n_objects"))


def subtype_table(flat: DataFrame, kind: str, schema: str) -> DataFrame:
    """One level as typed columns beside the common keys; members of another type
    than declared come out null, members not declared stay in ``members``."""
    parsed = F.from_json("members", schema)
    return flat.where(F.col("kind") == kind).select("parent_id", "outer_no", "inner_no", "variant", parsed.alias("_m"), "members").select("parent_id", "outer_no", "inner_no", "variant", "_m.*", "members")


def _type_at(s: str, at: int) -> tuple[str, int]:
    """(Spark type, end) of the state that starts at ``at``."""
    for name, kind in (("bool", "boolean"), ("num", "double"), ("str", "string")):
        if s.startswith(name, at):
            return kind, at + len(name)
    close, parts, at = {"[": "]", "<": ">", "{": "}"}[s[at]], [], at + 1
    while s[at] != close:
        if close == "}":
            key, at = json.JSONDecoder().raw_decode(s, at)
            kind, at = _type_at(s, at + 1)
            parts.append(f"`{key.replace('`', '``')}`:{kind}")
        else:
            kind, at = _type_at(s, at)
            parts.append(kind)
        at += s[at] in ",|"
    if close == "}":
        return f"struct<{','.join(parts)}>", at + 1
    one = parts[0] if len(parts) == 1 else "string"  # elements in several states stay text
    return (f"array<{one}>" if close == "]" else f"map<string,{one}>"), at + 1


def spark_type(s: str) -> str:
    """The Spark type of values in a state."""
    return _type_at(s, 0)[0]


def variant_members(variant: str, level: Level) -> tuple[str, dict[str, str]]:
    """(kind, member to state) of a variant: the supertype's members, with the
    departures in their place."""
    kind, brace, rest = variant.partition("{")
    return kind, level.supertype(kind) | (json.loads(brace + rest) if brace else {})


def variant_table(flat: DataFrame, variant: str, level: Level) -> DataFrame:
    """One structural variant as a table of its own: the supertype's keys and a column
    of its own type for each member. Members named like a key, or alike but for letter
    case, stay in ``members`` only."""
    kind, states = variant_members(variant, level)
    rows = flat.where((F.col("kind") == kind) & (F.col("variant") == variant))
    clash = {"parent_id", "outer_no", "inner_no", "members"}
    keep = [m for m in states if m.lower() not in clash and sum(o.lower() == m.lower() for o in states) == 1]
    schema = ",".join(f"`{m.replace('`', '``')}`:{spark_type(states[m])}" for m in keep)
    parsed = rows.select("parent_id", "outer_no", "inner_no", (F.from_json("members", f"struct<{schema}>") if keep else F.lit(None)).alias("_m"), "members")
    return parsed.select("parent_id", "outer_no", "inner_no", *[F.col("_m").getField(m).alias(m) for m in keep], "members")


def leaves(df: DataFrame, key: str, body: str, level: Level, member: str) -> DataFrame:
    """The scalars of an inner object's ``member`` object, one a row, under the keys of
    their parents: ``parent_id``, ``outer_no``, ``inner_no``, ``name``, ``type`` (the
    automaton's state), ``text``, ``number`` and ``flag``. Rows sent again count once."""
    src = df.select(F.col(key).alias("parent_id"), F.col(body).alias("body"))
    kind = dict(src.dtypes)["parent_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for what, i, j, obj in nodes(x, level):
                    held = obj.get(member) if what == level.inner_kind else None
                    for name, v in held.items() if isinstance(held, dict) else ():
                        t = state(v)
                        text = v if isinstance(v, str) else None if v is None else json.dumps(v, ensure_ascii=False)
                        rows.append((k, i, j, name, t, text, float(v) if t == "num" else None, v if t == "bool" else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["parent_id", "outer_no", "inner_no", "name", "type", "text", "number", "flag"])

    return src.mapInArrow(run, f"parent_id {kind}, outer_no int, inner_no int, name string, type string, text string, number double, flag boolean").distinct()

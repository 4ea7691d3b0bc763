"""Quantities of facts in common units, decoded along each device's series.

A device is a (company, concept); its facts in order of period form a hidden Markov
chain whose hidden state is the unit (base and power of ten) a figure was written in.
What a fact says of its unit is the emission; the logarithm of the quantity is a
smooth level that pays for jumps, and a switch of unit has a price. Viterbi decodes
every device:

* a stated scale, or a figure that the rule of multiples excludes as a full amount,
  leaves one state;
* a plain currency whose figure is a multiple of 10^d was written in full, or, by a
  chance of ``IN_UNITS`` times 10^-d, in units of 10^d: two states with these priors;
* where nothing is stated, the states are the bases of the stated facts on either side
  with any scale, and the level decides.

A fact with one state splits the chain without any loss, so a device streams by in
order and only the facts between two such are held.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.quantity import MONEY, UNIT_CODES, read_fact, read_unit

#: Spread, in powers of ten, of a device's level from one fact to the next.
SIGMA = 1.0
#: Log price of a unit switch: sources write in units of their own, so every second
#: step along a device is one.
SWITCH = math.log(0.5)
#: Share of plain currency figures with decimals -d that are in units of 10^d.
IN_UNITS = 0.05
#: Log price of a break of the level: a jump costs no more, however wide. One in twenty
#: steps of a series of figures is such a break.
BREAK = math.log(0.05)
#: Scales of a fact that states none.
SCALES = (0, 3, 6, 9, 12)
#: A device above so many facts is hot, and decoded in parts cut at facts of one state.
CHUNK_ROWS = 1_000_000
#: Hot devices, and parts of them all together, are at most about so many: a device of
#: less than its share of all facts is not hot.
MOST_PARTS = 10_000
#: Two quantities agree, or two figures differ, at this share of the larger.
TOLERANCE = 0.001


def pinned_scale(figure: float | None, base: str | None, scale: int | None, decimals: str | None) -> tuple[int | None, int]:
    """(the power of ten that the reading rules give, or None; d of a figure that may
    as well be in units of 10^d, or 0)."""
    if base is None or figure is None:
        return None, 0
    if scale is not None:
        return scale, 0
    d = (decimals or "").strip()
    if base in MONEY and d[:1] == "-" and d[1:].isdigit() and 0 < int(d[1:]) < 100:
        n = int(d[1:])
        return (0, n) if math.fmod(figure, 10.0**n) == 0 else (n, 0)
    return 0, 0


def viterbi(levels: list[float | None], candidates: list[list[tuple]], sigma: float = SIGMA, switch: float = SWITCH) -> list[int]:
    """Index of the best candidate of each step.

    ``levels``: log10 of the figure or None (zero: says nothing about the level);
    ``candidates``: per step (shift, state, log prior), at least one; a state is
    (base, scale), and levels in different bases are not compared. At a tie the
    earlier candidate wins."""
    score, back = [c[2] for c in candidates[0]], []
    at = [levels[0] + c[0] if levels[0] is not None else None for c in candidates[0]]
    for t in range(1, len(levels)):
        new, ptr, here = [], [], []
        for shift, state, prior in candidates[t]:
            level = levels[t] + shift if levels[t] is not None else None
            best, arg = -math.inf, 0
            for k, s in enumerate(score):
                before = candidates[t - 1][k][1]
                s += 0.0 if before == state else switch
                if level is not None and at[k] is not None and before[0] == state[0]:
                    s -= min((level - at[k]) ** 2 / (2 * sigma * sigma), -BREAK)
                if s > best:
                    best, arg = s, k
            new.append(best + prior)
            ptr.append(arg)
            here.append(level if level is not None else at[arg])
        score, at = new, here
        back.append(ptr)
    k = max(range(len(score)), key=lambda i: (score[i], -i))
    path = [k]
    for ptr in reversed(back):
        k = ptr[k]
        path.append(k)
    return path[::-1]


_PLAIN = r"^\s*-?[0-9][0-9.,]*\s*$"
_VALID = r"^-?[0-9]+(\.[0-9]*)?$"
_CODE = {u: i for i, u in enumerate(UNIT_CODES)}
#: Columns of a read fact, behind its keys.
_READ = "owner string, concept string, period string, year int, figure double, base int, scale int, soft int"


def _numbers(raw: pa.Array, unit: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(figure or NaN, code of the base or -1, stated scale or NaN) of raw texts with
    their unit texts: bare numbers all at once, others one by one."""
    units = pc.fill_null(unit, "").dictionary_encode()
    read = [read_unit(u) for u in units.dictionary.to_pylist()]
    at = units.indices.to_numpy(zero_copy_only=False)
    pick = lambda f, kind: np.array([f(u) for u in read], kind)[at] if read else np.zeros(len(at), kind)
    base = pick(lambda u: _CODE.get(u.base, -1), np.int64)
    scale = pick(lambda u: math.nan if u.scale is None else u.scale, np.float64)
    local = pick(lambda u: u.indonesian, bool)
    text = pc.utf8_rtrim(pc.utf8_trim_whitespace(pc.fill_null(raw, "")), ".,")
    english, indonesian = pc.replace_substring(text, ",", ""), pc.replace_substring(pc.replace_substring(text, ".", ""), ",", ".")
    text = pc.if_else(pa.array(local), indonesian, english)
    fast = pc.and_(pc.fill_null(pc.match_substring_regex(raw, _PLAIN), False), pc.match_substring_regex(text, _VALID))
    figure = pc.cast(pc.if_else(fast, text, pa.scalar("nan", text.type)), pa.float64()).to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(~fast.to_numpy(zero_copy_only=False)).tolist():
        value, b, s = read_fact(raw[i].as_py(), unit[i].as_py())
        figure[i] = math.nan if value is None else value
        base[i], scale[i] = _CODE.get(b, -1), math.nan if s is None else s
    return figure, base, scale


@lru_cache(maxsize=10_000)
def _year(period: str | None) -> int | None:
    run = ""
    for c in period or "":
        run = run + c if c in "0123456789" else ""
        if len(run) == 4:
            return int(run)
    return None


def _read_batch(b: pa.RecordBatch) -> pa.RecordBatch:
    """fact_id, loaded_at, filing_id, ticker, concept, period, raw_text, unit, decimals
    as read facts; of copies inside the batch the latest."""
    ids, at = b.column(0).to_numpy(zero_copy_only=False), pc.fill_null(b.column(1).cast(pa.int64()), -(2**63)).to_numpy(zero_copy_only=False)
    order = np.lexsort((at, ids))
    last = np.append(ids[order][1:] != ids[order][:-1], True)[: len(ids)]
    if not last.all():  # map-side combine of rows sent again
        b = b.take(pa.array(np.sort(order[last])))
    figure, base, scale = _numbers(b.column(6), b.column(7))
    decimals = pc.fill_null(b.column(8), "").dictionary_encode()
    d = [int(t[1:]) if (t := x.strip())[:1] == "-" and t[1:].isdigit() and 0 < int(t[1:]) < 100 else 0 for x in decimals.dictionary.to_pylist()]
    d = np.array(d, np.int64)[decimals.indices.to_numpy(zero_copy_only=False)] if d else np.zeros(len(figure), np.int64)
    known = (base >= 0) & ~np.isnan(figure)
    plain = known & np.isnan(scale)
    ruled = plain & (d > 0) & np.isin(base, [_CODE[m] for m in MONEY])
    with np.errstate(invalid="ignore"):
        multiple = np.fmod(figure, 10.0**d) == 0
    soft = np.where(ruled & multiple, d, 0)
    scale = np.where(plain, np.where(ruled & ~multiple, d, 0), scale)
    period = b.column(5).dictionary_encode()
    years = pa.array([_year(p) for p in period.dictionary.to_pylist()], pa.int32()).take(period.indices)
    ticker = pc.utf8_trim_whitespace(b.column(3))
    owner = pc.if_else(pc.fill_null(pc.not_equal(ticker, ""), False), ticker, pc.binary_join_element_wise("#", pc.fill_null(b.column(2).cast(pa.string()), ""), ""))
    real = lambda x: pa.array(x, pa.int32(), mask=np.isnan(x))
    return pa.RecordBatch.from_arrays(
        [b.column(0), b.column(1), b.column(2), owner, b.column(4), b.column(5), years, pa.array(figure, pa.float64(), mask=np.isnan(figure)), pa.array(base, pa.int32(), mask=base < 0), real(scale), pa.array(soft, pa.int32())],
        ["fact_id", "loaded_at", "filing_id", "owner", "concept", "period", "year", "figure", "base", "scale", "soft"],
    )


def read_facts(df: DataFrame) -> DataFrame:
    """One row per ``fact_id`` (the latest ``loaded_at`` of those sent again) with the
    figure as written and what the text says of its unit: ``base``, ``scale`` and
    ``soft`` (see ``pinned_scale``). Facts are read before they are shuffled, so only
    narrow rows are. Rows without a ``fact_id`` can't be told apart and are left out."""
    src = df.where(F.col("fact_id").isNotNull()).select(F.col("fact_id").cast("bigint"), "loaded_at", F.col("filing_id").cast("bigint"), "ticker", "concept", "period", "raw_text", "unit", "decimals")
    read = src.mapInArrow(lambda batches: map(_read_batch, batches), f"fact_id bigint, loaded_at {dict(src.dtypes)['loaded_at']}, filing_id bigint, {_READ}")
    rest = [c for c in read.columns if c not in ("fact_id", "loaded_at")]
    return read.groupBy("fact_id").agg(F.max(F.struct("loaded_at", *rest)).alias("r")).select("fact_id", *[f"r.{c}" for c in rest])


def _pinned() -> F.Column:
    return F.col("figure").isNotNull() & F.col("base").isNotNull() & F.col("scale").isNotNull() & (F.col("soft") == 0)


def chains(read: DataFrame, facts: DataFrame) -> DataFrame:
    """Read facts spread by device and sorted along it. A hot device is cut at some of
    its facts of one state, in the chain's order; the fact at a cut ends one part and,
    as ``echo``, begins the next, which gives the result of the whole chain. Hot
    devices are told from a count of the raw rows; their number is bounded."""
    raw = facts.where(F.col("fact_id").isNotNull()).groupBy(F.trim("ticker").alias("t"), "concept").agg(F.count(F.lit(1)).alias("n"))
    most = max(CHUNK_ROWS, -(-(facts.count()) // MOST_PARTS))
    hot = raw.where((F.col("n") > most) & (F.col("t") != "")).select(F.col("t").alias("owner"), F.col("concept").alias("c"), "n")
    parts = read.withColumn("part", F.lit(0)).withColumn("echo", F.lit(False))
    if not hot.isEmpty():  # at most MOST_PARTS rows
        same = F.col("concept").eqNullSafe(F.col("c"))
        place = F.struct("year", "period", "fact_id")
        some = read.where(_pinned()).join(F.broadcast(hot), (read["owner"] == hot["owner"]) & same).where(F.pmod(F.xxhash64("fact_id"), F.lit(most)) == 0)
        cuts = some.groupBy(hot["owner"].alias("o"), "c").agg(F.array_sort(F.collect_set(place)).alias("cuts"))
        met = read.join(F.broadcast(cuts), (F.col("owner") == F.col("o")) & same, "left").withColumn("part", F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("cuts", lambda c: c <= place))))
        both = F.when(F.array_contains("cuts", place), F.array(F.struct((F.col("part") - 1).alias("part"), F.lit(False).alias("echo")), F.struct(F.col("part").alias("part"), F.lit(True).alias("echo"))))
        parts = met.withColumn("at", F.explode(F.coalesce(both, F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("echo")))))).select(*read.columns, "at.part", "at.echo")
    return parts.repartition("owner", "concept", "part").sortWithinPartitions("owner", "concept", "part", "year", "period", "fact_id")


def _codes(c: pa.ChunkedArray) -> np.ndarray:
    return c.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


class _Decoder:
    """Streams a partition of ``chains``; batches come out with scale and base filled in."""

    def __init__(self, sigma: float, switch: float) -> None:
        self.sigma, self.switch, self.held, self.done = sigma, switch, [], 0

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for b in batches:
            if b.num_rows:
                self.held.append(b)
                if self.splits(b):
                    yield self.flush(False)
        if self.held:
            yield self.flush(True)

    def splits(self, b: pa.RecordBatch) -> bool:
        """Whether a batch holds a fact of one state or another device than the last."""
        first = self.held[0]
        same = all(b.column(c)[-1].as_py() == first.column(c)[0].as_py() for c in ("owner", "concept", "part"))
        return not same or bool(self.pins(b).any())

    @staticmethod
    def pins(t: pa.Table | pa.RecordBatch) -> np.ndarray:
        valid = lambda c: t.column(c).is_valid().to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(c).is_valid().combine_chunks().to_numpy(zero_copy_only=False)
        return valid("figure") & valid("base") & valid("scale") & (np.asarray(t.column("soft")) == 0)

    def flush(self, last: bool) -> pa.Table:
        t = pa.Table.from_batches(self.held)
        n, skip = len(t), self.done
        pin = self.pins(t)
        codes = [_codes(t.column(c)) for c in ("owner", "concept", "part")]
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
        device = np.cumsum(new)
        end = n
        if not last:  # what follows the last fact of one state waits for the next
            begin = int(np.flatnonzero(new)[-1])
            own = np.flatnonzero(pin[begin:])
            end = begin + int(own[-1]) + 1 if len(own) else begin
        figure, base, scale, soft = (np.asarray(t.column(c).combine_chunks().fill_null(f)) for c, f in (("figure", math.nan), ("base", -1), ("scale", -99), ("soft", 0)))
        base, scale = base.copy(), scale.copy()
        how = np.where(pin, "stated", "open").astype(object)
        open_ = np.flatnonzero(~pin[:end] & ~np.isnan(figure[:end]))
        pins = np.flatnonzero(pin)
        if len(open_):
            run = np.searchsorted(pins, open_)  # facts between the same two pins of a device
            cut = np.flatnonzero((run[1:] != run[:-1]) | (device[open_[1:]] != device[open_[:-1]])) + 1
            for rows in np.split(open_, cut):
                k = int(np.searchsorted(pins, rows[0]))
                ends = [int(pins[j]) for j in (k - 1, k) if 0 <= j < len(pins) and device[pins[j]] == device[rows[0]]]
                self.decode(rows, ends, figure, base, scale, soft, how)
        echo = np.asarray(t.column("echo").combine_chunks()) if end else np.zeros(0, bool)
        keep = np.flatnonzero(~echo[skip:end]) + skip
        out = pa.table({
            **{c: t.column(c).take(pa.array(keep)) for c in ("fact_id", "filing_id", "concept", "period", "figure")},
            "base": pa.array(base[keep], pa.int32(), mask=(base[keep] < 0)), "scale": pa.array(scale[keep], pa.int32(), mask=(scale[keep] == -99)), "how": pa.array(how[keep], pa.string()),
        })
        # the last fact of one state stays as the beginning of what comes
        own = end - 1 if not last and end > 0 and end > (int(np.flatnonzero(new)[-1])) else end
        self.held, self.done = ([] if own >= n else t.slice(own).to_batches()), end - own
        return out

    def decode(self, rows: np.ndarray, ends: list[int], figure: np.ndarray, base: np.ndarray, scale: np.ndarray, soft: np.ndarray, how: np.ndarray) -> None:
        """Viterbi over a run of facts of several states, between facts of one."""
        chain = sorted([*rows.tolist(), *ends])
        near = list(dict.fromkeys(int(base[i]) for i in chain if base[i] >= 0))  # bases stated along the run
        levels, cands, known = [], [], []
        for i in chain:
            f, b, s = figure[i], int(base[i]), int(scale[i])
            if i in ends or b >= 0 and not soft[i]:
                c = [(s, (b, s), 0.0)]
            elif b >= 0:
                d = int(soft[i])
                c = [(0, (b, 0), 0.0), (d, (b, d), math.log(IN_UNITS) - d * math.log(10))]
            else:
                c = [(x, (y, x), 0.0) for y in near for x in (SCALES if s == -99 else (s,))]
            if c:
                levels.append(math.log10(abs(f)) if f else None)
                cands.append(c)
                known.append(i)
        if not known:
            return
        for i, c, k in zip(known, cands, viterbi(levels, cands, self.sigma, self.switch), strict=True):
            if i not in ends:
                (base[i], scale[i]), how[i] = c[k][1], "decoded"


_OUT = "fact_id bigint, filing_id bigint, concept string, period string, figure double, unit_code string, scale int, common_unit string, quantity double, how string"


def _factors(factors: DataFrame) -> dict[str, tuple[str, float]]:
    """unit_code to (common unit, factor), for the codes that unit texts can state: a
    fixed list, however many rows the table has."""
    rows = factors.where(F.col("unit_code").isin(*UNIT_CODES)).groupBy("unit_code").agg(F.max(F.struct("common_unit", "factor")).alias("u")).collect()
    return {r["unit_code"]: tuple(r["u"]) for r in rows}


def _quantities(t: pa.Table, table: dict[str, tuple[str, float]]) -> pa.RecordBatch:
    code = np.asarray(t.column("base").combine_chunks().fill_null(len(UNIT_CODES)))
    names = pa.array([*UNIT_CODES, None], pa.string())
    commons = pa.array([*(table.get(u, (None, 0))[0] for u in UNIT_CODES), None], pa.string())
    factor = np.array([*(table.get(u, (None, math.nan))[1] or math.nan for u in UNIT_CODES), math.nan])[code]
    scale = np.asarray(t.column("scale").combine_chunks().fill_null(0)).astype(np.float64)
    q = np.asarray(t.column("figure").combine_chunks().fill_null(math.nan)) * factor * 10.0**scale
    undone = pc.is_in(t.column("how").combine_chunks(), pa.array(["open"]))
    q[undone.to_numpy(zero_copy_only=False)] = math.nan
    cols = [*(t.column(c).combine_chunks() for c in ("fact_id", "filing_id", "concept", "period", "figure")), names.take(pa.array(code)), t.column("scale").combine_chunks(), commons.take(pa.array(code)), pa.array(q, pa.float64(), mask=np.isnan(q)), t.column("how").combine_chunks()]
    return pa.RecordBatch.from_arrays(cols, ["fact_id", "filing_id", "concept", "period", "figure", "unit_code", "scale", "common_unit", "quantity", "how"])


def _decoding(facts: DataFrame, factors: DataFrame, sigma: float, switch: float, then, schema: str) -> DataFrame:
    table = _factors(factors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return then(_quantities(t, table) for t in _Decoder(sigma, switch).run(batches))

    return chains(read_facts(facts), facts).mapInArrow(run, schema)


def normalise_units(facts: DataFrame, factors: DataFrame, sigma: float = SIGMA, switch: float = SWITCH) -> DataFrame:
    """Each fact's ``quantity`` in its ``common_unit``: ``fact_id``, ``filing_id``,
    ``concept``, ``period``, ``figure``, ``unit_code``, ``scale``, ``common_unit``,
    ``quantity`` and ``how`` ("stated": one state; "decoded": chosen by Viterbi from
    several; "open": no figure, or no stated unit in the whole device).

    A raw text without a number has no figure and no quantity. Facts without a ticker
    form devices by filing. Currencies are not converted into each other."""
    return _decoding(facts, factors, sigma, switch, lambda x: x, _OUT)


def held_out(facts: DataFrame, factors: DataFrame, every: int = 10, sigma: float = SIGMA, switch: float = SWITCH) -> DataFrame:
    """How well the chains alone tell units: the statement of every ``every``-th stated
    fact (by hash) is hidden and decoded from its device. ``unit_code``, ``scale`` (as
    stated), ``n_facts``, ``n_base`` and ``n_unit`` (base, and base and scale, decoded as
    stated). Facts of devices without any other statement count as not decoded."""
    read = read_facts(facts)
    hide = _pinned() & (F.col("figure") != 0) & (F.pmod(F.xxhash64("fact_id"), F.lit(every)) == 0)
    told = F.when(hide, F.col("base") * 100 + F.col("scale")).otherwise(-1).cast("bigint")  # what is hidden travels as the filing
    hidden = read.withColumns({"filing_id": told, "base": F.when(~hide, F.col("base")), "scale": F.when(~hide, F.col("scale"))})
    table = _factors(factors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_quantities(t, table) for t in _Decoder(sigma, switch).run(batches))

    got = chains(hidden, facts).mapInArrow(run, _OUT).where(F.col("filing_id") >= 0)
    names = F.array(*[F.lit(u) for u in UNIT_CODES])
    base, scale = F.element_at(names, F.floor(F.col("filing_id") / 100).cast("int") + 1), (F.col("filing_id") % 100).cast("int")
    same = F.col("unit_code").eqNullSafe(base)
    return got.groupBy(base.alias("unit_code"), scale.alias("scale")).agg(F.count(F.lit(1)).alias("n_facts"), F.count_if(same).alias("n_base"), F.count_if(same & (F.col("scale") == scale)).alias("n_unit"))


#: Width, in powers of ten, of the buckets of the pair join: some twenty tolerances.
_BUCKET = 0.01
_SLACK = math.log10(1 / (1 - TOLERANCE)) * 1.001
_PACKED = "filing_id bigint, part bigint, size double, figure double, home boolean, fact_id bigint, more array<bigint>"


@lru_cache(maxsize=200_000)
def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def _hashes(c: pa.Array) -> np.ndarray:
    d = c.dictionary_encode()
    return np.array([_hash(x) for x in d.dictionary.to_pylist()], np.uint64)[d.indices.to_numpy(zero_copy_only=False)] if len(c) else np.zeros(0, np.uint64)


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return h


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quantities as rows of the pair search, copies inside a batch as one row: filing,
    ``part`` (a hash of concept, period, unit, sign and bucket; it stands beside the
    filing, so only one filing's parts could ever collide), ``size`` (the quantity's),
    figure and ids. A quantity near its bucket's lower edge is a guest of the one below."""
    for b in batches:
        t = pa.Table.from_batches([b])
        ok = pc.and_(pc.is_valid(t.column("quantity")), pc.fill_null(pc.not_equal(t.column("quantity"), 0.0), False))
        for c in ("filing_id", "concept", "period", "common_unit"):
            ok = pc.and_(ok, pc.is_valid(t.column(c)))
        t = t.filter(ok)
        filing, q, fig, ids = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("filing_id", "quantity", "figure", "fact_id"))
        log = np.log10(np.abs(q))
        own, below = np.floor(log / _BUCKET).astype(np.int64), np.floor((log - _SLACK) / _BUCKET).astype(np.int64)
        group = _mix(*(_hashes(t.column(c).combine_chunks()) for c in ("concept", "period", "common_unit")), (q < 0).astype(np.uint64))
        order = np.lexsort((ids, fig, q, group, filing))
        filing, q, fig, ids, own, below, group = (x[order] for x in (filing, q, fig, ids, own, below, group))
        new = np.ones(len(q), bool)
        if len(q) > 1:
            new[1:] = (filing[1:] != filing[:-1]) | (group[1:] != group[:-1]) | (q[1:] != q[:-1]) | (fig[1:] != fig[:-1])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(q)))
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(q)).astype(np.int32)), pa.array(ids))
        more = pc.if_else(pa.array(counts > 1), lists, pa.scalar(None, lists.type)) if len(at) else pa.array([], lists.type)
        guest = np.flatnonzero(below[at] != own[at])
        pick = np.concatenate([np.arange(len(at)), guest])
        part = _mix(group[at][pick], np.concatenate([own[at], below[at][guest]])).view(np.int64)
        home = np.arange(len(pick)) < len(at)
        rows = at[pick]
        yield pa.RecordBatch.from_arrays(
            [pa.array(filing[rows], pa.int64()), pa.array(part, pa.int64()), pa.array(np.abs(q[rows])), pa.array(fig[rows], pa.float64()), pa.array(home), pa.array(ids[rows], pa.int64()), more.take(pa.array(pick))],
            ["filing_id", "part", "size", "figure", "home", "fact_id", "more"],
        )


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a - b) <= TOLERANCE * np.maximum(np.abs(a), np.abs(b))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id lists of the rows that agree in size and differ in figure. Rows stream by
    sorted, so partners are neighbours; what is within the tolerance of a batch's last
    row goes on into the next."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        old = len(held) if held is not None else 0
        t = pa.concat_tables([held, pa.Table.from_batches([b])]) if held is not None else pa.Table.from_batches([b])
        filing, part, size, fig, home = (t.column(c).to_numpy() for c in ("filing_id", "part", "size", "figure", "home"))
        left, step, found = np.flatnonzero(home), 1, []
        while len(left):
            left = left[left + step < len(t)]
            right = left + step
            there = (filing[right] == filing[left]) & (part[right] == part[left]) & (size[right] * (1 - 2 * TOLERANCE) <= size[left])
            left, right = left[there], right[there]
            hit = (right >= old) & _near(size[left], size[right]) & ~_near(fig[left], fig[right])
            found.append(np.stack([left[hit], right[hit]]))
            step += 1
        got = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        ids, more = t.column("fact_id"), t.column("more").combine_chunks()
        ones = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1), pa.int32()), ids.combine_chunks())
        lists = pc.if_else(more.is_valid(), more, ones)
        yield pa.RecordBatch.from_arrays([lists.take(pa.array(got[0])), lists.take(pa.array(got[1]))], ["a", "b"])
        keep = np.flatnonzero((filing == filing[-1]) & (part == part[-1]) & (size >= size[-1] * (1 - 2 * TOLERANCE)))
        held = t.slice(int(keep[0]))


def _restated(packed: DataFrame) -> DataFrame:
    lists = packed.repartition("filing_id", "part").sortWithinPartitions("filing_id", "part", "size", "figure").mapInArrow(_pairs, "a array<bigint>, b array<bigint>")
    pairs = lists.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))
    return pairs.select(F.least("a", "b").alias("fact_id_a"), F.greatest("a", "b").alias("fact_id_b"))


def restated(quantities: DataFrame) -> DataFrame:
    """Pairs ``fact_id_a`` < ``fact_id_b`` of one filing, concept and period that give
    one quantity (within ``TOLERANCE``) in figures that differ by more than that.

    Copies of one (quantity, figure) travel as one row with their ids, packed before the
    shuffle, and are opened only behind the search. The search spreads by group and
    logarithmic bucket, so a hot group is many parts, and streams each sorted by size.
    Facts without filing, concept or period have no group; zero agrees only with zero,
    in equal figures."""
    q = quantities.select(F.col("fact_id").cast("bigint").alias("fact_id"), F.col("filing_id").cast("bigint").alias("filing_id"), "concept", "period", "common_unit", "quantity", "figure")
    return _restated(q.mapInArrow(_pack, _PACKED))


def restated_facts(facts: DataFrame, factors: DataFrame) -> DataFrame:
    """``restated`` of ``normalise_units``, in one Python pass behind the chains."""
    return _restated(_decoding(facts, factors, SIGMA, SWITCH, _pack, _PACKED))

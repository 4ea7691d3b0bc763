"""Reading figures and unit texts of facts.

A unit text is read token by token, so spellings that mix a base unit and a scale
in any order, glued or not, need no entry of their own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

# Words of the data's unit texts. Scale words as powers of ten;
# the second set is Indonesian, and so gives the text Indonesian number style.
SCALES = {"k": 3, "thousand": 3, "thousands": 3, "m": 6, "mn": 6, "mio": 6, "million": 6, "millions": 6, "bn": 9, "b": 9, "billion": 9, "billions": 9, "tn": 12, "trillion": 12, "trillions": 12}
SCALES_ID = {"ribu": 3, "ribuan": 3, "rb": 3, "juta": 6, "jutaan": 6, "jt": 6, "miliar": 9, "miliaran": 9, "milyar": 9, "milyaran": 9, "triliun": 12, "triliunan": 12, "trilyun": 12}
# Base words to a unit_code; again the second set is Indonesian.
BASES = {
    "idr": "IDR", "usd": "USD", "us$": "USD", "$": "USD", "dollar": "USD", "dollars": "USD", "share": "share", "shares": "share", "lot": "lot", "lots": "lot",
    "kg": "kg", "kilogram": "kg", "kilograms": "kg", "tonne": "tonne", "tonnes": "tonne", "t": "tonne", "lb": "lb", "lbs": "lb", "pound": "lb", "pounds": "lb", "kwh": "kWh", "mwh": "MWh", "gwh": "GWh", "twh": "TWh",
    "m2": "m2", "sqm": "m2", "ha": "ha", "hectare": "ha", "hectares": "ha", "km2": "km2", "sqkm": "km2", "litre": "litre", "litres": "litre", "l": "litre", "kilolitre": "kilolitre", "kilolitres": "kilolitre", "kl": "kilolitre", "m3": "m3", "bbl": "bbl", "bbls": "bbl", "barrel": "bbl", "barrels": "bbl",
    "pure": "pure", "ratio": "pure", "percent": "percent", "%": "percent", "bps": "bps", "bp": "bps",
}
BASES_ID = {"rp": "IDR", "rupiah": "IDR", "saham": "share", "lembar": "share", "ton": "tonne", "hektar": "ha", "liter": "litre", "kiloliter": "kilolitre", "barel": "bbl", "persen": "percent"}
# Bases of two words, and units with a scale of their own.
PAIRS = {("gigawatt", "hours"): "GWh", ("gigawatt", "hour"): "GWh", ("megawatt", "hours"): "MWh", ("kilowatt", "hours"): "kWh", ("terawatt", "hours"): "TWh", ("basis", "points"): "bps", ("basis", "point"): "bps", ("square", "metres"): "m2", ("cubic", "metres"): "m3"}
PAIRS_ID = {("basis", "poin"): "bps", ("meter", "persegi"): "m2", ("meter", "kubik"): "m3", ("dolar", "as"): "USD", ("ton", "metrik"): "tonne"}
SCALED = {"kt": ("tonne", 3), "mt": ("tonne", 6)}
#: "in full": a stated scale of one.
FULL, FULL_ID = {"full", "units"}, {"penuh"}
MONEY = ("IDR", "USD")
#: Every unit_code a text can state.
UNIT_CODES = tuple(sorted({*BASES.values(), *BASES_ID.values(), *PAIRS.values(), *PAIRS_ID.values(), *(u for u, _ in SCALED.values())}))
_NOISE = {"in", "dalam", "iso4217", "of", "per", "satuan", "metric"}

_GLUED = re.compile(r"^(idr|usd|us\$|rp)(k|m|mn|mio|bn|b|tn|t)$")
_TOKEN = re.compile(r"us\$|[a-z]+[23]?(?![a-z])|\$|%")
_DIGIT_UNITS = [(re.compile(r"(?i)(?<![a-z])(k?m)²"), r"\g<1>2"), (re.compile(r"(?i)(?<![a-z])m³"), "m3"), (re.compile(r"['’`]\s?000\b"), " thousand "), (re.compile(r"(?i)iso4217:"), "")]
_HIDE = [(re.compile(r"(?i)(?<![a-z])km2(?![\d])"), " sqkm "), (re.compile(r"(?i)(?<![a-z])m2(?![\d])"), " sqm "), (re.compile(r"(?i)(?<![a-z])m3(?![\d])"), " mcubic ")]
_NUMBER = re.compile(r"[-−–+]?\s?\(?\s?[-−–]?\s?\d[\d.,]*(?:[eE][+-]?\d+)?")


@dataclass(frozen=True)
class Unit:
    """base: a unit_code or None; scale: stated power of ten or None; indonesian: number style."""

    base: str | None
    scale: int | None
    indonesian: bool


@lru_cache(maxsize=100_000)
def read_unit(text: str) -> Unit:
    """The unit that a text states; Unit(None, None, False) when it states none."""
    for pattern, to in _DIGIT_UNITS:
        text = pattern.sub(to, text)
    tokens = [t for t in _TOKEN.findall(text.casefold().replace("_", " ").replace("mcubic", "m3").replace("sqkm", "km2")) if t not in _NOISE]
    base, scale, indonesian, i = None, None, False, 0
    while i < len(tokens):
        t, pair = tokens[i], tuple(tokens[i : i + 2])
        glued = _GLUED.match(t)
        step = 1
        if pair in PAIRS or pair in PAIRS_ID:
            base, step = base or PAIRS.get(pair) or PAIRS_ID[pair], 2
            indonesian |= pair in PAIRS_ID
        elif glued:
            base = base or ("USD" if glued[1].startswith("us") else "IDR")
            scale = (scale or 0) + {"t": 12}.get(glued[2], SCALES.get(glued[2], 0))
            indonesian |= glued[1] == "rp"
        elif t in SCALED:
            base, scale = base or SCALED[t][0], (scale or 0) + SCALED[t][1]
        elif t in BASES:
            base = base or BASES[t]
        elif t in BASES_ID:
            base, indonesian = base or BASES_ID[t], True
        elif t in SCALES or t in SCALES_ID:
            scale = (scale or 0) + (SCALES.get(t) or SCALES_ID[t])
            indonesian |= t in SCALES_ID
        elif t in FULL or t in FULL_ID:
            scale = scale or 0
            indonesian |= t in FULL_ID
        i += step
    return Unit(base, scale, indonesian)


def split_figure(raw: str) -> tuple[str | None, str]:
    """(figure as written, the rest) of a raw text."""
    for pattern, to in _DIGIT_UNITS + _HIDE:
        raw = pattern.sub(to, raw)
    m = _NUMBER.search(raw)
    if not m:
        return None, raw
    return m[0], raw[: m.start()] + " " + raw[m.end() :]


def read_number(figure: str, indonesian: bool) -> float | None:
    """The figure's value in the given style; brackets mean minus."""
    minus = any(c in figure for c in "-−–(") and not re.search(r"[eE]-", figure)
    text = re.sub(r"[^\d.,eE+]", "", figure).lstrip("+").rstrip(".,")
    text = text.replace(".", "").replace(",", ".") if indonesian else text.replace(",", "")
    try:
        v = float(text)
    except ValueError:
        return None
    return -v if minus else v


def read_fact(raw: str | None, unit: str | None) -> tuple[float | None, str | None, int | None]:
    """(figure, unit_code, stated scale) of a fact. The unit column counts first, the
    raw text for what that leaves open; either being Indonesian sets the style."""
    if raw is None:
        return None, None, None
    figure, rest = split_figure(raw)
    a, b = read_unit(unit or ""), read_unit(rest)
    base, scale = a.base or b.base, a.scale if a.scale is not None else b.scale
    return read_number(figure, a.indonesian or b.indonesian) if figure else None, base, scale

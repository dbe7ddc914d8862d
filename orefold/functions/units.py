"""Unit expressions by a grammar, and the statements of a text that name a unit.

    quotient := product (("/" | "per" | "*") product)*     from left to right
    product  := factor ((blank | "·") factor)*             binds tighter: J/mol·K is J/(mol·K)
    factor   := ("(" quotient ")" | power of ten | ["square" | "cubic"] symbol) [exponent]

A unit is a scale and an offset to SI and a vector of exponents over (length, mass, time, current,
temperature, amount). Two units convert if their vectors agree; molar energies also convert per particle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

Dims = tuple[int, int, int, int, int, int]
ZERO: Dims = (0, 0, 0, 0, 0, 0)
MOLE: Dims = (0, 0, 0, 0, 0, 1)
EV = 1.602176634e-19
#: Fixed values of the problem: 1 eV = 96.485 kJ/mol = 23.0605 kcal/mol.
KJ_MOL, KCAL_MOL = 96.485, 23.0605
AVOGADRO = KJ_MOL * 1e3 / EV

#: Symbol -> (scale to SI, exponents, offset to SI).
LENGTH, MASS, TIME, CURRENT, TEMP = (1, 0, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0), (0, 0, 1, 0, 0, 0), (0, 0, 0, 1, 0, 0), (0, 0, 0, 0, 1, 0)
ENERGY, PRESSURE, VOLT, CHARGE, SIEMENS, OHM, FORCE = (2, 1, -2, 0, 0, 0), (-1, 1, -2, 0, 0, 0), (2, 1, -3, -1, 0, 0), (0, 0, 1, 1, 0, 0), (-2, -1, 3, 2, 0, 0), (2, 1, -3, -2, 0, 0), (1, 1, -2, 0, 0, 0)
SYMBOLS: dict[str, tuple[float, Dims, float]] = {
    "m": (1.0, LENGTH, 0), "metre": (1.0, LENGTH, 0), "meter": (1.0, LENGTH, 0), "Å": (1e-10, LENGTH, 0), "angstrom": (1e-10, LENGTH, 0), "ångström": (1e-10, LENGTH, 0), "ångstrom": (1e-10, LENGTH, 0),
    "bohr": (0.529177210903e-10, LENGTH, 0), "bohr radius": (0.529177210903e-10, LENGTH, 0), "bohr radii": (0.529177210903e-10, LENGTH, 0), "a₀": (0.529177210903e-10, LENGTH, 0), "a.u.": (0.529177210903e-10, LENGTH, 0),
    "g": (1e-3, MASS, 0), "gram": (1e-3, MASS, 0), "gramme": (1e-3, MASS, 0), "t": (1e3, MASS, 0),
    "s": (1.0, TIME, 0), "second": (1.0, TIME, 0), "min": (60.0, TIME, 0), "h": (3600.0, TIME, 0), "hr": (3600.0, TIME, 0), "hour": (3600.0, TIME, 0),
    "A": (1.0, CURRENT, 0), "ampere": (1.0, CURRENT, 0), "amp": (1.0, CURRENT, 0),
    "K": (1.0, TEMP, 0), "kelvin": (1.0, TEMP, 0), "°C": (1.0, TEMP, 273.15), "℃": (1.0, TEMP, 273.15), "degC": (1.0, TEMP, 273.15), "celsius": (1.0, TEMP, 273.15), "centigrade": (1.0, TEMP, 273.15),
    "°F": (5 / 9, TEMP, 273.15 - 32 * 5 / 9), "℉": (5 / 9, TEMP, 273.15 - 32 * 5 / 9), "degF": (5 / 9, TEMP, 273.15 - 32 * 5 / 9), "fahrenheit": (5 / 9, TEMP, 273.15 - 32 * 5 / 9), "°K": (1.0, TEMP, 0), "degK": (1.0, TEMP, 0),
    "mol": (1.0, MOLE, 0), "mole": (1.0, MOLE, 0),
    "J": (1.0, ENERGY, 0), "joule": (1.0, ENERGY, 0), "eV": (EV, ENERGY, 0), "electronvolt": (EV, ENERGY, 0), "electron-volt": (EV, ENERGY, 0),
    "cal": (KJ_MOL * 1e3 / (KCAL_MOL * 1e3), ENERGY, 0), "calorie": (KJ_MOL * 1e3 / (KCAL_MOL * 1e3), ENERGY, 0),
    "Ha": (27.211386 * EV, ENERGY, 0), "hartree": (27.211386 * EV, ENERGY, 0), "Ry": (13.605693 * EV, ENERGY, 0), "rydberg": (13.605693 * EV, ENERGY, 0),
    "Pa": (1.0, PRESSURE, 0), "pascal": (1.0, PRESSURE, 0), "bar": (1e5, PRESSURE, 0), "atm": (101325.0, PRESSURE, 0),
    "N": (1.0, FORCE, 0), "newton": (1.0, FORCE, 0), "V": (1.0, VOLT, 0), "volt": (1.0, VOLT, 0), "C": (1.0, CHARGE, 0), "coulomb": (1.0, CHARGE, 0), "Ah": (3600.0, CHARGE, 0),
    "psi": (6894.757293168, PRESSURE, 0), "ksi": (6894757.293168, PRESSURE, 0), "torr": (101325 / 760, PRESSURE, 0), "mmHg": (133.322387415, PRESSURE, 0),
    "Da": (1.66053906660e-27, MASS, 0), "dalton": (1.66053906660e-27, MASS, 0), "amu": (1.66053906660e-27, MASS, 0), "u": (1.66053906660e-27, MASS, 0),
    "in": (0.0254, LENGTH, 0), "inch": (0.0254, LENGTH, 0), "inches": (0.0254, LENGTH, 0), "ft": (0.3048, LENGTH, 0), "foot": (0.3048, LENGTH, 0), "feet": (0.3048, LENGTH, 0),
    "erg": (1e-7, ENERGY, 0), "dyn": (1e-5, FORCE, 0), "dyne": (1e-5, FORCE, 0), "ohm": (1.0, OHM, 0), "Ω": (1.0, OHM, 0), "Ω": (1.0, OHM, 0),
    "S": (1.0, SIEMENS, 0), "siemens": (1.0, SIEMENS, 0), "L": (1e-3, (3, 0, 0, 0, 0, 0), 0), "l": (1e-3, (3, 0, 0, 0, 0, 0), 0), "litre": (1e-3, (3, 0, 0, 0, 0, 0), 0), "liter": (1e-3, (3, 0, 0, 0, 0, 0), 0), "cc": (1e-6, (3, 0, 0, 0, 0, 0), 0),
}
#: Second readings of a symbol that stands alone, tried where the first has other dimensions than the quantity.
ALONE: dict[str, tuple[float, Dims, float]] = {"C": SYMBOLS["°C"], "F": SYMBOLS["°F"], "A": SYMBOLS["Å"], "c": SYMBOLS["°C"], "f": SYMBOLS["°F"], "k": SYMBOLS["K"]}
#: Symbols and words that take no prefix.
BARE = frozenset({"min", "h", "hr", "hour", "t", "a.u.", "bohr", "bohr radius", "bohr radii", "a₀", "psi", "ksi", "mmHg", "u", "amu", "in", "inch", "inches", "ft", "foot", "feet", "cc", "atm", "Å", "angstrom", "ångström", "ångstrom"})
#: Decimal prefixes.
PREFIXES = {"G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "d": 1e-1, "c": 1e-2, "m": 1e-3, "µ": 1e-6, "μ": 1e-6, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15,
            "giga": 1e9, "mega": 1e6, "kilo": 1e3, "deci": 1e-1, "centi": 1e-2, "milli": 1e-3, "micro": 1e-6, "nano": 1e-9, "pico": 1e-12}
#: The common unit of each property and of the other quantities.
COMMON = {
    "band_gap": "eV", "formation_energy": "eV", "density": "g/cm3", "melting_point": "K", "boiling_point": "K", "curie_temperature": "K", "neel_temperature": "K",
    "critical_temperature": "K", "magnetic_ordering_temperature": "K", "glass_transition_temperature": "K", "average_voltage": "V", "theoretical_capacity": "mAh/g",
    "ionic_conductivity": "S/cm", "bulk_modulus": "GPa", "shear_modulus": "GPa", "temperature": "K", "lattice": "angstrom",
}
_FOLDED: dict[str, list[str]] = {}
for _s in SYMBOLS:
    _FOLDED.setdefault(_s.casefold(), []).append(_s)
_BY_LENGTH = sorted(PREFIXES, key=len, reverse=True)
_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺−–‑", "0123456789-+---")


@dataclass(frozen=True)
class Unit:
    scale: float
    dims: Dims
    offset: float = 0.0

    def power(self, n: int) -> Unit | None:
        """The unit to the n-th power; a scale with another zero has none but the first."""
        if n == 1:
            return self
        return None if self.offset else Unit(self.scale**n, tuple(n * d for d in self.dims))

    def times(self, other: Unit) -> Unit | None:
        return None if self.offset or other.offset else Unit(self.scale * other.scale, tuple(a + b for a, b in zip(self.dims, other.dims)))


def _symbol(word: str) -> Unit | None:
    """A symbol or word with an optional prefix: as written first, then without case of the symbol, then
    without any case; each also as a plural."""
    forms = [w for w in (word, word[:-1] if word.endswith("s") and len(word) > 3 else "") if w]
    for cased, prefix_cased in ((True, True), (False, True), (False, False)):
        for w in forms:
            if (hit := _lookup(w, cased)) is not None:
                return Unit(*SYMBOLS[hit])
            for p in _BY_LENGTH:
                if not (w if prefix_cased else w.casefold()).startswith(p if prefix_cased else p.casefold()):
                    continue
                hit = _lookup(w[len(p) :].lstrip("-"), cased)
                if hit is not None and hit not in BARE and not SYMBOLS[hit][2]:
                    scale, dims, _ = SYMBOLS[hit]
                    return Unit(PREFIXES[p] * scale, dims)
    return None


def _lookup(w: str, cased: bool) -> str | None:
    names = [w] if cased and w in SYMBOLS else [] if cased else _FOLDED.get(w.casefold(), [])
    return names[0] if names else None


_TOKEN = re.compile(
    r"""(?P<gap>\s*[·⋅]\s*|\s+)
      | (?P<ten>10\s*(?:\^|\*\*)\s*[+-]?\d+|1e[+-]?\d+)(?:\s*[·*x×])?
      | (?P<over>/|\*(?!\*))
      | (?P<open>\() | (?P<close>\))
      | (?P<word>[^\W\d_](?:[^\W\d_]|\.(?=[^\W\d_])|-(?=[^\W\d_]))*\.?₀?|[°℃℉Ω][A-Za-z]?)
      | (?P<power>(?:\^|\*\*)?\s*\(?[+-]?\d+\)?)""",
    re.X,
)
# Words that stand before a symbol, with the power they lend it; and words without meaning there.
_POWERS = {"square": 2, "squared": 2, "cubic": 3}
_FILL = frozenset({"degree", "degrees", "deg", "plain", "unit", "units", "of"})


class _Parser:
    """Reads one expression from left to right; angstrom reads A as the angstrom instead of the ampere."""

    def __init__(self, text: str, angstrom: bool) -> None:
        self.tokens, self.at, self.angstrom, self.depth = [], 0, angstrom, 0
        end = 0
        while end < len(text):
            m = _TOKEN.match(text, end)
            if m is None:
                raise ValueError(text)
            kind, value = m.lastgroup, m[m.lastgroup].strip()
            if kind == "word" and value.casefold() == "per":
                kind, value = "over", "/"
            self.tokens.append((kind, value))
            end = m.end()

    def peek(self) -> str | None:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else None

    def skip(self) -> None:
        while self.peek() == "gap":
            self.at += 1

    def quotient(self) -> Unit:
        out = self.product()
        while True:
            self.skip()
            if self.peek() != "over":
                return out
            sign = -1 if self.tokens[self.at][1] == "/" else 1
            self.at += 1
            out = _known(out.times(_known(self.product().power(sign))))

    def product(self) -> Unit:
        self.skip()
        out = self.factor()
        while self.peek() in ("gap", "word", "open"):
            mark = self.at
            self.skip()
            if self.peek() not in ("word", "open", "ten"):
                self.at = mark
                return out
            out = _known(out.times(self.factor()))
        return out

    def factor(self) -> Unit:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, "")
        self.at += 1
        if kind == "open":
            self.depth += 1
            if self.depth > 16:
                raise ValueError("nested too deep")
            out = self.quotient()
            self.skip()
            if self.peek() != "close":
                raise ValueError("not closed")
            self.at += 1
            self.depth -= 1
        elif kind == "ten":
            return Unit(10.0 ** int(re.search(r"[+-]?\d+$", value)[0]), ZERO)
        elif kind == "word":
            if value.casefold() in _POWERS or value.casefold() in _FILL:
                self.skip()
                return _known(self.factor().power(_POWERS.get(value.casefold(), 1)))
            out = self.named(value)
        else:
            raise ValueError(value)
        if self.peek() == "power":
            n = int(re.search(r"[+-]?\d+", self.tokens[self.at][1])[0])
            self.at += 1
            out = _known(out.power(n))
        return out

    def named(self, word: str) -> Unit:
        if self.angstrom and word == "A":
            return Unit(*SYMBOLS["Å"])
        pair = self.tokens[self.at : self.at + 2]
        if [k for k, _ in pair] == ["gap", "word"] and f"{word} {pair[1][1]}".casefold() in _FOLDED:
            self.at += 2
            return _known(_symbol(f"{word} {pair[1][1]}".casefold()))
        return _known(_symbol(word) or _symbol(word.rstrip(".")))


def _known(unit: Unit | None) -> Unit:
    if unit is None:
        raise ValueError("no unit")
    return unit


@lru_cache(maxsize=1 << 14)
def parse_unit(text: str, angstrom: bool = False) -> Unit | None:
    """The unit an expression stands for, or None if the grammar does not cover it. Blank text is None."""
    s = re.sub(r"\ba0\b", "a₀", text.translate(_SUPER).strip())
    if len(s) > 200 or not s:
        return None
    try:
        parser = _Parser(s, angstrom)
        unit = parser.quotient()
        parser.skip()
    except (ValueError, OverflowError, ZeroDivisionError):
        return None
    return unit if parser.peek() is None and (any(unit.dims) or unit.offset) else None


@lru_cache(maxsize=1 << 14)
def conversion(quantity: str, text: str) -> tuple[float, float] | None:
    """(scale, offset) from a unit to the common one of a quantity; None if it cannot be read as such a unit.

    A symbol of two meanings is read as the one that fits: A in a volume is the angstrom, C alone a temperature."""
    common = COMMON.get(quantity)
    if common is None:
        return None
    goal, alone = parse_unit(common), ALONE.get(text.strip())
    for unit in (parse_unit(text), None if alone is None else Unit(*alone), parse_unit(text, True)):
        if unit is None:
            continue
        if unit.dims == goal.dims:
            return unit.scale / goal.scale, (unit.offset - goal.offset) / goal.scale
        if tuple(a - b for a, b in zip(goal.dims, unit.dims)) == MOLE:
            return unit.scale / AVOGADRO / goal.scale, 0.0
    return None


_SENTENCE = re.compile(r"(?<=[.;!?])\s+|[\r\n]+")
# Words by which a sentence denies a unit, or speaks of other records or former units.
_AGAINST = re.compile(r"\b(?:not|never|no longer|other|others|older|old|earlier|previous|previously|former|formerly|used to|unlike|instead of|rather than|converted|brought to)\b", re.I)
_LATTICE = r"cell edges?|lattice lengths?|lattice parameters?|lattice constants?|cell lengths?|cell parameters?"
_PIECE = re.compile(r"\(|\)|[^\s(),;:!?]+|[,;:!?]")
_NUMBER = re.compile(r"[+-]?\d[\d.,]*(?:[eE][+-]?\d+)?%?$")
#: Pieces of a text one unit expression may have.
UNIT_PIECES = 6


def _units_in(sentence: str, quantity: str) -> Iterator[str]:
    """The longest expressions of a sentence that the grammar reads as a unit of the quantity, left to right.

    One behind a number is part of a value. A single letter is a unit only behind in, is, are, a colon or an
    opening bracket, before is, was, are or were, or where the sentence has nothing else; in is never one."""
    pieces = [(m.start(), m.end(), m[0]) for m in _PIECE.finditer(sentence)]
    i = 0
    while i < len(pieces):
        before = pieces[i - 1][2] if i else ""
        for j in range(min(len(pieces), i + UNIT_PIECES), i, -1):
            text = sentence[pieces[i][0] : pieces[j - 1][1]].rstrip(".") or "."
            text = sentence[pieces[i][0] : pieces[j - 1][1]] if text + "." in SYMBOLS else text
            if text[0] == "(" and text.find(")") == len(text) - 1:
                text = text[1:-1].strip()
            if text.casefold() == "in" or _NUMBER.match(text) or conversion(quantity, text) is None:
                continue
            after = pieces[j][2].casefold() if j < len(pieces) else ""
            if len(text) == 1 and len(pieces) > 2 and before.casefold() not in ("in", "is", "are", ":", "(") and after not in ("is", "was", "are", "were"):
                continue
            if not _NUMBER.match(before):
                yield text
            i = j - 1
            break
        i += 1


@lru_cache(maxsize=256)
def _mention(quantity: str) -> re.Pattern[str]:
    return re.compile(rf"\b(?:{_LATTICE if quantity == 'lattice' else re.escape(quantity).replace('_', '[ _-]')})\b", re.I)


def stated_unit(quantity: str, text: str) -> str | None:
    """The unit that a text says this quantity is in as it stands here; None if it says none.

    A sentence says so if it names the quantity and a unit of it that belongs to no number. Sentences that
    deny a unit, or tell of other people's or former units, say nothing. The first that says so decides."""
    if _mention(quantity).search(text) is None:
        return None
    for sentence in _SENTENCE.split(text):
        if _mention(quantity).search(sentence) and not _AGAINST.search(sentence):
            if (unit := next(_units_in(sentence, quantity), None)) is not None:
                return unit
    return None


def noted_temperature_unit(text: str) -> str | None:
    """The unit notes give to the temperature as it stands here. A unit behind a number belongs to that number;
    where a sentence sets the figure here against another one, the unit said of the figure here counts."""
    for sentence in _SENTENCE.split(text):
        s = sentence.strip()
        if m := re.search(r"\bbut\b.*\b(?:here|given|recorded|logged)\b", s, re.I):
            s = s[m.start() :]
        if not _AGAINST.search(s):
            if (unit := next(_units_in(s, "temperature"), None)) is not None:
                return unit
    return None

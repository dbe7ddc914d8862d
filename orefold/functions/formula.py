"""The formula language: characters folded with an audit trail, parsed with a stack, reduced, keyed, spelled."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import lru_cache
from math import gcd

from orefold.reference.elements import METALS, NETWORK_PARTNERS, NOBLE_GASES, NUMBER, STRONG_ANIONS

# Adduct dots and dashes, digit scripts, the characters a folded formula may hold, nesting.
ADDUCTS = "·•‧⋅・."
DASHES = "−–—"
SCRIPT_DIGITS = "₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹"
ALLOWED = re.compile(r"[A-Za-z0-9()\[\]*+.-]{1,200}\Z")
MAX_NESTING = 8

_FOLD = str.maketrans({c: "*" for c in ADDUCTS} | {c: "-" for c in DASHES})
_DIGITS = str.maketrans(SCRIPT_DIGITS, "01234567890123456789")
_TOKEN = re.compile(r"(?P<symbol>[A-Z][a-z]?)|(?P<open>[(\[])|(?P<close>[)\]])|(?P<number>\d+(?:\.\d+)?)")


@dataclass(frozen=True)
class Formula:
    """A parsed formula, or the code and reason of its rejection. counts keep the order of first appearance."""

    raw: str
    folded: str | None
    counts: dict[str, float] | None
    steps: tuple[tuple[str, str, str], ...] = ()
    invisible: bool = False
    code: str | None = None
    reason: str | None = None

    @property
    def ok(self) -> bool:
        return self.counts is not None


@dataclass
class _Group:
    counts: dict[str, float] = field(default_factory=dict)

    def add(self, symbol: str, n: float) -> None:
        self.counts[symbol] = self.counts.get(symbol, 0.0) + n


class Unreadable(ValueError):
    pass


def fold(raw: str) -> tuple[str, tuple[tuple[str, str, str], ...]]:
    """Folded text and the steps (name, before, after) that changed it, in order."""
    stages = (
        ("strip_format_characters", lambda s: "".join(c for c in s if unicodedata.category(c) != "Cf")),
        ("fold_separators", lambda s: s.translate(_FOLD)),
        ("unicode_nfkc", lambda s: unicodedata.normalize("NFKC", s)),
        ("digit_script_normalize", lambda s: s.translate(_DIGITS)),
        ("strip_whitespace", lambda s: re.sub(r"\s+", "", s)),
    )
    steps, text = [], raw
    for name, stage in stages:
        after = stage(text)
        if after != text:
            steps.append((name, text, after))
            text = after
    return text, tuple(steps)


def _segment(text: str) -> dict[str, float]:
    """Counts of one adduct segment; a leading number multiplies all of it."""
    factor, at = 1.0, 0
    if m := re.match(r"\d+(?:\.\d+)?", text):
        factor, at = float(m[0]), m.end()
        if at == len(text):
            raise Unreadable("a multiplier stands without a formula")
    stack, pending = [_Group()], None
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise Unreadable(f"{text[at]!r} at position {at} is no part of a formula")
        at = m.end()
        if m["number"]:
            if pending is None:
                raise Unreadable(f"the number at position {m.start()} follows nothing")
            group, scale = pending, float(m["number"])
        else:
            group, scale = pending, 1.0
        if pending is not None:
            for s, n in group.items():
                stack[-1].add(s, n * scale)
            pending = None
        if m["symbol"]:
            pending = {m["symbol"]: 1.0}
        elif m["open"]:
            if len(stack) > MAX_NESTING:
                raise Unreadable(f"groups nest more than {MAX_NESTING} deep")
            stack.append(_Group())
        elif m["close"]:
            if len(stack) == 1:
                raise Unreadable("a group is closed that was not opened")
            pending = stack.pop().counts
    if len(stack) > 1:
        raise Unreadable("a group is not closed")
    for s, n in (pending or {}).items():
        stack[0].add(s, n)
    return {s: n * factor for s, n in stack[0].counts.items()}


@lru_cache(maxsize=1 << 14)
def parse(raw: str | None) -> Formula:
    """The formula as it may be used, or why not. Characters of other scripts are refused, never mapped."""
    if not raw:
        return Formula(raw or "", None, None, code="CHEM.FORMULA.UNPARSEABLE", reason="the formula is empty")
    text, steps = fold(raw)
    invisible = bool(steps) and steps[0][0] == "strip_format_characters"

    def refuse(code: str, reason: str, folded: str | None = text) -> Formula:
        return Formula(raw, folded, None, steps, invisible, code, reason)

    if not text.isascii():
        alien = ", ".join(sorted({f"U+{ord(c):04X}" for c in text if not c.isascii()}))
        return refuse("FMT.ENCODING.NON_ASCII_SYMBOL", f"{alien} survives folding; it may look like an element symbol of another script", None)
    if not ALLOWED.match(text):
        return refuse("CHEM.FORMULA.UNPARSEABLE", "characters outside the formula language")
    counts: dict[str, float] = {}
    try:
        for part in (p.strip("+") for p in text.split("*")):
            for s, n in (_segment(part) if part else {}).items():
                counts[s] = counts.get(s, 0.0) + n
    except Unreadable as e:
        return refuse("CHEM.FORMULA.UNPARSEABLE", str(e))
    if not counts:
        return refuse("CHEM.FORMULA.UNPARSEABLE", "no element symbol")
    if unknown := sorted(s for s in counts if s not in NUMBER):
        return refuse("CHEM.FORMULA.UNKNOWN_ELEMENT", f"no such element: {', '.join(unknown)}")
    if min(counts.values()) <= 0:
        return refuse("CHEM.FORMULA.UNPARSEABLE", "a coefficient is not positive")
    return Formula(raw, text, counts, steps, invisible)


def divisor(counts: Mapping[str, float]) -> int:
    """Greatest common divisor of integer coefficients; 1 if any is fractional."""
    values = [*counts.values()]
    return gcd(*(int(v) for v in values)) if values and all(float(v).is_integer() for v in values) else 1


def reduced(counts: Mapping[str, float]) -> dict[str, float]:
    d = divisor(counts)
    return {s: n / d for s, n in counts.items()}


def _amount(n: float) -> str:
    return "" if n == 1 else f"{int(n)}" if float(n).is_integer() else f"{n:g}"


def spell(counts: Mapping[str, float], convention: str = "given") -> str:
    """The reduced formula: in the given order, alphabetical, Hill (carbon, hydrogen, rest), or Hill spaced."""
    r = reduced(counts)
    order = [*r] if convention == "given" else sorted(r)
    if convention in ("hill", "spaced") and "C" in r:
        order = ["C", *(["H"] if "H" in r else []), *(s for s in order if s not in ("C", "H"))]
    return (" " if convention == "spaced" else "").join(s + _amount(r[s]) for s in order)


def key(counts: Mapping[str, float]) -> str:
    """Identity of a composition: sorted reduced coefficients, fractions to six decimals."""
    return "|".join(f"{s}:{int(n) if float(n).is_integer() else round(n, 6)}" for s, n in sorted(reduced(counts).items()))


def scope(counts: Mapping[str, float]) -> str | None:
    """Why the composition is no inorganic crystalline solid; None if it may be one."""
    e = set(counts)
    if e <= {"C", "H"}:
        return "only carbon and hydrogen"
    if {"C", "H"} <= e and not e & METALS:
        return "carbon and hydrogen without a metal"
    if e <= NOBLE_GASES:
        return "only noble gases"
    return None


def metallic(counts: Mapping[str, float]) -> bool:
    """Whether the ionic model does not apply: metals only, or metals with network partners and no anion."""
    e = set(counts)
    return bool(e) and (e <= METALS or bool(e & METALS) and not e & STRONG_ANIONS and e <= METALS | NETWORK_PARTNERS)

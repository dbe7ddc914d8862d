"""Combinatorial and thermochemical functions of one composition."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, product

import numpy as np

from orefold.functions import formula as fm
from orefold.reference import thermochemistry as th
from orefold.reference.elements import ELECTRONEGATIVITY, STATES

Counts = Mapping[str, float]


def assignment(counts: Counts, budget: int = 20_000) -> tuple[str, dict[str, int] | None]:
    """(outcome, states): outcome is balanced, unbalanced or why the ionic model was not applied.

    Elements are taken in order, each with its states in table order; the first neutral combination counts."""
    elements = sorted(counts)
    if not elements:
        return "empty", None
    if fm.metallic(counts):
        return "metallic", None
    if any(e not in STATES for e in elements):
        return "no_states", None
    if any(not float(n).is_integer() for n in counts.values()):
        return "fractional", None
    options = [STATES[e] for e in elements]
    if math.prod(map(len, options)) > budget:
        return "too_many", None
    amounts = [int(counts[e]) for e in elements]
    for states in product(*options):
        if not sum(map(int.__mul__, states, amounts)):
            return "balanced", dict(zip(elements, states))
    return "unbalanced", None


def misplaced_anion(counts: Counts, states: Mapping[str, int] | None) -> str | None:
    """The most electronegative element, if the assignment makes it no anion although an anion is less so."""
    if not states or not any(v < 0 for v in states.values()) or not any(v > 0 for v in states.values()):
        return None
    ranked = sorted((-ELECTRONEGATIVITY[e], e) for e in counts if e in ELECTRONEGATIVITY)
    if not ranked or states.get(ranked[0][1], 0) < 0:
        return None
    best = max(ELECTRONEGATIVITY.get(e, 0.0) for e, s in states.items() if s < 0)
    return ranked[0][1] if -ranked[0][0] > best else None


@dataclass(frozen=True)
class Phase:
    formula: str
    key: str
    counts: dict[str, float]
    ev: float
    atoms: float

    @property
    def per_atom(self) -> float:
        return self.ev / self.atoms


@lru_cache(maxsize=1)
def phases() -> dict[str, Phase]:
    out = {}
    for f, h, _ in th.ENTRIES:
        counts = fm.parse(f).counts
        k = fm.key(counts)
        if k in out:
            raise ValueError(f"{f} and {out[k].formula} are the same composition")
        out[k] = Phase(f, k, counts, h / th.KJ_PER_EV, sum(counts.values()))
    return out


def phase_of(counts: Counts) -> Phase | None:
    return phases().get(fm.key(counts))


@dataclass(frozen=True)
class Hull:
    energy: float | None
    mix: tuple[tuple[str, float], ...]
    own: float | None
    above: float | None
    competing: tuple[str, ...]


def hull(counts: Counts) -> Hull:
    """Lowest energy of known phases at a composition, per atom, and the distance of the compound above it.

    Mixtures of up to n phases in n elements are tried by size, then formula; each is a least-squares
    solution over all elements that must be non-negative and reproduce the composition."""
    return _hull(tuple(sorted(fm.reduced(counts).items())))


@lru_cache(maxsize=1 << 12)
def _inside(elements: frozenset[str]) -> tuple[Phase, ...]:
    """The phases of a chemical system, by formula."""
    return tuple(sorted((p for p in phases().values() if set(p.counts) <= elements), key=lambda p: (p.formula, p.key)))


@lru_cache(maxsize=1 << 12)
def _hull(items: tuple[tuple[str, float], ...]) -> Hull:
    counts = dict(items)
    elements, total = [*counts], sum(counts.values())
    target = np.array([counts[e] / total for e in elements])
    inside = _inside(frozenset(elements))
    own = phase_of(counts)
    if not inside:
        return Hull(None, (), own.per_atom if own else None, None, ())
    columns = {p.key: np.array([p.counts.get(e, 0.0) / p.atoms for e in elements]) for p in inside}
    covers = {p.key: sum(1 << i for i, e in enumerate(elements) if e in p.counts) for p in inside}
    best, mix = None, ()
    for size in range(1, len(elements) + 1):
        for combo in combinations(inside, size):
            seen = 0
            for p in combo:
                seen |= covers[p.key]
            if seen != (1 << len(elements)) - 1:
                continue
            a = np.column_stack([columns[p.key] for p in combo])
            x, _, rank, _ = np.linalg.lstsq(a, target, rcond=None)
            if rank < size or (x < -1e-9).any() or np.abs(a @ x - target).max() > 1e-6:
                continue
            energy = float(sum(xi * p.per_atom for xi, p in zip(x, combo)) / x.sum())
            if best is None or energy < best - 1e-12:
                best, mix = energy, tuple((p.formula, float(xi / x.sum())) for xi, p in zip(x, combo) if xi > 1e-9)
    above = own.per_atom - best if own and best is not None else None
    if above is not None and -1e-9 < above < 0:
        above = 0.0
    return Hull(best, tuple(sorted(mix, key=lambda m: (-m[1], m[0]))), own.per_atom if own else None, above, tuple(p.formula for p in inside))


def oxygen_potential(atmosphere: str, kelvin: float) -> float | None:
    """Oxygen chemical potential in eV against half an O2 at 1 bar; None for a gas without one."""
    kt = th.BOLTZMANN_EV * kelvin
    if atmosphere in th.WATER_RATIO:
        entropy = (th.STEAM_ENTROPY - th.HYDROGEN_ENTROPY - th.OXYGEN_ENTROPY / 2) / 1000
        return (th.STEAM_ENTHALPY - kelvin * entropy) / th.KJ_PER_EV + kt * math.log(th.WATER_RATIO[atmosphere])
    bar = th.OXYGEN_BAR.get(atmosphere)
    return None if bar is None else kt * math.log(bar) / 2


def survival(counts: Counts, atmosphere: str, kelvin: float) -> float | None:
    """Driving force per atom; the oxide survives from 0 on. None without oxygen, phase or potential."""
    r = fm.reduced(counts)
    phase, mu = phase_of(r), oxygen_potential(atmosphere, kelvin)
    return (r["O"] * mu - phase.ev) / phase.atoms if "O" in r and phase is not None and mu is not None else None


def products(counts: Counts, atmosphere: str, kelvin: float) -> tuple[str, ...]:
    """What an oxide that does not survive falls apart into: its metals, and water or oxygen; () if it survives
    or nothing is known."""
    force = survival(counts, atmosphere, kelvin)
    if force is None or force >= 0:
        return ()
    return (*sorted(e for e in counts if e != "O"), "H2O" if atmosphere in th.WATER_RATIO else "O2")


def boundary(counts: Counts) -> float | None:
    """The oxygen potential below which an oxide falls apart; None without oxygen or phase."""
    r = fm.reduced(counts)
    phase = phase_of(r)
    return phase.ev / r["O"] if phase is not None and "O" in r else None


@lru_cache(maxsize=1)
def _entropies() -> dict[str, tuple[float, float, float]]:
    """(entropy in eV/K, atoms, enthalpy) by key."""
    parsed = [(fm.parse(f).counts, h, s) for f, h, s in th.ENTRIES]
    return {fm.key(c): (s / 1000 / th.KJ_PER_EV, sum(c.values()), h) for c, h, s in parsed}


def gibbs(formula: str, kelvin: float) -> float | None:
    """Formation free energy in eV with tabulated entropies; None if any is missing."""
    entropy, phase = _entropies(), phase_of(fm.parse(formula).counts)
    if phase is None:
        return None
    change = entropy[phase.key][0]
    for e, n in phase.counts.items():
        ref = next((entropy[k] for k in (fm.key({e: 1}),) if k in entropy and abs(entropy[k][2]) < 1e-9), None)
        if ref is None:
            return None
        change -= n * ref[0] / ref[1]
    return phase.ev - kelvin * change


Side = tuple[tuple[str, float], ...]


def reaction_energy(left: Side, right: Side) -> tuple[float | None, tuple[str, ...]]:
    """(enthalpy per atom of product, species without data); the energy is None if any species lacks data."""
    total, atoms, missing = 0.0, 0.0, set()
    for sign, side in ((-1, left), (1, right)):
        for species, n in side:
            f = fm.parse(species)
            phase = phase_of(f.counts) if f.ok else None
            if phase is None:
                missing.add(species)
                continue
            scale = sum(f.counts.values()) / phase.atoms
            total += sign * phase.ev * n * scale
            atoms += phase.atoms * n * scale if sign > 0 else 0
    return (None if missing or atoms <= 0 else total / atoms), tuple(sorted(missing))


@dataclass(frozen=True)
class Route:
    family: str
    left: Side
    right: Side
    balanced: bool
    energy: float | None
    rank: int = 0


@lru_cache(maxsize=1)
def _precursors() -> tuple[dict[str, str], dict[str, str]]:
    def by_metal(names: list[str]) -> dict[str, str]:
        return {next(e for e in fm.parse(n).counts if e not in ("O", "C")): n for n in names}

    return by_metal(th.OXIDES), by_metal(th.CARBONATES)


def is_balanced(left: Side, right: Side) -> bool:
    """Whether both sides hold the same amount of every element."""
    total: dict[str, float] = {}
    for sign, side in ((1, left), (-1, right)):
        for species, n in side:
            for e, k in (fm.parse(species).counts or {}).items():
                total[e] = total.get(e, 0.0) + sign * n * k
    return all(abs(v) < 1e-6 for v in total.values())


def _balance(target: dict[str, float], chosen: dict[str, str]) -> tuple[Side, Side]:
    """One formula unit from the precursors: metals first, carbon leaves as CO2, oxygen makes up the rest."""
    left = {name: target[metal] / fm.parse(name).counts[metal] for metal, name in chosen.items()}
    carbon = sum(n * fm.parse(s).counts.get("C", 0.0) for s, n in left.items())
    oxygen = sum(n * fm.parse(s).counts.get("O", 0.0) for s, n in left.items()) - 2 * carbon - target.get("O", 0.0)
    right = {fm.spell(target): 1.0}
    if carbon > 0:
        right["CO2"] = carbon
    if oxygen > 1e-12:
        right["O2"] = oxygen / 2
    elif oxygen < -1e-12:
        left["O2"] = -oxygen / 2
    return tuple(sorted(left.items())), tuple(sorted(right.items()))


def routes(counts: Counts, limit: int = 3) -> list[Route]:
    """Routes from oxides, carbonates and elements, by energy (unknown last), then family."""
    target = fm.reduced(counts)
    metals = sorted(e for e in target if e not in ("O", "C"))
    if not metals:
        return []
    oxide, carbonate = _precursors()
    families: list[tuple[str, dict[str, str]]] = []
    if "O" in target:
        own = all(m in oxide for m in metals)
        if own and not (len(metals) == 1 and fm.parse(oxide[metals[0]]).counts == target):
            families.append(("binary_oxide", {m: oxide[m] for m in metals}))
        if any(m in carbonate for m in metals) and all(m in carbonate or m in oxide for m in metals):
            families.append(("carbonate", {m: carbonate.get(m) or oxide[m] for m in metals}))
    families.append(("element", {m: m for m in metals}))
    found = []
    for family, chosen in families[:limit]:
        left, right = _balance(target, chosen)
        energy = reaction_energy(left, right)[0]
        found.append(Route(f"route-{family}", left, right, is_balanced(left, right), None if energy is None else round(energy, 6)))
    found.sort(key=lambda r: (r.energy is None, r.energy or 0.0, r.family))
    return [Route(r.family, r.left, r.right, r.balanced, r.energy, i) for i, r in enumerate(found[:limit], 1)]


def precursor_name(text: str) -> str:
    """The formula part of a precursor's name: without what stands in brackets, up to the first blank."""
    bare = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", text).split()
    return bare[0] if bare else ""


def lower_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Lower convex hull of points, left to right."""
    out: list[tuple[float, float]] = []
    for p in sorted(points):
        while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
            out.pop()
        out.append(p)
    return out

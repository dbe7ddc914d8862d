"""Formulas, chemistry, geometry and text functions against known anchors."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orefold.functions import chemistry as ch
from orefold.functions import formula as fm
from orefold.functions import geometry as g
from orefold.functions import text as tx
from orefold.operators import repair
from orefold.reference import elements as el


@pytest.mark.parametrize(
    ("raw", "key"),
    [("TiO2", "O:2|Ti:1"), ("Ti2O4", "O:2|Ti:1"), ("Fe₂O₃", "Fe:2|O:3"), ("Ｆｅ２Ｏ３", "Fe:2|O:3"), ("Fe​2O3", "Fe:2|O:3"), ("CuSO4·5H2O", "Cu:1|H:10|O:9|S:1"), ("Ca(OH)2", "Ca:1|H:2|O:2"), ("K4[Fe(CN)6]", "C:6|Fe:1|K:4|N:6"), (" Na Cl ", "Cl:1|Na:1")],
)
def test_spellings_share_a_key(raw, key):
    assert fm.key(fm.parse(raw).counts) == key


@pytest.mark.parametrize(
    ("raw", "code"),
    [("ТiO2", "FMT.ENCODING.NON_ASCII_SYMBOL"), ("СO2", "FMT.ENCODING.NON_ASCII_SYMBOL"), ("Xx2O", "CHEM.FORMULA.UNKNOWN_ELEMENT"), ("", "CHEM.FORMULA.UNPARSEABLE"), (None, "CHEM.FORMULA.UNPARSEABLE"), ("(NaCl", "CHEM.FORMULA.UNPARSEABLE"), ("NaCl)", "CHEM.FORMULA.UNPARSEABLE"), ("2", "CHEM.FORMULA.UNPARSEABLE"), ("na", "CHEM.FORMULA.UNPARSEABLE"), ("Na0Cl", "CHEM.FORMULA.UNPARSEABLE"), ("(" * 9 + "Na" + ")" * 9, "CHEM.FORMULA.UNPARSEABLE"), ("Na" * 150, "CHEM.FORMULA.UNPARSEABLE"), ("Na$Cl", "CHEM.FORMULA.UNPARSEABLE")],
)
def test_rejections(raw, code):
    f = fm.parse(raw)
    assert not f.ok and f.code == code


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.sampled_from(el.SYMBOLS), st.integers(1, 30), min_size=1, max_size=6), st.integers(1, 5))
def test_reduction_and_round_trip(counts, factor):
    k = fm.key(counts)
    assert fm.key({s: n * factor for s, n in counts.items()}) == k
    for convention in ("given", "alphabetical", "hill"):
        again = fm.parse(fm.spell(counts, convention))
        assert again.ok and fm.key(again.counts) == k
    assert fm.divisor(fm.reduced(counts)) == 1


def test_decimal_point_is_an_adduct_dot():
    assert fm.parse("Sr1.5O").counts == {"Sr": 1.0, "O": 5.0} and not fm.parse("Li0.98FePO4").ok


@pytest.mark.parametrize(("raw", "outcome"), [("Fe2O3", "balanced"), ("NaCl", "balanced"), ("MgB2", "metallic"), ("TiAl", "metallic"), ("WC", "metallic"), ("Fe17O23", "unbalanced"), ("Fe3O4", "unbalanced"), ("HeO", "no_states")])
def test_charge(raw, outcome):
    assert ch.assignment(fm.parse(raw).counts)[0] == outcome


def test_charge_budget_skips_and_order_decides():
    assert ch.assignment({"N": 1, "P": 1, "Cl": 1, "S": 1}, 10)[0] == "too_many"
    assert ch.assignment({"Fe": 1, "O": 1.5})[0] == "fractional"
    assert ch.assignment(fm.parse("FeO").counts)[1] == {"Fe": 2, "O": -2}


@pytest.mark.parametrize("raw", ["TiO2", "Fe2O3", "Fe3O4", "MgO", "Al2O3", "NaCl", "BaTiO3", "MgB2", "SiC"])
def test_stable_compounds_lie_on_the_hull(raw):
    assert ch.hull(fm.parse(raw).counts).above == pytest.approx(0, abs=1e-9)


def test_wuestite_decomposes():
    h = ch.hull(fm.parse("FeO").counts)
    assert h.above == pytest.approx(0.039384, abs=1e-6) and [m[0] for m in h.mix] == ["Fe3O4", "Fe"]
    assert ch.hull(fm.parse("Fe4O4").counts) == h and ch.hull({"Xe": 1.0}).energy is None


def test_reduction_by_hydrogen_follows_the_known_order():
    at = lambda f, t=1223.15: ch.survival(fm.parse(f).counts, "H2", t)
    assert all(at(f) < 0 for f in ("CuO", "Cu2O", "NiO", "Fe2O3")) and all(at(f) >= 0 for f in ("TiO2", "Al2O3", "MgO", "SiO2", "Cr2O3", "ZrO2"))
    assert at("Fe2O3", 973.15) == pytest.approx(0.0105, abs=1e-4) and at("Fe4O6", 1273.15) == pytest.approx(-0.0494, abs=1e-4)
    assert -3.4 < ch.oxygen_potential("H2", 1223.15) < -2.4 and ch.oxygen_potential("He", 1000) is None and at("NaCl") is None
    assert ch.gibbs("TiO2", 298.15) == pytest.approx(-9.21, abs=0.02) and ch.gibbs("XeF2", 300) is None


@pytest.mark.parametrize("raw", ["BaTiO3", "LiFePO4", "FeO", "Ba2ScNbO6", "NaCl", "Fe4O6", "MgSiO3"])
def test_routes_balance(raw):
    routes = ch.routes(fm.parse(raw).counts)
    assert routes and all(ch.is_balanced(r.left, r.right) and r.balanced for r in routes)
    energies = [r.energy for r in routes]
    assert energies == sorted(energies, key=lambda e: (e is None, e or 0))


def test_routes_by_family():
    got = {r.family: r for r in ch.routes(fm.parse("BaTiO3").counts)}
    assert set(got) == {"route-binary_oxide", "route-carbonate", "route-element"}
    assert ("CO2", 1.0) in got["route-carbonate"].right and "route-binary_oxide" not in {r.family for r in ch.routes(fm.parse("TiO2").counts)}
    assert ch.reaction_energy((("Zz", 1.0),), (("TiO2", 1.0),)) == (None, ("Zz",)) and ch.routes({"O": 2.0}) == []


def test_precursor_names():
    assert ch.precursor_name("TiO2 (anatase)") == "TiO2" and ch.precursor_name("Fe(NO3)3.9H2O") == "Fe" and ch.precursor_name("[x]") == ""


def test_lower_hull():
    assert ch.lower_hull([(0, 0), (0.5, -1), (0.6, 0.5), (1, 0)]) == [(0, 0), (0.5, -1), (1, 0)]


def test_shortest_distance():
    cube = (4.0, 4.0, 4.0, 90.0, 90.0, 90.0)
    assert g.shortest(np.array([[0, 0, 0]]), cube) == (4.0, 0, 0)
    d, i, j = g.shortest(np.array([[0.05, 0, 0], [0.5, 0.5, 0.5], [0.95, 0, 0]]), cube)
    assert d == pytest.approx(0.4) and (i, j) == (0, 2)
    assert g.shortest(np.zeros((0, 3)), cube) is None and g.shortest(np.zeros((1, 3)), (1, 1, 1, 90, 90, 0.0)) is None
    rng = np.random.default_rng(1)
    f, cell = rng.random((6, 3)), (5.0, 6.0, 7.0, 80.0, 95.0, 110.0)
    v = g.vectors(cell)
    brute = min(np.linalg.norm((f[b] + s - f[a]) @ v) for a in range(6) for b in range(a, 6) for s in g.SHIFTS if not (a == b and not s.any()))
    assert g.shortest(f, cell)[0] == pytest.approx(brute)


@pytest.mark.parametrize(("v", "want"), [(1234567.0, 1234570.0), (-0.0, 0.0), (0.000123456789, 0.000123457), (None, None), (math.inf, math.inf)])
def test_significant(v, want):
    got = tx.significant(v)
    assert got == want and not (got == 0 and math.copysign(1, got) < 0)


def test_canonical_keeps_or_escapes_other_scripts():
    assert tx.canonical({"b": 1.0, "a": "é"}) == '{"a":"é","b":1.0}' and tx.canonical("é", ascii_only=True) == '"\\u00e9"'
    assert tx.rounded({"a": [1.23456789, "x"]}) == {"a": [1.23457, "x"]}


def test_patches():
    doc = {"a": [1, 2, 3], "b/c": {"~": 1}}
    assert repair.apply(doc, [{"op": "remove", "path": "/a/1"}, {"op": "replace", "path": "/b~1c/~0", "value": 5}, {"op": "add", "path": "/a/-", "value": 9}]) == {"a": [1, 3, 9], "b/c": {"~": 5}}
    assert doc["a"] == [1, 2, 3]
    for bad in ({"op": "replace", "path": "/x", "value": 1}, {"op": "remove", "path": "/a/9"}, {"op": "replace", "path": "", "value": 1}):
        with pytest.raises((KeyError, IndexError)):
            repair.apply(doc, [bad])
    assert repair.distance(doc, [{"op": "replace", "path": "/a", "value": [1]}]) == len("[1, 2, 3]") - len("[1]")


def test_no_repair_for_alien_symbols():
    assert repair.propose({"proposal_id": "p", "composition": {"formula": "ТiO2"}}, [("FMT.ENCODING.NON_ASCII_SYMBOL", "/composition/formula")]) == []
    long = repair.propose({"proposal_id": "p" * 64, "composition": {"formula": "Fe4O6"}}, [("CHEM.FORMULA.NOT_REDUCED", "/composition/formula")])
    assert len(long[0]["repair_id"]) == 64 and long[0]["patch"][0]["value"] == "Fe2O3"

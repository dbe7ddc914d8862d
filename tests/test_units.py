from __future__ import annotations

import pytest

from orefold.functions import units
from orefold.operators import unify_units


@pytest.mark.parametrize(
    ("quantity", "unit", "value", "want"),
    [
        ("band_gap", "meV", 1500, 1.5), ("band_gap", "mEV", 1500, 1.5), ("band_gap", "10^-3 eV", 1500, 1.5), ("band_gap", "kJ·mol−1", 96.485, 1.0), ("band_gap", "kcal mol-1", 23.0605, 1.0),
        ("band_gap", "Ha", 1, 27.211386), ("formation_energy", "rydbergs", 2, 27.211386), ("density", "kg/m³", 4230, 4.23), ("density", "mg per cubic centimetre", 4230, 4.23), ("density", "g/cc", 4.23, 4.23),
        ("bulk_modulus", "N/mm2", 5000, 5), ("bulk_modulus", "10^0 Pa", 5e9, 5), ("bulk_modulus", "kbar", 50, 5), ("melting_point", "°F", 32, 273.15), ("melting_point", "C", 0, 273.15), ("melting_point", "degrees Celsius", -273.15, 0),
        ("average_voltage", "millivolt", 2760, 2.76), ("theoretical_capacity", "C/g", 3.6, 1), ("theoretical_capacity", "ampere hours per gram", 1, 1000), ("theoretical_capacity", "mAh/kg", 1000, 1),
        ("ionic_conductivity", "S m^-1", 100, 1), ("ionic_conductivity", "mS cm-1", 1000, 1), ("lattice", "a.u.", 1, 0.529177210903), ("lattice", "nm", 1, 10), ("lattice", "picometres", 100, 1), ("lattice", "A", 3, 3),
    ],
)
def test_conversion(quantity, unit, value, want):
    scale, offset = units.conversion(quantity, unit)
    assert value * scale + offset == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(("quantity", "unit"), [("band_gap", "kg"), ("density", "furlong"), ("lattice", "F"), ("melting_point", "eV"), ("nothing", "eV"), ("band_gap", "°C/m")])
def test_other_dimensions_are_refused(quantity, unit):
    assert units.conversion(quantity, unit) is None


@pytest.mark.parametrize(
    ("text", "scale", "dims"),
    [
        ("(J/mol)*K", 1, (2, 1, -2, 0, 1, -1)), ("J/(mol*K)", 1, (2, 1, -2, 0, -1, -1)), ("J/mol·K", 1, (2, 1, -2, 0, -1, -1)), ("J/mol K", 1, (2, 1, -2, 0, -1, -1)), ("m/s*kg", 1, (1, 1, -1, 0, 0, 0)), ("m/s/s", 1, (1, 0, -2, 0, 0, 0)),
        ("ft", 0.3048, (1, 0, 0, 0, 0, 0)), ("Da/Å^3", 1.66053906660e3, (-3, 1, 0, 0, 0, 0)), ("psi", 6894.757293168, (-1, 1, -2, 0, 0, 0)), ("Torr", 101325 / 760, (-1, 1, -2, 0, 0, 0)), ("mmHg", 133.322387415, (-1, 1, -2, 0, 0, 0)),
        ("Ohm^-1 cm^-1", 100, (-3, -1, 3, 2, 0, 0)), ("inches", 0.0254, (1, 0, 0, 0, 0, 0)), ("cubic centimetres per mole", 1e-6, (3, 0, 0, 0, 0, -1)), ("(m/s)^2", 1, (2, 0, -2, 0, 0, 0)), ("10^3 kg/m3", 1e3, (-3, 1, 0, 0, 0, 0)), ("min", 60, (0, 0, 1, 0, 0, 0)),
    ],
)
def test_grammar(text, scale, dims):
    unit = units.parse_unit(text)
    assert unit.dims == dims and unit.scale == pytest.approx(scale, rel=1e-9)


@pytest.mark.parametrize("text", ["", "  ", "(m", "m)", "m//s", "/s", "m^", "*", "((((((((((((((((((m))))))))))))))))))", "°C*m", "°C^2", "10^3", "furlong per fortnight", "x" * 5000])
def test_what_is_no_unit(text):
    assert units.parse_unit(text) is None


def test_a_symbol_of_two_meanings_is_read_as_the_one_that_fits():
    assert units.conversion("density", "Da/A3")[0] == pytest.approx(1.66053906660) and units.conversion("lattice", "A")[0] == pytest.approx(1)


@pytest.mark.parametrize(
    ("text", "unit"),
    [
        ("Please read every band gap (in kJ per mole) as such.", "kJ per mole"), ("For the band gap we adopt hartree units.", "hartree"), ("The band gap was 3.2 eV last time.", None), ("A gap of 1.1 eV; K was not used for the band gap.", None), ("The band gap in V is unknown.", None), ("J were used for the band gap.", "J"),
        ("Cheap. The band gap is given in hartrees. Stable.", "hartrees"), ("Units: band gap in meV.", "meV"), ("meV were used for the band gap.", "meV"), ("All band gap figures below are kcal/mol.", "kcal/mol"), ("We quote the band gap in Ry here.", "Ry"),
        ("The band gap is not in hartrees.", None), ("Older cards had the band gap in hartrees; it has been brought to the common unit.", None), ("Other groups state the band gap in meV, which we do not.", None), ("The melting point is given in F.", None), ("", None),
    ],
)
def test_statements(text, unit):
    assert units.stated_unit("band_gap", text) == unit


@pytest.mark.parametrize(
    ("text", "unit"),
    [("Set point in °C.", "°C"), ("Hold as logged (degrees Fahrenheit).", "degrees Fahrenheit"), ("°F, as on the controller.", "°F"), ("Do not hold above 900 °C for long.", None), ("Heat to 900 °C.", None), ("Controller shows degrees Celsius but the figure here is in kelvin.", "kelvin"), ("Slow ramp.", None)],
)
def test_notes(text, unit):
    assert units.noted_temperature_unit(text) == unit


SCHEMA = (
    "proposal_no bigint, structure struct<lattice:struct<a:double,b:double,c:double,length_unit:string>>, claimed_properties array<struct<name:string,value:double,unit:string>>, "
    "synthesis_hint struct<temperature:double,temperature_unit:string,notes:string>, rationale string, status string, pos int"
)


def test_proposals(spark):
    data = [
        (1, (((1.0, 2.0, None, "nm"),)), [("band_gap", 1500.0, "meV"), None, ("band_gap", 2.0, " eV"), ("density", None, "kg/m3")], (32.0, "F", None), None, "x", 9),
        (2, ((3.0, 3.0, 3.0, None),), [("band_gap", 1.0, None), ("band_gap", 1000.0, " ")], (0.0, None, "Set point in °C."), "Units: cell edges in bohr radii. We quote the band gap in meV here.", None, None),
        (3, None, None, None, None, None, None),
        (4, ((3.0, 3.0, 3.0, "parsec"),), [("colour", 1.0, "nm"), ("band_gap", -999.0, "eV")], (500.0, " ", None), None, None, None),
    ]
    data[0] = (1, ((1.0, 2.0, None, "nm"),), *data[0][2:])
    df = spark.createDataFrame(data, SCHEMA)
    got = sorted(tuple(r) for r in unify_units.converted(df, "proposal_no").collect())
    assert got == [
        (1, "claim", 0, 1500), (1, "lattice", 0, 10000), (1, "lattice", 1, 20000), (1, "temperature", 0, 273150),
        (2, "claim", 0, 1), (2, "claim", 1, 1000), (2, "lattice", 0, 1588), (2, "lattice", 1, 1588), (2, "lattice", 2, 1588), (2, "temperature", 0, 273150),
    ]
    assert {r.status for r in unify_units.common_units(df, "proposal_no").where("proposal_no = 4").collect()} == {"unknown", "same"}
    assert unify_units.converted(df.limit(0), "proposal_no").count() == 0

"""Claimed properties: canonical unit, physical minimum, plausible range; and factors of unit tokens."""

from __future__ import annotations

# Property canonical-unit physical-minimum plausible-minimum plausible-maximum.
_SPECS = """
band_gap eV 0 0 20
density g/cm3 0 0.5 25
melting_point K 0 100 4500
boiling_point K 0 100 6000
critical_temperature K 0 0 250
curie_temperature K 0 0 1500
neel_temperature K 0 0 1500
magnetic_ordering_temperature K 0 0 1500
glass_transition_temperature K 0 100 2000
average_voltage V - -6 6
theoretical_capacity mAh/g 0 0 4000
dielectric_constant 1 1 1 100000
ionic_conductivity S/cm 0 0 100
bulk_modulus GPa 0 0 500
shear_modulus GPa 0 0 500
formation_energy eV - -20 10
"""
SPECS = [(n, u, None if m == "-" else float(m), float(a), float(b)) for n, u, m, a, b in (line.split() for line in _SPECS.split("\n") if line)]
# Canonical unit, folded token, factor, offset. The empty token is dimensionless too.
_FACTORS = """
eV ev 1 0
eV mev 1e-3 0
eV kev 1e3 0
eV j 6.241509074e18 0
eV kj/mol 0.01036410 0
eV kcal/mol 0.04336410 0
eV hartree 27.211386 0
eV ry 13.605693 0
eV rydberg 13.605693 0
eV cm-1 1.239841984e-4 0
K k 1 0
K kelvin 1 0
K c 1 273.15
K degc 1 273.15
K celsius 1 273.15
K f 0.5555555555555556 255.37222222222223
K degf 0.5555555555555556 255.37222222222223
g/cm3 g/cm3 1 0
g/cm3 g/cc 1 0
g/cm3 g/ml 1 0
g/cm3 kg/l 1 0
g/cm3 kg/m3 1e-3 0
g/cm3 mg/cm3 1e-3 0
V v 1 0
V mv 1e-3 0
V kv 1e3 0
mAh/g mah/g 1 0
mAh/g ah/g 1e3 0
mAh/g mah/kg 1e-3 0
1 1 1 0
1 dimensionless 1 0
1 none 1 0
1 - 1 0
S/cm s/cm 1 0
S/cm siemens/cm 1 0
S/cm s/m 0.01 0
S/cm ms/cm 1e-3 0
GPa gpa 1 0
GPa mpa 1e-3 0
GPa pa 1e-9 0
GPa kbar 0.1 0
GPa bar 1e-4 0
"""
FACTORS = [(c, t, float(f), float(o)) for c, t, f, o in (line.split() for line in _FACTORS.split("\n") if line)] + [("1", "", 1.0, 0.0)]
# Placeholder magnitudes and the value above which arithmetic overflows.
SENTINEL_EXACT = (-1.0, -9.0, -99.0, -999.0, -9999.0, -99999.0)
SENTINEL_MAGNITUDES = (99.0, 999.0, 9999.0, 99999.0, 999999.0, 9999999.0)
OVERFLOW = 1e30

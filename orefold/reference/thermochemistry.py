"""Formation enthalpies (kJ/mol at 298.15 K) and standard entropies (J/mol/K) of phases."""

from __future__ import annotations

# Formula, enthalpy, entropy. Elements in their reference state have enthalpy 0.
_TABLE = """
H2 0 130.7
O2 0 205.2
N2 0 191.6
Cl2 0 223.1
C 0 5.7
S 0 32.1
P 0 41.1
B 0 5.9
Si 0 18.8
Al 0 28.3
Mg 0 32.7
Ca 0 41.6
Sr 0 55
Ba 0 62.5
Li 0 29.1
Na 0 51.3
K 0 64.7
Ti 0 30.7
Zr 0 39
V 0 28.9
Nb 0 36.4
Ta 0 41.5
Cr 0 23.8
Mo 0 28.7
W 0 32.6
Mn 0 32
Fe 0 27.3
Co 0 30
Ni 0 29.9
Cu 0 33.2
Zn 0 41.6
Ag 0 42.6
Pb 0 64.8
Sn 0 51.2
Y 0 44.4
La 0 56.9
Ce 0 72
Sc 0 34.6
Ga 0 40.9
In 0 57.8
Bi 0 56.7
Ge 0 31.1
Hf 0 43.6
H2O -285.83 69.9
CO2 -393.51 213.8
CO -110.53 197.7
Li2O -597.9 37.6
Na2O -414.2 75.1
K2O -363.2 94.1
MgO -601.6 27
CaO -634.9 38.1
SrO -592 54.4
BaO -553.5 70.4
Al2O3 -1675.7 50.9
SiO2 -910.7 41.5
TiO2 -944 50.6
ZrO2 -1100.6 50.4
HfO2 -1144.7 59.3
V2O5 -1550.6 131
Nb2O5 -1899.5 137.2
Ta2O5 -2046 143.1
Cr2O3 -1139.7 81.2
MoO3 -745.1 77.7
WO3 -842.9 75.9
MnO -385.2 59.7
MnO2 -520 53.1
Mn2O3 -959 110.5
Mn3O4 -1387.8 155.6
FeO -272 60.8
Fe2O3 -824.2 87.4
Fe3O4 -1118.4 146.1
CoO -237.9 53
Co3O4 -891 102.5
NiO -239.7 38
CuO -157.3 42.6
Cu2O -168.6 93.1
ZnO -350.5 43.7
Ga2O3 -1089.1 85
In2O3 -925.8 104.2
SnO2 -580.7 52.3
PbO -219 66.5
Bi2O3 -573.9 151.5
Y2O3 -1905.3 99.1
La2O3 -1793.7 127.3
CeO2 -1088.7 62.3
Sc2O3 -1908.8 77
GeO2 -580 39.7
B2O3 -1273.5 54
P2O5 -1504.9 114.5
Sb2O3 -708.8 123
LiF -616 35.7
NaF -576.6 51.1
NaCl -411.2 72.1
KCl -436.5 82.6
KBr -393.8 95.9
NaI -287.8 98.5
AgCl -127 96.3
CaF2 -1228 68.5
MgF2 -1124.2 57.2
BaF2 -1207.1 96.4
CuCl2 -220.1 108.1
FeCl3 -399.5 142.3
ZnS -206 57.7
PbS -100.4 91.2
CdS -161.9 64.9
FeS2 -178.2 52.9
Ag2S -32.6 144
MoS2 -235.1 62.6
AlN -318 20.2
GaN -156.8 29.7
Si3N4 -744 113
BN -254.4 14.8
TiN -337.7 30.3
ZrN -365.3 38.9
VN -217.2 37.3
SiC -73.2 16.6
TiC -184.1 24.2
WC -38 35.5
Fe3C 25.1 104.6
TiB2 -323.8 28.5
ZrB2 -322.6 35.9
MgB2 -92 36
Mg2Si -77.8 75.9
Li2CO3 -1215.9 90.4
Na2CO3 -1130.7 135
K2CO3 -1151 155.5
MgCO3 -1095.8 65.7
CaCO3 -1207.6 91.7
SrCO3 -1220.1 97.1
BaCO3 -1213 112.1
CaSO4 -1434.5 106.5
BaSO4 -1473.2 132.2
CuSO4 -771.4 109.2
MgSO4 -1284.9 91.6
KNO3 -494.6 133.1
NaNO3 -467.9 116.5
BaTiO3 -1659.8 107.9
SrTiO3 -1672.4 108.8
CaTiO3 -1660.6 93.6
MgAl2O4 -2299.1 80.6
Mg2SiO4 -2174 95.1
Fe2SiO4 -1479.9 145.2
CaSiO3 -1634.9 81.9
MgSiO3 -1548.5 67.8
ZrSiO4 -2033.4 84
AlPO4 -1733.8 90.8
"""
ENTRIES = [(f, float(h), float(s)) for f, h, s in (line.split() for line in _TABLE.split("\n") if line)]

# Conversions and the gases that set the oxygen potential.
KJ_PER_EV = 96.485
BOLTZMANN_EV = 8.617333262e-5
OXYGEN_BAR = {"O2": 1.0, "air": 0.21, "CO2": 1e-4, "Ar": 1e-6, "N2": 1e-6, "sealed_ampoule": 1e-8, "vacuum": 1e-10}
WATER_RATIO = {"H2": 1e-4, "forming_gas": 1e-3, "NH3": 1e-4}
STEAM_ENTHALPY, STEAM_ENTROPY, HYDROGEN_ENTROPY, OXYGEN_ENTROPY = -241.83, 188.8, 130.7, 205.2
# Laboratory precursors, oxides and carbonates.
OXIDES = "Li2O Na2O K2O MgO CaO SrO BaO Al2O3 SiO2 TiO2 ZrO2 HfO2 V2O5 Nb2O5 Ta2O5 Cr2O3 MoO3 WO3 MnO2 Fe2O3 Co3O4 NiO CuO ZnO Y2O3 La2O3 CeO2 Sc2O3 Ga2O3 In2O3 SnO2 PbO Bi2O3 P2O5 B2O3 GeO2".split()
CARBONATES = "Li2CO3 Na2CO3 K2CO3 MgCO3 CaCO3 SrCO3 BaCO3".split()

"""Reference corpora: what each provider knows, and how it answers."""

from __future__ import annotations

from dataclasses import dataclass

# Formulas, in the order of the identifiers.
_EXPERIMENTAL = """
TiO2
Fe2O3
Fe3O4
FeO
LiFePO4
MgB2
Al2O3
SiO2
ZnO
NaCl
KCl
CaCO3
CaO
MgO
BaTiO3
SrTiO3
CaTiO3
PbTiO3
LiCoO2
LiMn2O4
LiNiO2
YBa2Cu3O7
La2CuO4
Nb2O5
V2O5
WO3
MoO3
Cr2O3
MnO2
Mn2O3
Mn3O4
Co3O4
NiO
CuO
Cu2O
Ag2O
Ag2S
ZnS
CdS
PbS
FeS2
MoS2
WS2
TiN
AlN
GaN
Si3N4
BN
SiC
WC
TiC
B4C
CaF2
BaF2
MgF2
LiF
NaF
KBr
NaI
AgCl
CuCl2
FeCl3
ZrO2
HfO2
Y2O3
La2O3
CeO2
Sc2O3
Ga2O3
In2O3
SnO2
PbO
Bi2O3
Sb2O3
GeO2
BaO
SrO
Li2O
Na2O
K2O
Li2CO3
Na2CO3
BaCO3
SrCO3
MgCO3
CaSO4
BaSO4
CuSO4
MgSO4
KNO3
NaNO3
AlPO4
ZrSiO4
Mg2SiO4
Fe2SiO4
CaSiO3
MgSiO3
MgAl2O4
FeAl2O4
ZnAl2O4
NiFe2O4
CoFe2O4
ZnFe2O4
BaFe12O19
LaMnO3
LaFeO3
LaCoO3
LaNiO3
LaAlO3
SrRuO3
KNbO3
NaNbO3
LiNbO3
LiTaO3
BiFeO3
YMnO3
Ba2ScNbO6
Sr2FeMoO6
K2NiF4
Y3Al5O12
Y3Fe5O12
Li7La3Zr2O12
Li10GeP2S12
Li3PO4
LiPF6
Al
Fe
Cu
Ti
Mg
Si
C
B
Nb3Sn
NbTi
Ni3Al
Fe3C
TiAl
CrN
VN
ZrN
TaC
VC
CaB6
LaB6
TiB2
ZrB2
Mg2Si
Bi2Te3
PbTe
SnSe
CdTe
GaAs
InP
CuInSe2
Cu2ZnSnS4
"""
_MINERAL = """
Fe2O3
SiO2
CaCO3
NaCl
FeS2
MgAl2O4
Al2SiO5
KAlSi3O8
NaAlSi3O8
CaAl2Si2O8
Fe2SiO4
TiO2
ZnS
BaSO4
CaSO4
CaF2
Cu2O
MnO2
CaMgSi2O6
KAlSi2O6
"""
_COMPUTED = """
BaScO3
SrScO3
CaScO3
BaZrO3
SrZrO3
BaHfO3
SrHfO3
LaScO3
YAlO3
YScO3
Ba2ScTaO6
Ba2YNbO6
Ba2InNbO6
Sr2ScNbO6
Ca2ScNbO6
Li2MnO3
Li2TiO3
Li2ZrO3
LiVPO4F
LiMnPO4
LiCoPO4
LiNiPO4
NaFePO4
NaMnPO4
Ca2SiO4
Sr2SiO4
Ba2SiO4
TiO
Ti2O3
Ti3O5
Ti4O7
V2O3
VO2
NbO2
Ta2O5
MoO2
ZnTiO3
MgTiO3
CoTiO3
NiTiO3
MnTiO3
FeTiO3
TaON
BAs
BSb
AlSb
GaSb
InSb
ZnSe
ZnTe
MgSe
CaSe
Fe4O5
Fe5O6
Fe4O7
"""
# Formula and number of documents, in the order of the identifiers.
_LITERATURE = """
TiO2 4821
Fe2O3 3944
LiFePO4 2610
MgB2 1877
BaTiO3 2304
SrTiO3 1988
YBa2Cu3O7 2765
ZnO 3512
Al2O3 2901
GaN 2233
WO3 1120
V2O5 1004
Nb2O5 812
Cr2O3 655
K2NiF4 402
SiO2 4102
NaCl 1533
LiCoO2 1744
Li7La3Zr2O12 921
Ba2ScNbO6 47
SrRuO3 588
LaMnO3 1203
Bi2Te3 1655
MoS2 2988
Cu2ZnSnS4 977
CuInSe2 1244
Si3N4 1390
TiN 1077
ZrO2 2044
CeO2 1602
Fe3O4 2455
Fe17O23 0
PbTiO3 1188
LiNbO3 1466
MgAl2O4 833
CaCO3 2711
MgO 1955
CaF2 744
CuSO4*5H2O 288
C8H8 1902
"""


@dataclass(frozen=True)
class Provider:
    """mode replay: what was never asked is unavailable; mode snapshot: what is absent is a miss."""

    name: str
    mode: str
    evidence: str
    spelling: str
    prefix: str
    width: int
    table: str

    def entries(self) -> list[tuple[str, str, int | None]]:
        """(formula, identifier, number of documents or None)."""
        lines = [x.split() for x in self.table.split("\n") if x]
        return [(x[0], f"{self.prefix}-{i:0{self.width}d}", int(x[1]) if len(x) > 1 else None) for i, x in enumerate(lines, 1)]


#: The version of all reference tables.
SNAPSHOT = "2026.03-r1"
# The providers in their order.
PROVIDERS = (
    Provider("experimental_snapshot", "snapshot", "experimental", "hill", "exp", 5, _EXPERIMENTAL),
    Provider("mineral_reference", "snapshot", "experimental", "alphabetical", "min", 4, _MINERAL),
    Provider("computed_snapshot", "snapshot", "computed", "alphabetical", "cmp", 4, _COMPUTED),
    Provider("literature_cassette", "replay", "literature", "spaced", "lit", 4, _LITERATURE),
)
# Strongest evidence first, with the tier a hit establishes and its confidence.
TIERS = (("experimental", "experimentally_reported", 0.9), ("computed", "computed_only", 0.7), ("literature", "literature_mention", 0.7))

"""Elements: symbol, standard atomic weight, Pauling electronegativity, common oxidation states."""

from __future__ import annotations

# One element per line in order of atomic number; "-" where there is no value.
_TABLE = """
H 1.008 2.2 1,-1
He 4.0026 - -
Li 6.94 0.98 1
Be 9.0122 1.57 2
B 10.81 2.04 3
C 12.011 2.55 4,-4,2
N 14.007 3.04 -3,3,5
O 15.999 3.44 -2
F 18.998 3.98 -1
Ne 20.18 - -
Na 22.99 0.93 1
Mg 24.305 1.31 2
Al 26.982 1.61 3
Si 28.085 1.9 4,-4
P 30.974 2.19 -3,3,5
S 32.06 2.58 -2,4,6
Cl 35.45 3.16 -1,1,3,5,7
Ar 39.948 - -
K 39.098 0.82 1
Ca 40.078 1.0 2
Sc 44.956 1.36 3
Ti 47.867 1.54 4,3,2
V 50.942 1.63 5,4,3,2
Cr 51.996 1.66 3,6,2
Mn 54.938 1.55 2,4,7,3
Fe 55.845 1.83 3,2
Co 58.933 1.88 2,3
Ni 58.693 1.91 2,3
Cu 63.546 1.9 2,1
Zn 65.38 1.65 2
Ga 69.723 1.81 3
Ge 72.63 2.01 4,2
As 74.922 2.18 -3,3,5
Se 78.971 2.55 -2,4,6
Br 79.904 2.96 -1,1,3,5
Kr 83.798 3.0 -
Rb 85.468 0.82 1
Sr 87.62 0.95 2
Y 88.906 1.22 3
Zr 91.224 1.33 4
Nb 92.906 1.6 5,3
Mo 95.95 2.16 6,4,3
Tc 98 1.9 7,4
Ru 101.07 2.2 4,3,2
Rh 102.91 2.28 3
Pd 106.42 2.2 2,4
Ag 107.87 1.93 1
Cd 112.41 1.69 2
In 114.82 1.78 3
Sn 118.71 1.96 4,2
Sb 121.76 2.05 3,5,-3
Te 127.6 2.1 -2,4,6
I 126.9 2.66 -1,1,5,7
Xe 131.29 2.6 -
Cs 132.91 0.79 1
Ba 137.33 0.89 2
La 138.91 1.1 3
Ce 140.12 1.12 3,4
Pr 140.91 1.13 3,4
Nd 144.24 1.14 3
Pm 145 1.13 3
Sm 150.36 1.17 3,2
Eu 151.96 1.2 3,2
Gd 157.25 1.2 3
Tb 158.93 1.2 3,4
Dy 162.5 1.22 3
Ho 164.93 1.23 3
Er 167.26 1.24 3
Tm 168.93 1.25 3
Yb 173.05 1.1 3,2
Lu 174.97 1.27 3
Hf 178.49 1.3 4
Ta 180.95 1.5 5
W 183.84 2.36 6,4
Re 186.21 1.9 7,4
Os 190.23 2.2 4
Ir 192.22 2.2 4,3
Pt 195.08 2.28 2,4
Au 196.97 2.54 3,1
Hg 200.59 2.0 2,1
Tl 204.38 1.62 1,3
Pb 207.2 2.33 2,4
Bi 208.98 2.02 3,5
Po 209 2.0 4,2
At 210 2.2 -
Rn 222 - -
Fr 223 0.7 -
Ra 226 0.9 2
Ac 227 1.1 3
Th 232.04 1.3 4
Pa 231.04 1.5 5
U 238.03 1.38 4,6,3
Np 237 1.36 5,4
Pu 244 1.28 4,3
Am 243 1.13 3
Cm 247 1.28 3
Bk 247 1.3 -
Cf 251 1.3 -
Es 252 1.3 -
Fm 257 1.3 -
Md 258 1.3 -
No 259 1.3 -
Lr 266 1.3 -
Rf 267 - -
Db 268 - -
Sg 269 - -
Bh 270 - -
Hs 269 - -
Mt 278 - -
Ds 281 - -
Rg 282 - -
Cn 285 - -
Nh 286 - -
Fl 289 - -
Mc 290 - -
Lv 293 - -
Ts 294 - -
Og 294 - -
"""
_ROWS = [line.split() for line in _TABLE.split("\n") if line]

SYMBOLS = tuple(r[0] for r in _ROWS)
NUMBER = {s: i + 1 for i, s in enumerate(SYMBOLS)}
MASS = {r[0]: float(r[1]) for r in _ROWS}
ELECTRONEGATIVITY = {r[0]: float(r[2]) for r in _ROWS if r[2] != "-"}
STATES = {r[0]: tuple(map(int, r[3].split(","))) for r in _ROWS if r[3] != "-"}

# Bonding classes.
METALS = frozenset(
    "Li Be Na Mg Al K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn".split()
)
NETWORK_PARTNERS = frozenset("B Si C P Ge As Sb".split())
STRONG_ANIONS = frozenset("O F Cl Br I S Se Te N H".split())
NOBLE_GASES = frozenset("He Ne Ar Kr Xe Rn".split())

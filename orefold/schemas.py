"""The proposal: its columns, and the closed schema its JSON must conform to."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

PROPOSAL = (
    "proposal_id string, composition struct<formula:string,elements:map<string,double>,formula_units_per_cell:int,charge:double>, "
    "structure struct<lattice:struct<a:double,b:double,c:double,alpha:double,beta:double,gamma:double,length_unit:string,angle_unit:string>,"
    "sites:array<struct<element:string,frac_coords:array<double>,occupancy:double,oxidation_state:double,label:string>>,"
    "space_group:struct<symbol:string,number:int,setting:string>,source:string>, "
    "claimed_properties array<struct<name:string,value:double,unit:string,uncertainty:double,basis:string,confidence:double>>, "
    "synthesis_hint struct<route:string,precursors:array<string>,temperature:double,temperature_unit:string,pressure_gpa:double,atmosphere:string,duration_hours:double,notes:string>, "
    "generator_confidence struct<overall:double,per_field:map<string,double>>, intended_application string, rationale string, "
    "references array<struct<kind:string,value:string>>"
)


@dataclass(frozen=True)
class Text:
    least: int = 0
    most: int | None = None
    pattern: str | None = None
    among: tuple[str, ...] | None = None

    def wrong(self, v: object) -> bool:
        if not isinstance(v, str) or len(v) < self.least or self.most is not None and len(v) > self.most:
            return True
        return self.among is not None and v not in self.among or self.pattern is not None and re.search(self.pattern, v) is None


@dataclass(frozen=True)
class Number:
    low: float | None = None
    high: float | None = None
    whole: bool = False

    def wrong(self, v: object) -> bool:
        """A boolean is no number; a whole number may be written 2.0."""
        if isinstance(v, bool) or not isinstance(v, (int, float)) or self.whole and not float(v).is_integer():
            return True
        return self.low is not None and v < self.low or self.high is not None and v > self.high


@dataclass(frozen=True)
class Items:
    of: object
    least: int = 0
    most: int | None = None


@dataclass(frozen=True)
class Table:
    of: object
    most: int
    key_most: int | None = None


@dataclass(frozen=True)
class Record:
    fields: dict[str, object]
    required: tuple[str, ...] = field(default=())


UNIT = Number(0, 1)
# The closed schema of a proposal.
SCHEMA = Record(
    {
        "proposal_id": Text(1, 64, r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,63}$"),
        "composition": Record({"formula": Text(1, 200), "elements": Table(Number(), 32, 8), "formula_units_per_cell": Number(1, 1000, True), "charge": Number()}, ("formula",)),
        "structure": Record(
            {
                "lattice": Record(
                    {**{k: Number() for k in ("a", "b", "c", "alpha", "beta", "gamma")}, "length_unit": Text(among=("angstrom", "nm", "pm", "bohr")), "angle_unit": Text(among=("degree", "radian"))},
                    ("a", "b", "c", "alpha", "beta", "gamma"),
                ),
                "sites": Items(Record({"element": Text(0, 8), "frac_coords": Items(Number(), 3, 3), "occupancy": UNIT, "oxidation_state": Number(), "label": Text(0, 32)}, ("element", "frac_coords")), 1, 500),
                "space_group": Record({"symbol": Text(0, 32), "number": Number(1, 230, True), "setting": Text(0, 32)}),
                "source": Text(among=("generated", "prototype_substitution", "relaxed", "experimental", "unknown")),
            },
            ("lattice", "sites"),
        ),
        "claimed_properties": Items(
            Record(
                {"name": Text(pattern=r"^[a-z0-9_]{1,64}$"), "value": Number(), "unit": Text(0, 32), "uncertainty": Number(0), "basis": Text(among=("predicted", "analogy", "literature", "unknown")), "confidence": UNIT},
                ("name", "value", "unit"),
            ),
            0,
            32,
        ),
        "synthesis_hint": Record(
            {
                "route": Text(among=("solid_state", "sol_gel", "hydrothermal", "solvothermal", "flux", "cvd", "pvd", "high_pressure", "mechanochemical", "combustion", "unknown")),
                "precursors": Items(Text(0, 100), 0, 16),
                "temperature": Number(),
                "temperature_unit": Text(among=("C", "K", "F")),
                "pressure_gpa": Number(),
                "atmosphere": Text(among=("air", "O2", "N2", "Ar", "H2", "forming_gas", "NH3", "vacuum", "sealed_ampoule", "CO2", "unknown")),
                "duration_hours": Number(0),
                "notes": Text(0, 2000),
            }
        ),
        "generator_confidence": Record({"overall": UNIT, "per_field": Table(UNIT, 64)}),
        "intended_application": Text(0, 2000),
        "rationale": Text(0, 8000),
        "references": Items(Record({"kind": Text(among=("doi", "arxiv", "url", "mp_id", "cod_id", "icsd_id", "free_text")), "value": Text(0, 512)}, ("kind", "value")), 0, 32),
    },
    ("proposal_id", "composition"),
)


def step(pointer: str, key: object) -> str:
    return f"{pointer}/{str(key).replace('~', '~0').replace('/', '~1')}"


def issues(value: object, schema: object = SCHEMA, pointer: str = "") -> list[tuple[str, str]]:
    """(pointer, code) of every violation, sorted: unknown and missing fields of closed objects, wrong types."""
    out: list[tuple[str, str]] = []
    stack = [(value, schema, pointer)]
    while stack:
        v, s, p = stack.pop()
        if isinstance(s, Record):
            if not isinstance(v, dict):
                out.append((p, "FMT.SCHEMA.TYPE_MISMATCH"))
                continue
            out += [(step(p, k), "FMT.SCHEMA.UNKNOWN_FIELD") for k in v if k not in s.fields]
            out += [(step(p, k), "FMT.SCHEMA.REQUIRED_FIELD_MISSING") for k in s.required if k not in v]
            stack += [(x, s.fields[k], step(p, k)) for k, x in v.items() if k in s.fields]
        elif isinstance(s, Items):
            if not isinstance(v, list) or len(v) < s.least or s.most is not None and len(v) > s.most:
                out.append((p, "FMT.SCHEMA.TYPE_MISMATCH"))
            if isinstance(v, list):
                stack += [(x, s.of, step(p, i)) for i, x in enumerate(v)]
        elif isinstance(s, Table):
            if not isinstance(v, dict) or len(v) > s.most:
                out.append((p, "FMT.SCHEMA.TYPE_MISMATCH"))
            if isinstance(v, dict):
                out += [(step(p, k), "FMT.SCHEMA.TYPE_MISMATCH") for k in v if s.key_most is not None and len(k) > s.key_most]
                stack += [(x, s.of, step(p, k)) for k, x in v.items()]
        elif s.wrong(v):
            out.append((p, "FMT.SCHEMA.TYPE_MISMATCH"))
    return sorted(out)

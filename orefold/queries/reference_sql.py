"""SQL that must agree with the queries; reference tables are spelled out as VALUES."""

from __future__ import annotations

from orefold.functions import formula as fm
from orefold.operators.evidence import corpus_rows
from orefold.reference import elements as el
from orefold.reference import properties as pr
from orefold.reference import thermochemistry as th
from orefold.reference.corpora import PROVIDERS, TIERS
from orefold.schemas import SCHEMA


def _text(v: object) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else ("true" if v else "false") if isinstance(v, bool) else repr(v)


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in rows)})"


def _list(items: object) -> str:
    return "[" + ", ".join(_text(i) for i in sorted(items)) + "]"


_MASS = _values("masses", "sym, mass", [(s, float(m)) for s, m in el.MASS.items()])
_EN = _values("en", "sym, x", [*el.ELECTRONEGATIVITY.items()])
_STATES = _values("states", "sym, ord, state", [(s, i, v) for s, vs in el.STATES.items() for i, v in enumerate(vs)])
_SPECS = _values("specs", "name, canonical, hard_min, lo, hi", [(n, u, m, a, b) for n, u, m, a, b in pr.SPECS])
_FACTORS = _values("factors", "canonical, token, factor, offs", [(c, t, float(f), float(o)) for c, t, f, o in pr.FACTORS])
_CORPUS = _values("corpus", "provider, key, identifier, n_documents", [(p, k, i, n) for p, k, _, i, n in corpus_rows()])
_PROVIDERS = _values("providers", "provider, mode, evidence", [(p.name, p.mode, p.evidence) for p in PROVIDERS])
_PHASES = _values("phases", "key, ev, atoms", [(fm.key(c), h / th.KJ_PER_EV, float(sum(c.values()))) for c, h in ((fm.parse(f).counts, h) for f, h, _ in th.ENTRIES)])
_PHASE_COUNTS = _values("phase_counts", "key, sym, n", [(fm.key(c), s, float(n)) for c in (fm.parse(f).counts for f, _, _ in th.ENTRIES) for s, n in c.items()])

#: Formula counts of every proposal: p(proposal_no, formula), fc(proposal_no, sym, n), ident with the reduced key.
_FC = """
p AS (SELECT proposal_no, composition.formula AS formula FROM proposals WHERE composition.formula IS NOT NULL AND composition.formula <> ''),
part AS (SELECT proposal_no, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)', 1)) AS sym, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)', 2)) AS d FROM p),
fc AS (SELECT proposal_no, sym, sum(CAST(coalesce(nullif(d, ''), '1') AS DOUBLE)) AS n FROM part GROUP BY 1, 2),
gs AS (SELECT proposal_no, list_reduce(list(CAST(n AS BIGINT)), lambda a, b: gcd(a, b)) AS g FROM fc GROUP BY 1),
ident AS (SELECT fc.proposal_no, g, string_agg(sym || ':' || CAST(CAST(n / g AS BIGINT) AS VARCHAR), '|' ORDER BY sym) AS key, string_agg(sym, '-' ORDER BY sym) AS chemsys, list(sym ORDER BY sym) AS els, count(*) AS k, sum(n / g) AS atoms
  FROM fc JOIN gs USING (proposal_no) GROUP BY 1, 2)"""
_METALLIC = f"""(len(list_filter(els, lambda x: NOT list_contains({_list(el.METALS)}, x))) = 0
  OR (NOT list_has_any(els, {_list(el.STRONG_ANIONS)}) AND list_has_any(els, {_list(el.METALS)}) AND len(list_filter(els, lambda x: NOT list_contains({_list(el.METALS | el.NETWORK_PARTNERS)}, x))) = 0))"""
_CHARGE = f"""
cls AS (SELECT *, CASE WHEN {_METALLIC} THEN 'metallic' WHEN EXISTS (SELECT 1 FROM unnest(els) u(e) WHERE u.e NOT IN (SELECT sym FROM states)) THEN 'no_states' END AS pre FROM ident),
el AS (SELECT fc.proposal_no, sym, CAST(n AS BIGINT) AS n, row_number() OVER (PARTITION BY fc.proposal_no ORDER BY sym) AS i FROM fc JOIN cls USING (proposal_no) WHERE pre IS NULL),
walk AS (SELECT proposal_no, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS total, CAST([] AS BIGINT[]) AS path, CAST([] AS VARCHAR[]) AS txt, CAST([] AS BIGINT[]) AS st FROM cls WHERE pre IS NULL
  UNION ALL SELECT w.proposal_no, w.i + 1, w.total + e.n * s.state, list_append(w.path, CAST(s.ord AS BIGINT)), list_append(w.txt, e.sym || ':' || s.state), list_append(w.st, CAST(s.state AS BIGINT)) FROM walk w JOIN el e ON e.proposal_no = w.proposal_no AND e.i = w.i + 1 JOIN states s ON s.sym = e.sym),
best AS (SELECT w.proposal_no, arg_min(txt, path) AS txt, arg_min(st, path) AS st FROM walk w JOIN cls USING (proposal_no) WHERE w.i = k AND total = 0 GROUP BY 1)"""

_LAT = """
l0 AS (SELECT proposal_no, structure.sites AS sites, structure.space_group.number AS sg, structure.lattice AS l,
  CASE WHEN structure.lattice.length_unit IS NULL THEN 1.0 WHEN structure.lattice.length_unit = 'angstrom' THEN 1.0 WHEN structure.lattice.length_unit = 'nm' THEN 10.0 WHEN structure.lattice.length_unit = 'pm' THEN 0.01 WHEN structure.lattice.length_unit = 'bohr' THEN 0.529177210903::DOUBLE END::DOUBLE AS sc FROM proposals WHERE structure IS NOT NULL),
l1 AS (SELECT proposal_no, sites, sg, l.a * sc AS a, l.b * sc AS b, l.c * sc AS c,
  CASE WHEN l.angle_unit = 'radian' THEN degrees(l.alpha) ELSE l.alpha END AS alpha, CASE WHEN l.angle_unit = 'radian' THEN degrees(l.beta) ELSE l.beta END AS beta, CASE WHEN l.angle_unit = 'radian' THEN degrees(l.gamma) ELSE l.gamma END AS gamma FROM l0),
l2 AS (SELECT *, cos(radians(alpha)) AS ca, cos(radians(beta)) AS cb, cos(radians(gamma)) AS cg, sin(radians(gamma)) AS sng FROM l1 WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND alpha IS NOT NULL AND beta IS NOT NULL AND gamma IS NOT NULL),
lat AS (SELECT *, CASE WHEN 1 - ca*ca - cb*cb - cg*cg + 2*ca*cb*cg > 0 THEN a*b*c*sqrt(1 - ca*ca - cb*cb - cg*cg + 2*ca*cb*cg) END AS vol FROM l2),
site AS (SELECT proposal_no, i, s.element AS e, s.frac_coords[1] AS x, s.frac_coords[2] AS y, s.frac_coords[3] AS z, coalesce(s.occupancy, 1.0) AS occ
  FROM (SELECT proposal_no, unnest(sites) AS s, generate_subscripts(sites, 1) AS i FROM l1) WHERE len(s.frac_coords) = 3)"""
_FAMILY = """CASE WHEN sg < 1 THEN NULL WHEN sg <= 2 THEN 'triclinic' WHEN sg <= 15 THEN 'monoclinic' WHEN sg <= 74 THEN 'orthorhombic' WHEN sg <= 142 THEN 'tetragonal' WHEN sg <= 167 THEN 'trigonal' WHEN sg <= 194 THEN 'hexagonal' WHEN sg <= 230 THEN 'cubic' END"""
_METRIC = """CASE WHEN sq AND ab AND bc THEN 'cubic' WHEN sq AND (ab OR bc OR ac) THEN 'tetragonal' WHEN sq THEN 'orthorhombic' WHEN ab AND ra AND rb AND abs(gamma - 120) <= 0.5 THEN 'hexagonal'
  WHEN ab AND bc AND abs(alpha - beta) <= 0.01 AND abs(beta - gamma) <= 0.01 AND NOT ra THEN 'rhombohedral' WHEN (ra AND rg) OR (ra AND rb) THEN 'monoclinic' ELSE 'triclinic' END"""

_TOKEN = r"replace(replace(lower(regexp_replace(translate(replace(coalesce(unit, ''), '℃', '°C'), '³²¹⁰⁻−·µμ', '3210--.uu'), '[ \t\n\r\f]+', '', 'g')), '**', ''), '^', '')"
_CLAIMS = f"""
c0 AS (SELECT proposal_no, unnest(claimed_properties) AS c, generate_subscripts(claimed_properties, 1) - 1 AS pos FROM proposals),
c1 AS (SELECT proposal_no, CAST(pos AS BIGINT) AS pos, c.name AS name, c.value AS value, c.unit AS unit FROM c0 WHERE c IS NOT NULL),
c2 AS (SELECT *, {_TOKEN} AS token FROM c1),
firsts AS (SELECT name, arg_min(token, (proposal_no, pos)) AS first_token FROM c2 WHERE token <> '' AND name IS NOT NULL GROUP BY 1),
c3 AS (SELECT c2.*, s.canonical, s.hard_min, s.lo, s.hi, f.factor, f.offs, firsts.first_token, value * f.factor + f.offs AS norm,
  (value IN ({', '.join(map(repr, pr.SENTINEL_EXACT))}) OR (abs(value) IN ({', '.join(map(repr, pr.SENTINEL_MAGNITUDES))}) AND (value < 0 OR value > s.hi OR abs(value) >= 999))) AS sent
  FROM c2 LEFT JOIN specs s USING (name) LEFT JOIN factors f ON f.canonical = s.canonical AND f.token = c2.token LEFT JOIN firsts USING (name)),
c4 AS (SELECT *, CASE WHEN value IS NULL THEN 'not_a_number' WHEN isnan(value) OR abs(value) > 1e30 THEN 'overflow' WHEN canonical IS NULL THEN 'unknown_property' WHEN factor IS NULL THEN 'unit_error' WHEN sent THEN 'sentinel'
  WHEN norm < hard_min THEN 'impossible' WHEN norm < lo OR norm > hi THEN 'implausible' ELSE 'unsupported' END AS assessment FROM c3)"""
_CL = f"WITH {_SPECS}, {_FACTORS}, {_CLAIMS} "

_ANSWERS = f"""
{_CORPUS}, {_PROVIDERS}, {_FC},
known AS (SELECT provider, key, bool_and(coalesce(n_documents = 0, false)) AS empty, true AS hit FROM corpus GROUP BY 1, 2),
ans AS (SELECT proposal_no, provider, mode, evidence, CASE WHEN empty THEN 'miss' WHEN hit THEN 'hit' WHEN mode = 'replay' THEN 'unavailable' ELSE 'miss' END AS status
  FROM ident CROSS JOIN providers LEFT JOIN known USING (provider, key))"""
_TIERED = f"""
tier AS (SELECT proposal_no, bool_or(status = 'hit' AND evidence = 'experimental') AS e, bool_or(status = 'hit' AND evidence = 'computed') AS c, bool_or(status = 'hit' AND evidence = 'literature') AS l, count(*) FILTER (status = 'unavailable') AS away FROM ans GROUP BY 1)"""

_SCORE = """
f AS (SELECT v.record_id, v.level, coalesce(t.phase, 'meta') AS phase, coalesce(t.gate, false) AS gate, v.unverifiable AS away FROM violations v LEFT JOIN taxonomy_codes t USING (code) WHERE record_id IS NOT NULL),
pc AS (SELECT record_id, phase, count(*) FILTER (level = 'error') AS e, count(*) FILTER (level = 'warning') AS w FROM f GROUP BY 1, 2),
comp AS (SELECT record_id, CASE phase WHEN 'composition' THEN 0.25::DOUBLE WHEN 'structure' THEN 0.20::DOUBLE WHEN 'novelty' THEN 0.25::DOUBLE WHEN 'feasibility' THEN 0.15::DOUBLE WHEN 'claims' THEN 0.15::DOUBLE END AS w, CASE WHEN e > 0 THEN 0.0 WHEN w > 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS v FROM pc),
wm AS (SELECT record_id, sum(w * v) / sum(w) AS m FROM comp WHERE w IS NOT NULL GROUP BY 1),
agg AS (SELECT record_id, count(*) AS n_findings, count(*) FILTER (level = 'error') AS n_errors, coalesce(bool_or(gate AND level = 'error'), false) AS gate_failed, coalesce(bool_or(away), false) AS away FROM f GROUP BY 1),
sc AS (SELECT record_id, n_findings, n_errors, gate_failed, round(CASE WHEN gate_failed THEN 0.0 ELSE coalesce(m, 1.0) END, 6)::DOUBLE AS reward, CASE WHEN gate_failed THEN 'rejected' WHEN away THEN 'unverifiable' WHEN n_errors > 0 THEN 'rejected' ELSE 'accepted' END AS status FROM agg LEFT JOIN wm USING (record_id))"""

_KELVIN = "CASE WHEN u = 'C' THEN t + 273.15 WHEN u = 'F' THEN (t - 32) * 5 / 9 + 273.15 WHEN u IS NULL OR u = 'K' THEN t END"
_MU_GASES = " ".join(f"WHEN gas = '{g}' THEN {th.BOLTZMANN_EV!r}::DOUBLE * k * (ln({b!r}::DOUBLE) / 2)" for g, b in th.OXYGEN_BAR.items()) + " " + " ".join(
    f"WHEN gas = '{g}' THEN ({th.STEAM_ENTHALPY!r}::DOUBLE - k * (({th.STEAM_ENTROPY!r}::DOUBLE - {th.HYDROGEN_ENTROPY!r}::DOUBLE - {th.OXYGEN_ENTROPY!r}::DOUBLE / 2) / 1000)) / {th.KJ_PER_EV!r}::DOUBLE + {th.BOLTZMANN_EV!r}::DOUBLE * k * ln({r!r}::DOUBLE)"
    for g, r in th.WATER_RATIO.items()
)
_MU = f"CASE {_MU_GASES} END"

_CAL = """
pairs AS (SELECT proposal_id, '/claimed_properties/' || CAST(i - 1 AS VARCHAR) AS json_pointer, c.confidence AS confidence, away FROM (SELECT proposal_id, unnest(claimed_properties) AS c, generate_subscripts(claimed_properties, 1) AS i, generator_confidence IS NULL AS away FROM proposals) WHERE c.confidence IS NOT NULL),
hit AS (SELECT DISTINCT proposal_id, json_pointer AS ptr, level FROM violations WHERE level IN ('error', 'warning')),
numbered AS (SELECT *, row_number() OVER () AS r FROM pairs),
o AS (SELECT r, any_value(n.json_pointer) AS json_pointer, any_value(confidence) AS confidence, CASE WHEN bool_or(away) AND count(h.ptr) = 0 THEN 'unverifiable' WHEN bool_or(h.level = 'error') THEN 'incorrect' ELSE 'correct' END AS outcome
  FROM numbered n LEFT JOIN hit h ON h.proposal_id = n.proposal_id AND (h.ptr = n.json_pointer OR starts_with(h.ptr, n.json_pointer || '/')) GROUP BY r)"""


def _typed_issues() -> str:
    comp, claim, hint, conf = (SCHEMA.fields[c] for c in ("composition", "claimed_properties", "synthesis_hint", "generator_confidence"))
    hint_of = hint.fields
    enum = lambda c, r: f"{c} NOT IN ({', '.join(_text(x) for x in r.among)})"
    one = lambda cond, ptr: f"SELECT proposal_no, {_text(ptr)} AS json_pointer FROM proposals WHERE {cond}"
    each = lambda cond, name: f"SELECT proposal_no, '/claimed_properties/' || CAST(i - 1 AS VARCHAR) || '/{name}' FROM cp WHERE {cond}"
    parts = [
        one("NOT regexp_matches(proposal_id, '^[A-Za-z0-9][A-Za-z0-9_.-]{0,63}$') OR length(proposal_id) < 1 OR length(proposal_id) > 64", "/proposal_id"),
        one("length(composition.formula) < 1 OR length(composition.formula) > 200", "/composition/formula"),
        one(f"composition.formula_units_per_cell < {comp.fields['formula_units_per_cell'].low} OR composition.formula_units_per_cell > {comp.fields['formula_units_per_cell'].high}", "/composition/formula_units_per_cell"),
        one(f"len(claimed_properties) > {claim.most}", "/claimed_properties"),
        one("generator_confidence.overall < 0 OR generator_confidence.overall > 1", "/generator_confidence/overall"),
        one(enum("synthesis_hint.route", hint_of["route"]), "/synthesis_hint/route"),
        one(enum("synthesis_hint.temperature_unit", hint_of["temperature_unit"]), "/synthesis_hint/temperature_unit"),
        one(enum("synthesis_hint.atmosphere", hint_of["atmosphere"]), "/synthesis_hint/atmosphere"),
        one("len(synthesis_hint.precursors) > 16", "/synthesis_hint/precursors"),
        one("synthesis_hint.duration_hours < 0", "/synthesis_hint/duration_hours"),
        one("length(synthesis_hint.notes) > 2000", "/synthesis_hint/notes"),
        each("NOT regexp_matches(c.name, '^[a-z0-9_]{1,64}$')", "name"),
        each("length(c.unit) > 32", "unit"),
        each("c.uncertainty < 0", "uncertainty"),
        each(enum("c.basis", claim.of.fields["basis"]), "basis"),
        each("c.confidence < 0 OR c.confidence > 1", "confidence"),
    ]
    assert conf is not None
    cp = "cp AS (SELECT proposal_no, unnest(claimed_properties) AS c, generate_subscripts(claimed_properties, 1) AS i FROM proposals)"
    return f"WITH {cp}, issue AS ({' UNION ALL '.join(parts)}) "


_ADMIT = """adm AS (SELECT proposal_no, CASE WHEN proposal_id IS NOT NULL AND coalesce(sum(CASE WHEN claimed_properties IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY proposal_id ORDER BY received_at, proposal_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'duplicate'
  WHEN claimed_properties IS NULL THEN 'nonconforming' ELSE 'admitted' END AS decision FROM proposals)"""
_OLD = "TIMESTAMP '2026-06-01 00:00:00'"
_CODES = "SELECT coalesce(code, '(null)') AS code, coalesce(json_pointer, '(null)') AS json_pointer FROM violations"

SQL: dict[str, str] = {
    "formula_counts": f"WITH {_FC} SELECT proposal_no, sym AS element, n AS amount FROM fc",
    "composition_identity": f"WITH {_FC} SELECT proposal_no, key AS composition_key, chemsys, CAST(g AS BIGINT) AS divisor, CAST(k AS BIGINT) AS n_elements FROM ident",
    "scope_and_class": f"""WITH {_FC} SELECT proposal_no, NOT (len(list_filter(els, lambda x: x NOT IN ('C', 'H'))) = 0 OR (list_contains(els, 'C') AND list_contains(els, 'H') AND NOT list_has_any(els, {_list(el.METALS)}))
        OR len(list_filter(els, lambda x: NOT list_contains({_list(el.NOBLE_GASES)}, x))) = 0) AS in_scope, {_METALLIC} AS metallic FROM ident""",
    "charge_balance": f"WITH RECURSIVE {_STATES}, {_FC}, {_CHARGE} SELECT proposal_no, CASE WHEN pre IS NOT NULL THEN pre WHEN txt IS NOT NULL THEN 'balanced' ELSE 'unbalanced' END AS outcome, list_aggregate(txt, 'string_agg', ',') AS states FROM cls LEFT JOIN best USING (proposal_no)",
    "electronegativity_order": f"""WITH RECURSIVE {_STATES}, {_EN}, {_FC}, {_CHARGE},
        s AS (SELECT proposal_no, unnest(list_sort(els)) AS sym, unnest(st) AS state FROM best JOIN cls USING (proposal_no)),
        m AS (SELECT proposal_no, arg_min(sym, (-x, sym)) AS top, max(x) AS x FROM fc JOIN en USING (sym) GROUP BY 1),
        r AS (SELECT proposal_no, bool_or(state < 0) AS an, bool_or(state > 0) AS cat, max(x) FILTER (state < 0) AS ax FROM s LEFT JOIN en USING (sym) GROUP BY 1)
        SELECT m.proposal_no, top AS element FROM m JOIN r USING (proposal_no) JOIN s ON s.proposal_no = m.proposal_no AND s.sym = m.top WHERE an AND cat AND state >= 0 AND m.x > ax""",
    "element_map_disagreement": f"""WITH {_FC}, given AS (SELECT proposal_no, unnest(map_entries(composition.elements)) AS e FROM proposals),
        g AS (SELECT proposal_no, e.key AS sym, e.value AS m FROM given), has AS (SELECT DISTINCT g.proposal_no FROM g JOIN p USING (proposal_no)),
        j AS (SELECT proposal_no, sym, n, m FROM (SELECT * FROM fc WHERE proposal_no IN (SELECT proposal_no FROM has)) FULL OUTER JOIN (SELECT * FROM g WHERE proposal_no IN (SELECT proposal_no FROM has)) g USING (proposal_no, sym))
        SELECT proposal_no, coalesce(string_agg(sym, ',' ORDER BY sym) FILTER (n IS NULL OR m IS NULL OR abs(n - m) > 1e-9), '') AS differing FROM j GROUP BY 1""",
    "lattice_measures": f"""WITH {_MASS}, {_LAT}, d AS (SELECT proposal_no, sum(coalesce(mass, 0) * occ) AS m, bool_or(e IS NOT NULL AND e <> '' AND mass IS NULL) AS bad FROM site LEFT JOIN masses ON sym = e GROUP BY 1)
        SELECT proposal_no, round(vol, 4) AS volume, round(CASE WHEN NOT bad THEN m * 1.66053906660::DOUBLE / vol END, 4) AS density FROM lat LEFT JOIN d USING (proposal_no)""",
    "lattice_bounds": f"""WITH {_LAT} SELECT proposal_no, '/structure/lattice/' || k AS json_pointer FROM (SELECT proposal_no, unnest(['a', 'b', 'c', 'alpha', 'beta', 'gamma']) AS k, unnest([a, b, c, alpha, beta, gamma]) AS v FROM lat)
        WHERE CASE WHEN length(k) = 1 THEN NOT v BETWEEN 1 AND 100 ELSE NOT v BETWEEN 15 AND 165 END""",
    "symmetry_agreement": f"""WITH {_LAT}, q AS (SELECT proposal_no, {_FAMILY} AS asserted, alpha, beta, gamma, abs(a - b) <= 0.01 AS ab, abs(b - c) <= 0.01 AS bc, abs(a - c) <= 0.01 AS ac, abs(alpha - 90) <= 0.5 AS ra, abs(beta - 90) <= 0.5 AS rb, abs(gamma - 90) <= 0.5 AS rg,
        abs(alpha - 90) <= 0.5 AND abs(beta - 90) <= 0.5 AND abs(gamma - 90) <= 0.5 AS sq FROM lat WHERE vol IS NOT NULL), m AS (SELECT proposal_no, asserted, {_METRIC} AS metric FROM q)
        SELECT *, asserted = metric OR (asserted = 'trigonal' AND metric IN ('trigonal', 'hexagonal', 'rhombohedral')) OR (metric = 'trigonal' AND asserted IN ('trigonal', 'hexagonal', 'rhombohedral')) OR (asserted = 'hexagonal' AND metric IN ('hexagonal', 'trigonal'))
        OR (metric = 'hexagonal' AND asserted IN ('hexagonal', 'trigonal')) OR (asserted = 'rhombohedral' AND metric IN ('rhombohedral', 'trigonal', 'hexagonal')) OR (metric = 'rhombohedral' AND asserted IN ('rhombohedral', 'trigonal', 'hexagonal')) AS agree FROM m""",
    "min_image_distance": f"""WITH {_LAT}, v AS (SELECT *, c * cb AS cx, c * (ca - cb * cg) / sng AS cy FROM lat WHERE vol IS NOT NULL), w AS (SELECT *, sqrt(c * c - cx * cx - cy * cy) AS cz FROM v WHERE c * c - cx * cx - cy * cy > 0),
        sh AS (SELECT i.r AS i, j.r AS j, k.r AS k FROM range(-1, 2) i(r), range(-1, 2) j(r), range(-1, 2) k(r)),
        pr AS (SELECT s.proposal_no, t.x - s.x + sh.i AS dx, t.y - s.y + sh.j AS dy, t.z - s.z + sh.k AS dz FROM site s JOIN site t ON s.proposal_no = t.proposal_no AND t.i >= s.i CROSS JOIN sh WHERE NOT (s.i = t.i AND sh.i = 0 AND sh.j = 0 AND sh.k = 0))
        SELECT proposal_no, round(sqrt(min(power(dx * a + dy * b * cg + dz * cx, 2) + power(dy * b * sng + dz * cy, 2) + power(dz * cz, 2))), 4) AS distance FROM pr JOIN w USING (proposal_no) GROUP BY 1""",
    "site_totals": f"WITH {_LAT} SELECT proposal_no, e AS element, round(sum(occ), 6) AS total FROM site WHERE e IS NOT NULL AND e <> '' GROUP BY 1, 2",
    "occupancy_ratio": f"""WITH {_FC}, {_LAT}, tot AS (SELECT proposal_no, e AS sym, sum(occ) AS t FROM site WHERE e IS NOT NULL AND e <> '' GROUP BY 1, 2), has AS (SELECT DISTINCT tot.proposal_no FROM tot JOIN p USING (proposal_no)),
        j AS (SELECT proposal_no, sym, n, t FROM (SELECT * FROM fc WHERE proposal_no IN (SELECT proposal_no FROM has)) FULL OUTER JOIN (SELECT * FROM tot WHERE proposal_no IN (SELECT proposal_no FROM has)) x USING (proposal_no, sym)),
        z AS (SELECT proposal_no, bool_or(n IS NULL OR t IS NULL) AS other, arg_min(t, sym) FILTER (n IS NOT NULL) / arg_min(n, sym) FILTER (n IS NOT NULL) AS z FROM j GROUP BY 1),
        o AS (SELECT j.proposal_no, CASE WHEN any_value(other) THEN 'elements' ELSE min(sym) FILTER (abs(t - n * z) > greatest(0.02, 0.02 * n * z)) END AS differing FROM j JOIN z USING (proposal_no) WHERE other OR z > 0 GROUP BY 1)
        SELECT * FROM o WHERE differing IS NOT NULL""",
    "unit_normalization_log": _CL + "SELECT proposal_no, pos, name, unit AS from_unit, canonical AS to_unit, factor FROM c4 WHERE (factor <> 1 OR offs <> 0) AND assessment NOT IN ('not_a_number', 'overflow', 'unknown_property', 'unit_error')",
    "batch_unit_first_wins": _CL + "SELECT name, first_token FROM firsts",
    "claim_assessment": _CL + "SELECT proposal_no, pos, assessment, round(norm, 4) AS normalized FROM c4",
    "claim_findings": _CL + """, a AS (SELECT *, '/claimed_properties/' || pos AS ptr, coalesce(regexp_matches(unit, '[^\\x00-\\x7F]'), false) AS alien, assessment NOT IN ('not_a_number', 'overflow', 'unknown_property') AS chk FROM c4)
        SELECT proposal_no, 'CLAIM.VALUE.PHYSICALLY_IMPOSSIBLE' AS code, 'error' AS level, ptr || '/value' AS json_pointer FROM a WHERE assessment IN ('overflow', 'impossible')
        UNION ALL SELECT proposal_no, 'CLAIM.UNITS.INCONSISTENT', 'error', ptr || '/unit' FROM a WHERE chk AND (alien OR assessment = 'unit_error')
        UNION ALL SELECT proposal_no, 'CLAIM.UNITS.INCONSISTENT', 'warning', ptr || '/unit' FROM a WHERE chk AND assessment <> 'unit_error' AND first_token <> token
        UNION ALL SELECT proposal_no, 'CLAIM.SENTINEL.SUSPECTED', 'warning', ptr || '/value' FROM a WHERE assessment = 'sentinel'
        UNION ALL SELECT proposal_no, 'CLAIM.UNSUPPORTED.PROPERTY_ASSERTION', CASE assessment WHEN 'implausible' THEN 'warning' ELSE 'note' END, ptr || '/value' FROM a WHERE assessment IN ('implausible', 'unsupported')""",
    "sentinel_values": _CL + "SELECT proposal_no, pos, value FROM c4 WHERE assessment = 'sentinel'",
    "provider_status_tristate": f"WITH {_ANSWERS} SELECT proposal_no, provider, status FROM ans",
    "novelty_tier": f"""WITH {_ANSWERS}, {_TIERED} SELECT proposal_no, CASE WHEN e THEN '{TIERS[0][1]}' WHEN c THEN '{TIERS[1][1]}' WHEN l THEN '{TIERS[2][1]}' WHEN away > 0 THEN 'unknown' ELSE 'no_evidence' END AS tier,
        round(CASE WHEN e THEN 0.9 WHEN c OR l THEN 0.7 WHEN away > 0 THEN 0.2 ELSE 0.45 END - CASE WHEN away > 0 THEN 0.1 ELSE 0 END, 3)::DOUBLE AS confidence, away AS n_unavailable FROM tier""",
    "same_class_conflicts": f"WITH {_ANSWERS} SELECT proposal_no, evidence, string_agg(provider, ', ' ORDER BY provider) AS providers FROM ans WHERE status <> 'unavailable' GROUP BY 1, 2 HAVING count(DISTINCT status) > 1",
    "hint_kelvin": f"WITH h AS (SELECT proposal_no, synthesis_hint.temperature AS t, synthesis_hint.temperature_unit AS u FROM proposals WHERE synthesis_hint.temperature IS NOT NULL) SELECT proposal_no, round({_KELVIN}, 4) AS kelvin FROM h",
    "oxygen_potential": f"WITH h AS (SELECT proposal_no, synthesis_hint.temperature AS k, synthesis_hint.atmosphere AS gas FROM proposals WHERE synthesis_hint.temperature > 0 AND synthesis_hint.atmosphere IS NOT NULL) SELECT proposal_no, round({_MU}, 6) AS potential FROM h",
    "atmosphere_survival": f"""WITH {_PHASES}, {_FC}, h AS (SELECT proposal_no, synthesis_hint.temperature AS t, synthesis_hint.temperature_unit AS u, synthesis_hint.atmosphere AS gas0 FROM proposals), hk AS (SELECT proposal_no, gas0, {_KELVIN} AS k0 FROM h),
        g AS (SELECT proposal_no, CASE WHEN k0 > 0 AND k0 < 6000 THEN k0 ELSE 1273.15 END AS k, unnest(list_distinct(list_filter(['air', 'H2', CASE WHEN gas0 <> 'unknown' THEN gas0 END], lambda x: x IS NOT NULL))) AS gas FROM hk),
        j AS (SELECT i.proposal_no, gas, g.k AS k, fc.n / i.g AS o, ph.ev, ph.atoms FROM ident i JOIN phases ph USING (key) JOIN fc ON fc.proposal_no = i.proposal_no AND fc.sym = 'O' JOIN g ON g.proposal_no = i.proposal_no)
        SELECT proposal_no, gas AS atmosphere, round((o * {_MU} - ev) / atoms, 6) AS force FROM j WHERE {_MU} IS NOT NULL""",
    "hull_binary_energy": f"""WITH {_PHASES}, {_PHASE_COUNTS}, {_FC}, two AS (SELECT proposal_no, els[1] AS e1, els[2] AS e2 FROM ident WHERE k = 2), x AS (SELECT two.*, a.n / (a.n + b.n) AS x FROM two JOIN fc a ON a.proposal_no = two.proposal_no AND a.sym = e1 JOIN fc b ON b.proposal_no = two.proposal_no AND b.sym = e2),
        ins AS (SELECT x.proposal_no, x.x, ph.key, ph.ev / ph.atoms AS y, coalesce((SELECT n FROM phase_counts c WHERE c.key = ph.key AND c.sym = x.e1), 0) / ph.atoms AS px FROM x JOIN phases ph ON NOT EXISTS (SELECT 1 FROM phase_counts c WHERE c.key = ph.key AND c.sym NOT IN (x.e1, x.e2)))
        SELECT p.proposal_no, round(min(CASE WHEN p.px = q.px THEN p.y ELSE p.y + (q.y - p.y) * (p.x - p.px) / (q.px - p.px) END), 6) AS hull FROM ins p JOIN ins q ON p.proposal_no = q.proposal_no WHERE (p.px < p.x - 1e-9 AND q.px > p.x + 1e-9) OR (p.key = q.key AND abs(p.px - p.x) <= 1e-9) GROUP BY 1""",
    "hint_findings": f"""WITH {_FC}, h AS (SELECT proposal_no, synthesis_hint.temperature AS t, synthesis_hint.temperature_unit AS u, synthesis_hint.atmosphere AS gas FROM proposals), s AS (SELECT i.proposal_no, els, gas, coalesce({_KELVIN}, t) AS k FROM ident i JOIN h USING (proposal_no)
        WHERE NOT (len(list_filter(els, lambda x: x NOT IN ('C', 'H'))) = 0 OR (list_contains(els, 'C') AND list_contains(els, 'H') AND NOT list_has_any(els, {_list(el.METALS)})) OR len(list_filter(els, lambda x: NOT list_contains({_list(el.NOBLE_GASES)}, x))) = 0))
        SELECT proposal_no, '/synthesis_hint/atmosphere' AS json_pointer FROM s WHERE (list_contains(els, 'O') AND gas IN ('H2', 'forming_gas', 'NH3')) OR (list_has_any(els, ['N', 'S']) AND NOT list_contains(els, 'O') AND gas IN ('air', 'O2'))
        UNION ALL SELECT proposal_no, '/synthesis_hint/temperature' FROM s WHERE k <= 0 OR k > 4000""",
    "precursor_names": r"""WITH e AS (SELECT proposal_no, unnest(synthesis_hint.precursors) AS raw, generate_subscripts(synthesis_hint.precursors, 1) - 1 AS pos FROM proposals)
        SELECT proposal_no, CAST(pos AS BIGINT) AS pos, split_part(trim(regexp_replace(regexp_replace(raw, '\([^)]*\)', ' ', 'g'), '\[[^\]]*\]', ' ', 'g')), ' ', 1) AS name FROM e""",
    "gated_reward": f"WITH {_SCORE} SELECT * FROM sc",
    "eligible_projection": f"WITH {_SCORE} SELECT record_id, reward, status FROM sc WHERE status IN ('accepted', 'rejected')",
    "reward_summary_upper_median": f"WITH {_SCORE} SELECT count(*) AS n, round(CAST(sum(CAST(reward AS DECIMAL(26, 12))) AS DOUBLE) / count(*), 6) AS mean, min(reward) AS min, max(reward) AS max, list_sort(list(reward))[CAST(count(*) // 2 AS BIGINT) + 1] AS p50 FROM sc",
    "code_field_grouping_sets": f"SELECT code, json_pointer, count(*) AS n FROM ({_CODES}) GROUP BY GROUPING SETS ((code), (json_pointer), (code, json_pointer))",
    "calibration_prefix_join": f"WITH {_CAL} SELECT json_pointer, outcome, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM o GROUP BY 1, 2",
    "calibration_brier": f"""WITH {_CAL} SELECT count(*) AS n_pairs, round(avg(power(confidence - CASE outcome WHEN 'correct' THEN 1.0 WHEN 'incorrect' THEN 0.0 END, 2)), 6) AS brier, round(avg(confidence) FILTER (outcome = 'correct'), 6) AS mean_confidence_when_correct,
        round(avg(confidence) FILTER (outcome = 'incorrect'), 6) AS mean_confidence_when_incorrect FROM o""",
    "recommendations_ranked": """WITH n AS (SELECT t.phase AS advice_id, t.default_level AS target, count(DISTINCT v.proposal_id) AS n_records FROM violations v JOIN taxonomy_codes t USING (code) WHERE v.proposal_id IS NOT NULL GROUP BY 1, 2)
        SELECT CAST(row_number() OVER (ORDER BY n_records DESC, target, advice_id) AS BIGINT) AS rank, advice_id, target, n_records, round(n_records / (SELECT count(DISTINCT proposal_id) FROM violations)::DOUBLE, 6) AS fraction FROM n""",
    "recommendation_evidence": """WITH j AS (SELECT t.phase AS advice_id, t.default_level AS target, v.code, v.json_pointer, v.proposal_id, v.record_id FROM violations v JOIN taxonomy_codes t USING (code) WHERE v.record_id IS NOT NULL),
        d AS (SELECT DISTINCT advice_id, 'c' AS k, code AS x FROM j UNION ALL SELECT DISTINCT advice_id, 'p', json_pointer FROM j WHERE json_pointer IS NOT NULL UNION ALL SELECT DISTINCT advice_id, 'e', proposal_id FROM j WHERE proposal_id IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY advice_id, k ORDER BY x) AS i FROM d), a AS (SELECT advice_id, string_agg(x, ',' ORDER BY x) FILTER (k = 'c') AS codes, string_agg(x, ',' ORDER BY x) FILTER (k = 'p' AND i <= 20) AS json_pointers, string_agg(x, ',' ORDER BY x) FILTER (k = 'e' AND i <= 5) AS example_ids FROM r GROUP BY 1),
        n AS (SELECT advice_id, target, count(DISTINCT record_id) AS n_records FROM j GROUP BY 1, 2) SELECT advice_id, target, n_records, codes, json_pointers, example_ids FROM n JOIN a USING (advice_id)""",
    "tier_histogram": f"""WITH {_ANSWERS}, {_TIERED} SELECT CASE WHEN e THEN '{TIERS[0][1]}' WHEN c THEN '{TIERS[1][1]}' WHEN l THEN '{TIERS[2][1]}' WHEN away > 0 THEN 'unknown' ELSE 'no_evidence' END AS tier, count(*) AS n FROM tier GROUP BY 1""",
    "tier_supporters": f"""WITH {_ANSWERS}, {_TIERED}, w AS (SELECT proposal_no, CASE WHEN e THEN 'experimental' WHEN c THEN 'computed' WHEN l THEN 'literature' WHEN away > 0 THEN '' ELSE '*' END AS class FROM tier)
        SELECT proposal_no, coalesce(string_agg(provider, ',' ORDER BY provider) FILTER (class = '*' OR (status = 'hit' AND evidence = class)), '') AS supporters FROM ans JOIN w USING (proposal_no) GROUP BY 1""",
    "corpus_coverage": f"WITH {_CORPUS} SELECT provider, count(*) AS n_entries FROM corpus GROUP BY 1",
    "decomposition_products": f"""WITH {_PHASES}, {_FC}, h AS (SELECT proposal_no, synthesis_hint.temperature AS t, synthesis_hint.temperature_unit AS u, synthesis_hint.atmosphere AS gas0 FROM proposals), hk AS (SELECT proposal_no, gas0, {_KELVIN} AS k0 FROM h),
        g AS (SELECT proposal_no, CASE WHEN k0 > 0 AND k0 < 6000 THEN k0 ELSE 1273.15 END AS k, unnest(list_distinct(list_filter(['air', 'H2', CASE WHEN gas0 <> 'unknown' THEN gas0 END], lambda x: x IS NOT NULL))) AS gas FROM hk),
        j AS (SELECT i.proposal_no, gas, g.k AS k, fc.n / i.g AS o, ph.ev FROM ident i JOIN phases ph USING (key) JOIN fc ON fc.proposal_no = i.proposal_no AND fc.sym = 'O' JOIN g ON g.proposal_no = i.proposal_no), bad AS (SELECT proposal_no, gas FROM j WHERE o * {_MU} - ev < 0),
        m AS (SELECT proposal_no, string_agg(sym, ',' ORDER BY sym) AS metals FROM fc WHERE sym <> 'O' GROUP BY 1) SELECT proposal_no, gas AS atmosphere, metals || CASE WHEN gas IN ({', '.join(map(_text, th.WATER_RATIO))}) THEN ',H2O' ELSE ',O2' END AS products FROM bad JOIN m USING (proposal_no)""",
    "symmetry_rank": f"""WITH {_LAT}, q AS (SELECT proposal_no, {_FAMILY} AS asserted, alpha, beta, gamma, abs(a - b) <= 0.01 AS ab, abs(b - c) <= 0.01 AS bc, abs(a - c) <= 0.01 AS ac, abs(alpha - 90) <= 0.5 AS ra, abs(beta - 90) <= 0.5 AS rb, abs(gamma - 90) <= 0.5 AS rg,
        abs(alpha - 90) <= 0.5 AND abs(beta - 90) <= 0.5 AND abs(gamma - 90) <= 0.5 AS sq FROM lat WHERE vol IS NOT NULL), m AS (SELECT proposal_no, asserted, {_METRIC} AS metric FROM q),
        k(family, r) AS (VALUES ('cubic', 7), ('hexagonal', 6), ('trigonal', 5), ('rhombohedral', 5), ('tetragonal', 4), ('orthorhombic', 3), ('monoclinic', 2), ('triclinic', 1))
        SELECT proposal_no, CAST(x.r AS BIGINT) AS metric_rank, x.r > y.r AS more_symmetric FROM m JOIN k x ON x.family = metric JOIN k y ON y.family = asserted""",
    "schema_fields": f"""WITH e AS (SELECT batch_no, CAST(j.key AS BIGINT) AS pos, j.value AS doc FROM batch_files b, json_each(b.payload, '$.proposals') j WHERE json_type(b.payload, '$.proposals') = 'ARRAY' AND json_type(j.value) = 'OBJECT'), k AS (SELECT batch_no, pos, unnest(json_keys(doc)) AS k FROM e)
        SELECT batch_no, pos, '/' || k AS json_pointer, 'FMT.SCHEMA.UNKNOWN_FIELD' AS code FROM k WHERE k NOT IN ({', '.join(map(_text, SCHEMA.fields))})
        UNION ALL SELECT e.batch_no, e.pos, '/' || r.f, 'FMT.SCHEMA.REQUIRED_FIELD_MISSING' FROM e, (VALUES ('proposal_id'), ('composition')) r(f) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.batch_no = e.batch_no AND k.pos = e.pos AND k.k = r.f)""",
    "top_code_fields": f"SELECT code, json_pointer, count(*) AS n FROM ({_CODES}) GROUP BY 1, 2 ORDER BY n DESC, code, json_pointer LIMIT 20",
    "pooled_rates": "SELECT code, json_pointer, CAST(count(*) AS BIGINT) AS total_findings, CAST(count(DISTINCT run_id) + max(CASE WHEN run_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS runs_present_in, round(100.0::DOUBLE * count(*) / (SELECT count(DISTINCT record_id) FROM violations), 3) AS per_100 FROM violations GROUP BY 1, 2",
    "cross_run_trend": """WITH e AS (SELECT min(batch_seq) AS a, max(batch_seq) AS z FROM violations), r AS (SELECT count(DISTINCT record_id) FILTER (batch_seq = a) AS ra, count(DISTINCT record_id) FILTER (batch_seq = z) AS rz FROM violations, e),
        n AS (SELECT code, round(100.0::DOUBLE * count(*) FILTER (batch_seq = a) / any_value(ra), 3) AS first_per_100, round(100.0::DOUBLE * count(*) FILTER (batch_seq = z) / any_value(rz), 3) AS last_per_100 FROM violations, e, r GROUP BY 1) SELECT *, round(last_per_100 - first_per_100, 3) AS change FROM n""",
    "code_rates_by_batch": """WITH r AS (SELECT batch_seq, count(DISTINCT record_id) AS n_records FROM violations WHERE batch_seq IS NOT NULL GROUP BY 1), c AS (SELECT DISTINCT code FROM violations WHERE code IS NOT NULL), n AS (SELECT code, batch_seq, count(*) AS n FROM violations GROUP BY 1, 2)
        SELECT code, batch_seq, round(100.0::DOUBLE * coalesce(n, 0) / n_records, 3) AS per_100 FROM r CROSS JOIN c LEFT JOIN n USING (code, batch_seq)""",
    "component_means": """WITH v AS (SELECT 'overall' AS component, generator_confidence.overall AS v FROM proposals UNION ALL SELECT 'charge', composition.charge FROM proposals UNION ALL SELECT 'duration_hours', synthesis_hint.duration_hours FROM proposals)
        SELECT component, count(*) AS n, round(CAST(sum(CAST(v AS DECIMAL(26, 12))) AS DOUBLE) / count(*), 6) AS mean FROM v WHERE v IS NOT NULL GROUP BY 1""",
    "finding_lifecycle": """WITH m AS (SELECT max(batch_seq) AS z FROM violations), last AS (SELECT DISTINCT fingerprint FROM violations, m WHERE batch_seq = z AND fingerprint IS NOT NULL), old AS (SELECT DISTINCT fingerprint FROM violations, m WHERE batch_seq < z AND fingerprint IS NOT NULL)
        SELECT fingerprint, 'new' AS state FROM (SELECT * FROM last EXCEPT SELECT * FROM old) UNION ALL SELECT fingerprint, 'resolved' FROM (SELECT * FROM old EXCEPT SELECT * FROM last) UNION ALL SELECT fingerprint, 'persistent' FROM (SELECT * FROM last INTERSECT SELECT * FROM old)""",
    "comparability_flags": "SELECT aspect, n_values, n_values <= 1 AS comparable FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS aspect, count(DISTINCT payload->>'$.{a}') AS n_values FROM run_files" for a in ("taxonomy_version", "reward_fn_id", "corpus_fingerprint", "config_sha256", "source_sha256")) + ")",
    "run_table": "SELECT run_id, count(DISTINCT record_id) AS n_records, count(*) AS n_findings FROM violations WHERE run_id IS NOT NULL GROUP BY 1",
    "runs_per_code": "SELECT code, run_id, n, CAST(rank AS BIGINT) AS rank FROM (SELECT code, run_id, count(*) AS n, row_number() OVER (PARTITION BY code ORDER BY count(*) DESC, run_id ASC NULLS LAST) AS rank FROM violations WHERE code IS NOT NULL GROUP BY 1, 2) WHERE rank <= 3",
    "incremental_misses": f"""WITH d AS (SELECT doc_id, CASE WHEN text IS NOT NULL THEN 'sha256:' || sha256(text) END AS content_key, created_at FROM documents) SELECT doc_id, content_key FROM d n WHERE created_at >= {_OLD} AND (content_key IS NULL OR content_key NOT IN (SELECT content_key FROM d WHERE created_at < {_OLD} AND content_key IS NOT NULL))""",
    "incremental_hits": f"""WITH d AS (SELECT doc_id, 'sha256:' || sha256(text) AS content_key, created_at FROM documents WHERE text IS NOT NULL), c AS (SELECT content_key, min(doc_id) AS cached_from FROM d WHERE created_at < {_OLD} GROUP BY 1) SELECT doc_id, cached_from FROM d JOIN c USING (content_key) WHERE created_at >= {_OLD}""",
    "lineage_states": """WITH p AS (SELECT proposal_id, arg_min(sha256(composition.formula), (received_at, proposal_no)) AS r, arg_max(sha256(composition.formula), (received_at, proposal_no)) AS c FROM proposals WHERE proposal_id IS NOT NULL GROUP BY 1)
        SELECT CASE WHEN v IS NULL OR r IS NULL THEN 'UNKNOWN' WHEN r = c THEN 'MATCH' ELSE 'DIVERGED' END AS state, count(*) AS n FROM p LEFT JOIN (SELECT DISTINCT proposal_id AS v FROM violations) ON v = proposal_id GROUP BY 1""",
    "config_diff": """SELECT path, CASE WHEN recorded IS NULL THEN 'added' WHEN current IS NULL THEN 'removed' ELSE 'changed' END AS change, recorded, current FROM (SELECT code AS path, default_level AS recorded FROM taxonomy_codes) FULL OUTER JOIN (SELECT code AS path, max(level) AS current FROM violations WHERE code IS NOT NULL GROUP BY 1) USING (path)
        WHERE recorded IS DISTINCT FROM current""",
    "admission_first_wins": f"WITH {_ADMIT} SELECT * FROM adm",
    "admission_count_identity": f"WITH {_ADMIT} SELECT count(*) AS records_in, count(*) FILTER (decision = 'admitted') AS admitted, count(*) FILTER (decision <> 'admitted') AS quarantined, count(*) FILTER (decision = 'duplicate') AS duplicates FROM adm",
    "conformance_findings": _typed_issues() + "SELECT proposal_no, json_pointer, 'FMT.SCHEMA.TYPE_MISMATCH' AS code FROM issue",
    "quarantine_first_code": _typed_issues() + "SELECT proposal_no, arg_min('FMT.SCHEMA.TYPE_MISMATCH', json_pointer) AS violation_code, count(*) AS n_issues FROM issue GROUP BY 1",
    "rule_ledger_with_zeros": """WITH n AS (SELECT code, count(*) AS n_hits FROM violations GROUP BY 1), s AS (SELECT code, record_id, min(finding_id) AS seq FROM violations WHERE record_id IS NOT NULL GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY seq, record_id) AS r FROM s),
        e AS (SELECT code, string_agg(record_id, ',' ORDER BY record_id) AS examples FROM f WHERE r <= 5 GROUP BY 1) SELECT t.code AS rule_id, coalesce(n_hits, 0) AS n_hits, coalesce(examples, '') AS examples FROM taxonomy_codes t LEFT JOIN n USING (code) LEFT JOIN e USING (code)""",
    "strip_format_chars": r"SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '\p{Cf}', '', 'g')) AS BIGINT) AS removed, 'sha256:' || sha256(regexp_replace(text, '\p{Cf}', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL",
    "fold_separators": r"SELECT doc_id, 'sha256:' || sha256(regexp_replace(translate(text, '·•‧⋅・.−–—₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹', '******---01234567890123456789'), '[ \t\n\r\f\x0B]+', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL",
    "non_ascii_reject": r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[^\x00-\x7F]')",
    "safe_slug": r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^A-Za-z0-9._-]', '_', 'g'), '\.{2,}', '_', 'g'), '^\.+|\.+$', '', 'g'), '^_+|_+$', '', 'g') AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN s = '' THEN 'record' ELSE substring(s, 1, 64) END AS slug FROM s""",
    "candidate_key_hash": "SELECT batch_no, 'sha256:' || sha256(payload) AS candidate_key FROM batch_files",
    "finding_fingerprint": """SELECT finding_id, 'sha256:' || sha256('{"code":' || coalesce(CAST(to_json(code) AS VARCHAR), 'null') || ',"json_pointer":' || coalesce(CAST(to_json(json_pointer) AS VARCHAR), 'null') || ',"observed":' || coalesce(CAST(to_json(observed) AS VARCHAR), 'null') || '}') AS own_fingerprint FROM violations""",
    "naive_timestamp_flag": r"""WITH t AS (SELECT row_no, payload->>'$.logical_time' AS t FROM run_files) SELECT row_no, regexp_matches(t, '^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?') AND NOT regexp_matches(t, '([Zz]|[+-]\d{2}:\d{2})$') AS naive FROM t WHERE t IS NOT NULL""",
    "truncated_messages": "SELECT finding_id, CASE WHEN length(message) > 60 THEN substring(message, 1, 59) || '…' ELSE message END AS message FROM violations",
    "round_significant": "WITH c AS (SELECT proposal_no, unnest(claimed_properties) AS c, generate_subscripts(claimed_properties, 1) - 1 AS pos FROM proposals) SELECT proposal_no, CAST(pos AS BIGINT) AS pos, CAST(format('{:.5e}', c.value) AS DOUBLE) AS value FROM c WHERE c.value IS NOT NULL",
    "orphan_codes": "SELECT finding_id, code FROM violations v WHERE NOT EXISTS (SELECT 1 FROM taxonomy_codes t WHERE t.code = v.code)",
    "missing_rows": "SELECT proposal_no, proposal_id FROM proposals p WHERE NOT EXISTS (SELECT 1 FROM violations v WHERE v.proposal_id = p.proposal_id)",
    "length_rederivation_mismatch": "SELECT doc_id, n_chars, CAST(length(text) AS BIGINT) AS derived FROM documents WHERE NOT coalesce(n_chars = length(text), n_chars IS NULL AND text IS NULL)",
    "ordering_violations": "SELECT finding_id FROM (SELECT finding_id, recorded_at, lag(recorded_at) OVER (ORDER BY finding_id) AS p FROM violations WHERE recorded_at IS NOT NULL) WHERE p > recorded_at",
    "required_phases_missing": "SELECT phase FROM (VALUES ('parse'), ('schema'), ('composition'), ('structure'), ('novelty'), ('feasibility'), ('claims'), ('route'), ('meta')) r(phase) WHERE phase NOT IN (SELECT phase FROM taxonomy_codes WHERE gate)",
    "address_findings": r"SELECT batch_no, 'payload' AS column FROM batch_files WHERE regexp_matches(payload, 'https?://|(^|[\s\x22''=(])(/home/|/root/|/Users/|[A-Za-z]:\\)') UNION ALL SELECT batch_no, 'batch_id' FROM batch_files WHERE regexp_matches(batch_id, 'https?://|(^|[\s\x22''=(])(/home/|/root/|/Users/|[A-Za-z]:\\)')",
}

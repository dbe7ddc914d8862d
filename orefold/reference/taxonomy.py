"""The violation codes: phase, level, whether it gates, whether it means that something could not be checked."""

from __future__ import annotations

# Code phase level gate unverifiable.
_TABLE = """
FMT.JSON.UNPARSEABLE parse error gate -
FMT.JSON.SIZE_EXCEEDED parse error gate -
FMT.JSON.DEPTH_EXCEEDED parse error gate -
FMT.JSON.DUPLICATE_KEY parse error gate -
FMT.JSON.NON_FINITE_NUMBER parse error gate -
FMT.ENCODING.NON_ASCII_SYMBOL parse error - -
FMT.ENCODING.INVISIBLE_CHARACTER parse error - -
FMT.SCHEMA.VERSION_UNSUPPORTED schema error gate -
FMT.SCHEMA.REQUIRED_FIELD_MISSING schema error gate -
FMT.SCHEMA.UNKNOWN_FIELD schema error gate -
FMT.SCHEMA.TYPE_MISMATCH schema error gate -
FMT.ID.DUPLICATE_PROPOSAL_ID schema error - -
FMT.TIME.NAIVE_TIMESTAMP schema warning - -
CHEM.FORMULA.UNPARSEABLE composition error - -
CHEM.FORMULA.UNKNOWN_ELEMENT composition error - -
CHEM.FORMULA.INCONSISTENT_WITH_ELEMENTS composition error - -
CHEM.FORMULA.NOT_REDUCED composition note - -
CHEM.SCOPE.NOT_INORGANIC_CRYSTALLINE composition error - -
CHEM.CHARGE.NOT_NEUTRAL composition warning - -
CHEM.CHARGE.NON_INTEGER_OXIDATION composition warning - -
CHEM.ELECTRONEG.IMBALANCED composition warning - -
STRUCT.GEOM.ATOM_OVERLAP structure error - -
STRUCT.GEOM.IMPLAUSIBLE_LATTICE structure error - -
STRUCT.GEOM.IMPLAUSIBLE_DENSITY structure warning - -
STRUCT.SYMMETRY.SPACEGROUP_INCONSISTENT structure warning - -
STRUCT.SITES.OCCUPANCY_INCONSISTENT structure error - -
NOVEL.DUPLICATE.EXACT_MATCH novelty error - -
NOVEL.DUPLICATE.COMPOSITION_MATCH novelty warning - -
NOVEL.DUPLICATE.STRUCTURE_MATCH novelty warning - -
NOVEL.PRIOR_ART.LITERATURE_MENTION novelty note - -
NOVEL.EVIDENCE.SOURCES_DISAGREE novelty note - -
FEAS.THERMO.EHULL_ABOVE_THRESHOLD feasibility warning - -
FEAS.THERMO.DECOMPOSES feasibility warning - -
FEAS.ATMOSPHERE.UNSTABLE feasibility warning - -
FEAS.FRAME.INAPPROPRIATE feasibility warning - -
FEAS.SYNTH.NO_VIABLE_ROUTE route note - -
FEAS.SYNTH.LOW_DRIVING_FORCE route note - -
FEAS.SYNTH.HINT_INCOHERENT route warning - -
FEAS.SYNTH.PRECURSOR_UNAVAILABLE route note - -
CLAIM.UNSUPPORTED.PROPERTY_ASSERTION claims warning - -
CLAIM.CONTRADICTED.PROPERTY_ASSERTION claims error - -
CLAIM.UNITS.INCONSISTENT claims error - -
CLAIM.VALUE.PHYSICALLY_IMPOSSIBLE claims error - -
CLAIM.SENTINEL.SUSPECTED claims warning - -
CLAIM.CONFIDENCE.MISCALIBRATED claims note - -
VERIFY.UNAVAILABLE.PROVIDER_ERROR meta none - unverifiable
VERIFY.UNAVAILABLE.OFFLINE_CACHE_MISS meta none - unverifiable
VERIFY.DEGRADED.PROVIDER_SKIPPED meta note - -
VERIFY.BUDGET.EXHAUSTED meta note - unverifiable
"""
CODES = [(c, p, l, g == "gate", u != "-") for c, p, l, g, u in (line.split() for line in _TABLE.split("\n") if line)]
TAXONOMY_VERSION = "1.0.0"
PHASES = tuple("parse schema composition structure novelty feasibility claims route meta".split())

# Ledger rules, registered before any is hit: rule action code.
_RULES = """
input.byte_budget reject_field FMT.JSON.SIZE_EXCEEDED
input.nesting_depth reject_field FMT.JSON.DEPTH_EXCEEDED
input.node_count reject_field FMT.JSON.SIZE_EXCEEDED
input.string_length quarantine FMT.SCHEMA.TYPE_MISMATCH
input.array_length quarantine FMT.SCHEMA.TYPE_MISMATCH
input.duplicate_keys reject_field FMT.JSON.DUPLICATE_KEY
input.non_finite_numbers reject_field FMT.JSON.NON_FINITE_NUMBER
input.timezone_naive_timestamps reject_field FMT.TIME.NAIVE_TIMESTAMP
input.schema_version reject_field FMT.SCHEMA.VERSION_UNSUPPORTED
input.json_parseable reject_field FMT.JSON.UNPARSEABLE
record.schema_conformance quarantine FMT.SCHEMA.TYPE_MISMATCH
record.duplicate_proposal_id quarantine FMT.ID.DUPLICATE_PROPOSAL_ID
claims.unit_normalization coerce CLAIM.UNITS.INCONSISTENT
claims.sentinel_values flag CLAIM.SENTINEL.SUSPECTED
"""
RULES = [tuple(line.split()) for line in _RULES.split("\n") if line]

# Recommendation rules: target, then the codes it answers.
_ADVICE = """
decoding FMT.ENCODING.NON_ASCII_SYMBOL FMT.ENCODING.INVISIBLE_CHARACTER
output_schema FMT.SCHEMA.UNKNOWN_FIELD FMT.SCHEMA.REQUIRED_FIELD_MISSING FMT.SCHEMA.TYPE_MISMATCH
prompt CHEM.FORMULA.UNKNOWN_ELEMENT CHEM.FORMULA.UNPARSEABLE
output_schema CHEM.FORMULA.INCONSISTENT_WITH_ELEMENTS
prompt CLAIM.UNITS.INCONSISTENT
training_data CLAIM.SENTINEL.SUSPECTED
prompt CLAIM.VALUE.PHYSICALLY_IMPOSSIBLE
training_data STRUCT.GEOM.ATOM_OVERLAP STRUCT.GEOM.IMPLAUSIBLE_LATTICE STRUCT.GEOM.IMPLAUSIBLE_DENSITY STRUCT.SITES.OCCUPANCY_INCONSISTENT
tooling STRUCT.SYMMETRY.SPACEGROUP_INCONSISTENT
prompt NOVEL.DUPLICATE.EXACT_MATCH
prompt FEAS.SYNTH.HINT_INCOHERENT
prompt CHEM.SCOPE.NOT_INORGANIC_CRYSTALLINE
prompt FEAS.FRAME.INAPPROPRIATE
"""
ADVICE = [(f"advice-{i:02d}", words[0], tuple(words[1:])) for i, words in enumerate((line.split() for line in _ADVICE.split("\n") if line), 1)]

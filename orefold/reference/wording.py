"""What findings, recommendations and notes say; {observed} and {expected} stand for the values of a finding."""

from __future__ import annotations

MESSAGES = {
    "FMT.ENCODING.INVISIBLE_CHARACTER": "The formula {observed} holds characters that cannot be seen; they were left out before it was read.",
    "FMT.ENCODING.NON_ASCII_SYMBOL": "The formula {observed} holds a letter of another script. It is refused, since guessing which element was meant could name another material.",
    "FMT.SCHEMA.UNKNOWN_FIELD": "The schema has no field here.",
    "FMT.SCHEMA.REQUIRED_FIELD_MISSING": "A required field is missing.",
    "FMT.SCHEMA.TYPE_MISMATCH": "The value has another type, range or shape than the schema asks for.",
    "CHEM.FORMULA.UNPARSEABLE": "The formula {observed} cannot be read.",
    "CHEM.FORMULA.UNKNOWN_ELEMENT": "The formula {observed} names an element that does not exist.",
    "CHEM.FORMULA.NOT_REDUCED": "The formula {observed} has a common divisor; reduced it is {expected}.",
    "CHEM.SCOPE.NOT_INORGANIC_CRYSTALLINE": "{observed} is no inorganic crystalline solid: {expected}.",
    "CHEM.CHARGE.NOT_NEUTRAL": "No choice of common oxidation states makes {observed} neutral.",
    "CHEM.ELECTRONEG.IMBALANCED": "{observed} attracts electrons most, yet the neutral assignment does not make it an anion.",
    "CHEM.FORMULA.INCONSISTENT_WITH_ELEMENTS": "Formula and element map disagree about {observed}.",
    "STRUCT.GEOM.IMPLAUSIBLE_LATTICE": "The cell is not plausible: {observed}, where {expected} was to be met.",
    "STRUCT.GEOM.ATOM_OVERLAP": "Two sites are {observed} angstrom apart, closer than {expected}.",
    "STRUCT.GEOM.IMPLAUSIBLE_DENSITY": "The cell and its sites make {observed} g/cm3, outside {expected}.",
    "STRUCT.SITES.OCCUPANCY_INCONSISTENT": "Sites and formula are not in proportion: {observed}.",
    "STRUCT.SYMMETRY.SPACEGROUP_INCONSISTENT": "The cell looks {observed}, the space group is {expected}.",
    "NOVEL.DUPLICATE.EXACT_MATCH": "{observed} has been reported by experiment.",
    "NOVEL.DUPLICATE.COMPOSITION_MATCH": "{observed} is known from computation.",
    "NOVEL.PRIOR_ART.LITERATURE_MENTION": "{observed} is mentioned in the literature.",
    "NOVEL.EVIDENCE.SOURCES_DISAGREE": "Sources of one kind disagree: {observed}.",
    "VERIFY.UNAVAILABLE.OFFLINE_CACHE_MISS": "{observed} was never asked about this composition; that is no answer.",
    "VERIFY.UNAVAILABLE.PROVIDER_ERROR": "{observed} could not be consulted; that is no answer.",
    "FEAS.THERMO.EHULL_ABOVE_THRESHOLD": "The compound lies {observed} eV per atom above the hull; {expected} is the threshold.",
    "FEAS.THERMO.DECOMPOSES": "Known phases at this composition lie lower: {observed}.",
    "FEAS.ATMOSPHERE.UNSTABLE": "The oxide does not survive {observed}.",
    "FEAS.FRAME.INAPPROPRIATE": "The stability computed does not speak about these conditions: {observed}.",
    "FEAS.SYNTH.NO_VIABLE_ROUTE": "No route gains energy: {observed}.",
    "FEAS.SYNTH.LOW_DRIVING_FORCE": "The best route gains only {observed} eV per atom.",
    "FEAS.SYNTH.HINT_INCOHERENT": "The synthesis hint does not fit the compound: {observed}.",
    "FEAS.SYNTH.PRECURSOR_UNAVAILABLE": "The precursor {observed} cannot be read as a formula.",
    "CLAIM.VALUE.PHYSICALLY_IMPOSSIBLE": "The claimed value {observed} cannot be; {expected} is the least possible.",
    "CLAIM.UNITS.INCONSISTENT": "The unit {observed} does not fit; {expected} was used before or is the unit of the property.",
    "CLAIM.SENTINEL.SUSPECTED": "{observed} looks like a placeholder, not like a measurement.",
    "CLAIM.UNSUPPORTED.PROPERTY_ASSERTION": "Nothing supports the claimed value {observed}; {expected} is plausible.",
}

#: By the number of the recommendation rule, what to change.
ADVICE = (
    "Let the decoder write ASCII only into formulas: look-alike and invisible characters miss every lookup and make known materials look new.",
    "Check the schema while generating; a record that breaks it cannot be judged at all.",
    "Ask for an element map checked against the periodic table instead of a free formula.",
    "Ask for the composition once; where formula and map differ, nobody can tell which was meant.",
    "Name one unit per property in the prompt and refuse any other; a wrong unit still looks plausible.",
    "Take placeholder values such as -999 out of the training data.",
    "State the physical range of each property in the prompt.",
    "Filter cells and sites by simple geometry before a record leaves the generator.",
    "Derive the space group from the coordinates instead of asserting one.",
    "Show the generator which compositions of the chemical system are known.",
    "Have the atmosphere justified against the chemistry of the target.",
    "Repeat the scope in the prompt; molecules and polymers are not judged here.",
    "Have every stability claim name the conditions it holds under.",
)

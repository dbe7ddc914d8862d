"""Facts of compositions: each distinct formula is parsed and screened once and joined back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefold.functions import chemistry as ch
from orefold.functions import formula as fm
from orefold.operators.findings import found_many
from orefold.plans.skew import dealt, dictionary_join

_S, _D, _B = T.StringType(), T.DoubleType(), T.BooleanType()
_MIX = T.ArrayType(T.StructType([T.StructField("formula", _S), T.StructField("fraction", _D)]))
_ROUTE = T.StructType(
    [T.StructField("rank", T.IntegerType()), T.StructField("route_id", _S), T.StructField("reaction", _S), T.StructField("balanced", _B), T.StructField("energy", _D)]
)
FACTS = T.StructType(
    [
        T.StructField("folded", _S), T.StructField("code", _S), T.StructField("reason", _S), T.StructField("invisible", _B),
        T.StructField("steps", T.ArrayType(T.StructType([T.StructField(c, _S) for c in ("step", "before", "after")]))),
        T.StructField("counts", T.MapType(_S, _D)), T.StructField("elements", T.ArrayType(_S)), T.StructField("chemsys", _S),
        T.StructField("reduced", _S), T.StructField("key", _S), T.StructField("divisor", T.IntegerType()), T.StructField("out_of_scope", _S),
        T.StructField("metallic", _B), T.StructField("charge", _S), T.StructField("states", T.MapType(_S, T.IntegerType())), T.StructField("misplaced", _S),
        T.StructField("hull", _D), T.StructField("own", _D), T.StructField("above", _D), T.StructField("mix", _MIX), T.StructField("routes", T.ArrayType(_ROUTE)),
    ]
)


def facts_of(raw: str | None, budget: int = 20_000, max_routes: int = 3) -> tuple:
    f = fm.parse(raw)
    steps = [{"step": a, "before": b, "after": c} for a, b, c in f.steps]
    if not f.ok:
        return (f.folded, f.code, f.reason, f.invisible, steps, *[None] * 16)
    outcome, states = ch.assignment(f.counts, budget)
    h = ch.hull(f.counts)
    side = lambda s: " + ".join(f"{n:g} {x}" for x, n in s)
    ways = [{"rank": r.rank, "route_id": r.family, "reaction": f"{side(r.left)} -> {side(r.right)}", "balanced": r.balanced, "energy": r.energy} for r in ch.routes(f.counts, max_routes)]
    mix = [{"formula": a, "fraction": b} for a, b in h.mix]
    return (
        f.folded, None, None, f.invisible, steps, f.counts, sorted(f.counts), "-".join(sorted(f.counts)), fm.spell(f.counts), fm.key(f.counts), fm.divisor(f.counts), fm.scope(f.counts),
        fm.metallic(f.counts), outcome, states, ch.misplaced_anion(f.counts, states), h.energy, h.own, h.above, mix, ways,
    )


@F.pandas_udf(FACTS)
def _facts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = FACTS.fieldNames()
    for s in batches:
        yield pd.DataFrame([facts_of(v) for v in s], columns=names)


def with_facts(df: DataFrame, key: str, formula: str, *, total: int | None = None) -> DataFrame:
    """df with a struct column facts for its formula; null and empty formulas are rejected ones.

    A frequent formula is looked up in a broadcast of at most a thousand; the others meet in a shuffle."""
    total = df.count() if total is None else total
    named = df.withColumn("_formula", F.coalesce(F.col(formula), F.lit("")))
    words = named.groupBy("_formula").agg(F.count(F.lit(1)).alias("n"))
    words = dealt(words).withColumn("facts", _facts("_formula"))
    return dictionary_join(named, words, ["_formula"], spread=F.col(key), total=total).drop("_formula")


def map_disagreement(parsed: Column, given: Column) -> Column:
    """Elements whose amounts in the formula and in the map differ, sorted; null if either is missing or the map empty."""
    keys = F.array_sort(F.array_union(F.map_keys(parsed), F.map_keys(given)))
    differs = F.filter(keys, lambda k: ~F.coalesce(F.abs(F.try_element_at(parsed, k) - F.try_element_at(given, k)) <= 1e-9, F.lit(False)))
    return F.when(parsed.isNotNull() & given.isNotNull() & (F.size(given) > 0), F.array_join(differs, ","))


def composition_findings(df: DataFrame, key: str, *, neutrality_level: str = "warning") -> DataFrame:
    """Findings on formula and composition. df has facts, formula and elements (the declared map or null)."""
    f = F.col("facts")
    at = "/composition/formula"
    ok = f["key"].isNotNull()
    differs = map_disagreement(f["counts"], F.col("elements"))
    return found_many(
        df,
        key,
        [
            (f["invisible"], "FMT.ENCODING.INVISIBLE_CHARACTER", "error", at, F.col("formula")),
            (f["code"] == "FMT.ENCODING.NON_ASCII_SYMBOL", "FMT.ENCODING.NON_ASCII_SYMBOL", "error", at, F.col("formula")),
            (f["code"] == "CHEM.FORMULA.UNPARSEABLE", "CHEM.FORMULA.UNPARSEABLE", "error", at, F.col("formula")),
            (f["code"] == "CHEM.FORMULA.UNKNOWN_ELEMENT", "CHEM.FORMULA.UNKNOWN_ELEMENT", "error", at, F.col("formula")),
            (f["divisor"] > 1, "CHEM.FORMULA.NOT_REDUCED", "note", at, F.col("formula"), f["reduced"]),
            (ok & f["out_of_scope"].isNotNull(), "CHEM.SCOPE.NOT_INORGANIC_CRYSTALLINE", "error", at, f["reduced"], f["out_of_scope"]),
            (f["charge"] == "unbalanced", "CHEM.CHARGE.NOT_NEUTRAL", neutrality_level, at, f["reduced"]),
            (f["misplaced"].isNotNull(), "CHEM.ELECTRONEG.IMBALANCED", "warning", at, f["misplaced"]),
            (differs != "", "CHEM.FORMULA.INCONSISTENT_WITH_ELEMENTS", "error", "/composition/elements", differs),
        ],
    )

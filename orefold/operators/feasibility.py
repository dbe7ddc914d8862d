"""Feasibility: hull distance, open-system survival, frame, synthesis hint and routes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefold.functions import formula as fm
from orefold.functions.text import first_bare_word
from orefold.operators.findings import found, found_many
from orefold.reference import thermochemistry as th


def kelvin(temperature: Column, unit: Column) -> Column:
    """Temperature in kelvin; a missing unit is kelvin, an unknown one gives null."""
    return F.when(unit == "C", temperature + 273.15).when(unit == "F", (temperature - 32.0) * 5.0 / 9.0 + 273.15).when(unit.isNull() | (unit == "K"), temperature)


def oxygen_potential(atmosphere: Column, t: Column) -> Column:
    """Oxygen potential in eV of an atmosphere at t kelvin; null for one without."""
    kt = F.lit(th.BOLTZMANN_EV) * t
    entropy = (th.STEAM_ENTROPY - th.HYDROGEN_ENTROPY - th.OXYGEN_ENTROPY / 2) / 1000
    out = F.when(atmosphere.isNull(), F.lit(None).cast("double"))
    for gas, bar in th.OXYGEN_BAR.items():
        out = out.when(atmosphere == gas, kt * F.lit(math.log(bar) / 2))
    for gas, ratio in th.WATER_RATIO.items():
        out = out.when(atmosphere == gas, (F.lit(th.STEAM_ENTHALPY) - t * entropy) / th.KJ_PER_EV + kt * F.lit(math.log(ratio)))
    return out


def survival(n_oxygen: Column, enthalpy: Column, n_atoms: Column, potential: Column) -> Column:
    """Driving force per atom of reduction to the elements; the oxide survives from 0 on."""
    return (n_oxygen * potential - enthalpy) / n_atoms


def atmospheres(proposed: Column, screened: list[str]) -> Column:
    """Sorted distinct atmospheres to screen: the configured ones and the proposed one, unless unknown."""
    fixed = F.array(*[F.lit(a) for a in screened])
    return F.array_sort(F.array_union(fixed, F.when(proposed.isNotNull() & (proposed != "unknown"), F.array(proposed)).otherwise(F.array().cast("array<string>"))))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _readable(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([None if names is None else [n is None or not n.strip() or fm.parse(n).ok for n in names] for names in s], dtype=object)


def _named(precursors: Column) -> Column:
    """Whether the formula part of each precursor can be read; blank ones count as readable."""
    return _readable(F.transform(precursors, first_bare_word))


def screen(df: DataFrame, key: str, config: dict) -> DataFrame:
    """df (facts, hint) with kelvin, forces (atmosphere -> driving force), unstable, decomposition (atmosphere ->
    what is left of an oxide that does not survive), frame, verdict."""
    f, hint = F.col("facts"), F.col("hint")
    asked = kelvin(hint["temperature"], hint["temperature_unit"])
    at = F.when((asked > 0) & (asked < 6000), asked).otherwise(F.lit(config["temperature"]))
    out = df.withColumn("kelvin", asked).withColumn("screened_at", at)
    oxygen = F.try_element_at(f["counts"], F.lit("O")) / f["divisor"]
    atoms = F.aggregate(F.map_values(f["counts"]), F.lit(0.0), lambda a, v: a + v) / f["divisor"]
    gases = F.when(oxygen.isNotNull() & f["own"].isNotNull(), atmospheres(hint["atmosphere"], config["atmospheres"]))
    forces = F.transform(gases, lambda g: F.struct(g.alias("atmosphere"), survival(oxygen, f["own"] * atoms, atoms, oxygen_potential(g, F.col("screened_at"))).alias("force")))
    out = out.withColumn("forces", F.coalesce(F.filter(forces, lambda x: x["force"].isNotNull()), F.expr("cast(array() as array<struct<atmosphere:string,force:double>>)")))
    out = out.withColumn("unstable", F.transform(F.filter("forces", lambda x: x["force"] < 0), lambda x: x["atmosphere"]))
    metals = F.filter(F.array_sort(F.map_keys(f["counts"])), lambda e: e != "O")
    gone = lambda g: F.struct(g.alias("atmosphere"), F.concat(metals, F.array(F.when(g.isin(*th.WATER_RATIO), F.lit("H2O")).otherwise(F.lit("O2")))).alias("products"))
    out = out.withColumn("decomposition", F.transform("unstable", gone))
    frame = F.when(F.size("forces") > 0, "grand_potential").when(f["hull"].isNotNull(), "closed_0k").otherwise("not_evaluated")
    t = config["threshold"]
    hold = F.size("unstable") == 0
    verdict = (
        F.when(f["key"].isNull(), F.lit(None).cast("string"))
        .when(f["charge"] == "unbalanced", "implausible")
        .when((f["above"] <= t) & hold, "plausible")
        .when(f["above"] <= 2 * t, "marginal")
        .when(f["above"].isNotNull(), "implausible")
        .otherwise("unknown")
    )
    return out.withColumn("frame", frame).withColumn("feasibility", verdict)


def feasibility_findings(s: DataFrame, key: str, config: dict) -> DataFrame:
    f, hint, t = F.col("facts"), F.col("hint"), config["threshold"]
    formula = "/composition/formula"
    ok = f["key"].isNotNull()
    above = ok & (f["charge"] != "unbalanced") & (f["above"] > t)
    screened = F.transform("forces", lambda x: x["atmosphere"])
    open_ = ok & hint["atmosphere"].isin(*config["reactive"]) & ~F.array_contains(screened, hint["atmosphere"])
    gas = s.where(F.size("unstable") > 0).select(key, F.explode("unstable").alias("observed"))
    gas = found(gas, key, F.lit(True), "FEAS.ATMOSPHERE.UNSTABLE", "warning", "/synthesis_hint/atmosphere", F.col("observed"))
    rest = found_many(
        s,
        key,
        [
            (above, "FEAS.THERMO.EHULL_ABOVE_THRESHOLD", "warning", formula, f["above"], F.lit(t)),
            (above & (F.size(f["mix"]) > 0), "FEAS.THERMO.DECOMPOSES", "warning", formula, F.array_join(F.transform(f["mix"], lambda m: m["formula"]), ", ")),
            (ok & (F.col("kelvin") > config["frame_limit"]) & (F.col("frame") == "closed_0k"), "FEAS.FRAME.INAPPROPRIATE", "warning", "/synthesis_hint/temperature", F.col("kelvin")),
            (open_, "FEAS.FRAME.INAPPROPRIATE", "note", "/synthesis_hint/atmosphere", hint["atmosphere"]),
        ],
    )
    return gas.unionByName(rest)


def route_findings(s: DataFrame, key: str, config: dict) -> DataFrame:
    """Findings on routes and on the synthesis hint of rows in scope; s is screened."""
    f, hint = F.col("facts"), F.col("hint")
    at = "/composition/formula"
    inside = s.where(f["key"].isNotNull() & f["out_of_scope"].isNull())
    best = F.array_min(F.transform(f["routes"], lambda r: r["energy"]))
    has = lambda e: F.array_contains(f["elements"], e)
    k = F.col("kelvin_any")
    inside = inside.withColumn("kelvin_any", F.coalesce(F.col("kelvin"), hint["temperature"]))
    reducing = has("O") & hint["atmosphere"].isin("H2", "forming_gas", "NH3")
    oxidising = (has("N") | has("S")) & ~has("O") & hint["atmosphere"].isin("air", "O2")
    rest = found_many(
        inside,
        key,
        [
            (best > 0, "FEAS.SYNTH.NO_VIABLE_ROUTE", "note", at, best),
            ((best <= 0) & (F.abs(best) < config["low_force"]), "FEAS.SYNTH.LOW_DRIVING_FORCE", "note", at, best),
            ((F.size(f["routes"]) == 0) & F.col("feasibility").isin("plausible", "marginal"), "FEAS.SYNTH.NO_VIABLE_ROUTE", "note", at, f["reduced"]),
            (reducing | oxidising, "FEAS.SYNTH.HINT_INCOHERENT", "warning", "/synthesis_hint/atmosphere", hint["atmosphere"]),
            ((k <= 0) | (k > 4000), "FEAS.SYNTH.HINT_INCOHERENT", "warning", "/synthesis_hint/temperature", k),
        ],
    )
    named = inside.where(F.size(hint["precursors"]) > 0).select(key, hint["precursors"].alias("p"), _named(hint["precursors"]).alias("ok"))
    bad = named.select(key, F.posexplode(F.arrays_zip("p", "ok")).alias("i", "x")).where(~F.col("x.ok"))
    bad = found(bad, key, F.lit(True), "FEAS.SYNTH.PRECURSOR_UNAVAILABLE", "note", F.concat(F.lit("/synthesis_hint/precursors/"), F.col("i").cast("string")), F.col("x.p"))
    return rest.unionByName(bad)


def ranked_routes(s: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(key, rank, route_id, reaction, balanced, energy): the k best routes of each row in scope."""
    return s.where(F.col("facts.out_of_scope").isNull()).select(key, F.inline(F.slice("facts.routes", 1, k)))

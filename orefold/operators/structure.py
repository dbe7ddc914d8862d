"""Structure checks: bounds, volume, overlap, density, occupancy against the formula, symmetry against the metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefold.functions import geometry as g
from orefold.operators.findings import found_many
from orefold.reference.elements import MASS



def masses() -> Column:
    return F.create_map(*[F.lit(x) for pair in MASS.items() for x in pair])


def cells(df: DataFrame, structure: str = "structure") -> DataFrame:
    """df with a, b, c (angstrom), alpha, beta, gamma (degree), volume, evaluated and the usable sites.

    A structure with an unknown length unit or a missing lattice value is not evaluated. Sites without
    three coordinates are left out; a missing occupancy is 1."""
    l = F.col(structure)["lattice"]
    scale = g.length_scale(l["length_unit"])
    out = df.withColumns({x: l[x] * scale for x in "abc"})
    out = out.withColumns({x: g.in_degrees(l[x], l["angle_unit"]) for x in ("alpha", "beta", "gamma")})
    cols = [F.col(x) for x in ("a", "b", "c", "alpha", "beta", "gamma")]
    known = F.lit(True)
    for c in cols:
        known = known & c.isNotNull()
    out = out.withColumn("evaluated", known).withColumn("volume", F.when(F.col("evaluated"), g.volume(*cols)))
    usable = F.filter(F.col(structure)["sites"], lambda s: (F.size(s["frac_coords"]) == 3) & ~F.exists(s["frac_coords"], lambda v: v.isNull()))
    sites = F.transform(usable, lambda s: F.struct(s["element"].alias("element"), s["frac_coords"].alias("at"), F.coalesce(s["occupancy"], F.lit(1.0)).alias("occupancy")))
    return out.withColumn("usable", F.coalesce(sites, F.expr("cast(array() as array<struct<element:string,at:array<double>,occupancy:double>>)")))


def density(cell: DataFrame) -> DataFrame:
    """cell with density; null without volume or sites, or if a site's element has no mass."""
    mass = masses()
    unknown = F.exists("usable", lambda s: s["element"].isNotNull() & (s["element"] != "") & F.try_element_at(mass, s["element"]).isNull())
    total = F.aggregate("usable", F.lit(0.0), lambda t, s: t + F.coalesce(F.try_element_at(mass, s["element"]), F.lit(0.0)) * s["occupancy"])
    ok = F.col("volume").isNotNull() & (F.size("usable") > 0) & ~unknown
    return cell.withColumn("density", F.when(ok, total * F.lit(g.DENSITY) / F.col("volume")))


def site_totals(cell: DataFrame) -> DataFrame:
    """cell with totals, the occupancy of each element over the usable sites, in order of the symbol."""
    named = F.filter("usable", lambda s: s["element"].isNotNull() & (s["element"] != ""))
    names = F.array_sort(F.array_distinct(F.transform(named, lambda s: s["element"])))
    amounts = F.transform(names, lambda e: F.aggregate(F.filter(named, lambda s: s["element"] == e), F.lit(0.0), lambda t, s: t + s["occupancy"]))
    return cell.withColumn("totals", F.map_from_arrays(names, amounts))


def disproportion(totals: Column, counts: Column, tolerance: float = 0.02) -> Column:
    """'elements' if sites and formula hold other elements, the first element out of proportion, or null."""
    a, b = F.array_sort(F.map_keys(totals)), F.array_sort(F.map_keys(counts))
    first = F.get(b, F.lit(0))
    z = F.try_element_at(totals, first) / F.try_element_at(counts, first)
    off = F.filter(b, lambda e: F.abs(totals[e] - counts[e] * z) > F.greatest(F.lit(tolerance), F.lit(tolerance) * counts[e] * z))
    named = totals.isNotNull() & counts.isNotNull() & (F.size(totals) > 0)
    return F.when(named & (a != b), F.lit("elements")).when(named & (z > 0), F.get(off, F.lit(0)))


def measured(df: DataFrame, structure: str = "structure", *, metric_length: float = 0.01, metric_angle: float = 0.5) -> DataFrame:
    """cells() with density, totals, nearest, metric and asserted family."""
    out = site_totals(density(cells(df, structure)))
    cell = F.array(*[F.col(x) for x in ("a", "b", "c", "alpha", "beta", "gamma")])
    near = g.shortest_distance(F.when(F.col("volume").isNotNull(), F.transform("usable", lambda s: s["at"])), cell)
    out = out.withColumn("nearest", near)
    cols = [F.col(x) for x in ("a", "b", "c", "alpha", "beta", "gamma")]
    return out.withColumns({"metric": F.when(F.col("volume").isNotNull(), g.family_of_metric(*cols, metric_length, metric_angle)), "asserted": g.family_of_group(F.col(structure)["space_group"]["number"])})


def structure_findings(m: DataFrame, key: str, v: dict, counts: Column) -> DataFrame:
    """Findings on measured() rows; counts is the parsed formula or null. Without volume only the lattice counts."""
    (lo, hi), (alo, ahi), (dlo, dhi) = v["lattice"], v["angles"], v["density"]
    cases = []
    for x in ("a", "b", "c", "alpha", "beta", "gamma"):
        low, high = (lo, hi) if len(x) == 1 else (alo, ahi)
        cases.append((F.col("evaluated") & ~F.col(x).between(low, high), "STRUCT.GEOM.IMPLAUSIBLE_LATTICE", "error", f"/structure/lattice/{x}", F.col(x), f"{low:g} to {high:g}"))
    cases.append((F.col("evaluated") & F.col("volume").isNull(), "STRUCT.GEOM.IMPLAUSIBLE_LATTICE", "error", "/structure/lattice", None, "angles that close a cell"))
    overlap = F.col("nearest")["distance"] < v["min_distance"]
    cases.append((overlap, "STRUCT.GEOM.ATOM_OVERLAP", "error", F.concat(F.lit("/structure/sites/"), F.col("nearest")["j"].cast("string"), F.lit("/frac_coords")), F.col("nearest")["distance"], F.lit(float(v["min_distance"]))))
    cases.append((~F.col("density").between(dlo, dhi), "STRUCT.GEOM.IMPLAUSIBLE_DENSITY", "warning", "/structure/lattice", F.col("density"), f"{dlo:g} to {dhi:g}"))
    off = F.when(F.col("volume").isNotNull(), disproportion(F.col("totals"), counts, v["occupancy_tolerance"]))
    cases.append((off.isNotNull(), "STRUCT.SITES.OCCUPANCY_INCONSISTENT", "error", "/structure/sites", off))
    wrong = F.col("asserted").isNotNull() & F.col("metric").isNotNull() & ~g.families_agree(F.col("asserted"), F.col("metric"))
    cases.append((wrong, "STRUCT.SYMMETRY.SPACEGROUP_INCONSISTENT", "warning", "/structure/space_group/number", F.col("metric"), F.concat(F.col("asserted"), F.when(g.more_symmetric(F.col("metric"), F.col("asserted")), F.lit(", which needs less symmetry")).otherwise(F.lit(", which needs another cell")))))
    return found_many(m, key, cases)



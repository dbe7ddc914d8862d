"""Claims audit: unit tokens, conversion, batch consistency, placeholders, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.functions.text import is_ascii, nfkc
from orefold.operators.findings import found_many
from orefold.plans.skew import dictionary_join
from orefold.reference.properties import FACTORS, OVERFLOW, SENTINEL_EXACT, SENTINEL_MAGNITUDES, SPECS
from orefold.session import cut


def token(unit: Column, *, unicode: bool = True) -> Column:
    """Folded unit: compatibility form, plain signs, no blanks, lower case, no power marks. Null is ''."""
    folded = F.when(is_ascii(unit), unit).otherwise(nfkc(unit)) if unicode else unit
    folded = F.replace(F.translate(folded, "−·µμ", "-.uu"), F.lit("**"), F.lit(""))
    return F.coalesce(F.replace(F.lower(F.regexp_replace(folded, r"\s+", "")), F.lit("^"), F.lit("")), F.lit(""))


def specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPECS, "name string, canonical string, hard_min double, plausible_min double, plausible_max double")


def factors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FACTORS, "canonical string, token string, factor double, offset double")


def long_claims(df: DataFrame, key: str, order: str, claims: str = "claimed_properties") -> DataFrame:
    """(key, order, pos, name, value, unit): one row per claim that is not null."""
    out = df.select(key, *([order] if order != key else []), F.posexplode(claims).alias("pos", "c")).where(F.col("c").isNotNull())
    return out.select(key, *([order] if order != key else []), "pos", F.col("c.name").alias("name"), F.col("c.value").alias("value"), F.col("c.unit").alias("unit"))


def first_units(claims: DataFrame, order: str) -> DataFrame:
    """(name, first_token, n): the token of the first claim of each property in input order; empty tokens do not
    count. n is the number of such claims.

    One row per property; the minimum is taken before the shuffle."""
    t = claims.where(F.col("name").isNotNull()).withColumn("token", token(F.col("unit"))).where(F.col("token") != "")
    return t.groupBy("name").agg(F.min(F.struct(order, "pos", "token")).alias("m"), F.count(F.lit(1)).alias("n")).select("name", F.col("m.token").alias("first_token"), "n")


def sentinel(value: Column, plausible_max: Column) -> Column:
    nines = F.abs(value).isin(*SENTINEL_MAGNITUDES)
    return value.isin(*SENTINEL_EXACT) | (nines & ((value < 0) | (value > plausible_max) | (F.abs(value) >= 999.0)))


def assess(claims: DataFrame, order: str, *, units: DataFrame | None = None) -> DataFrame:
    """claims with token, canonical, factor, normalized, first_token, is_sentinel and assessment.

    assessment is the first that applies of not_a_number, overflow, unknown_property, unit_error, sentinel,
    impossible, implausible; else unsupported. Property and unit tables are broadcast; they are fixed. A
    property name may hold most of the claims, so the first units are joined with hot names apart."""
    spark = claims.sparkSession
    units = cut(first_units(claims, order)) if units is None else units
    total = units.agg(F.sum("n")).first()[0] or 0
    c = claims.withColumn("token", token(F.col("unit"))).join(F.broadcast(specs(spark)), "name", "left")
    c = c.join(F.broadcast(factors(spark)), ["canonical", "token"], "left")
    c = dictionary_join(c, units, ["name"], spread=F.xxhash64(order, "pos"), total=total)
    v = F.col("value")
    c = c.withColumn("normalized", v * F.col("factor") + F.col("offset"))
    c = c.withColumn("is_sentinel", F.coalesce(sentinel(v, F.col("plausible_max")), F.lit(False)))
    n = F.col("normalized")
    verdict = (
        F.when(v.isNull(), "not_a_number")
        .when(F.isnan(v) | (F.abs(v) > OVERFLOW), "overflow")
        .when(F.col("canonical").isNull(), "unknown_property")
        .when(F.col("factor").isNull(), "unit_error")
        .when(F.col("is_sentinel"), "sentinel")
        .when(n < F.col("hard_min"), "impossible")
        .when((n < F.col("plausible_min")) | (n > F.col("plausible_max")), "implausible")
        .otherwise("unsupported")
    )
    return c.withColumn("assessment", verdict)


def is_bad(assessment: Column) -> Column:
    return assessment.isin("overflow", "unit_error", "sentinel", "impossible", "implausible")


def normalizations(assessed: DataFrame, key: str) -> DataFrame:
    """The log of conversions: claims whose unit was not the canonical one."""
    changed = (F.col("factor") != 1.0) | (F.col("offset") != 0.0)
    known = ~F.col("assessment").isin("not_a_number", "overflow", "unknown_property", "unit_error")
    return assessed.where(changed & known).select(key, "pos", "name", F.col("unit").alias("from_unit"), F.col("canonical").alias("to_unit"), "factor")


def claim_findings(assessed: DataFrame, key: str) -> DataFrame:
    at = F.concat(F.lit("/claimed_properties/"), F.col("pos").cast("string"))
    a, unit, value = F.col("assessment"), F.concat(at, F.lit("/unit")), F.concat(at, F.lit("/value"))
    checked = ~a.isin("not_a_number", "overflow", "unknown_property")
    plausible = F.concat_ws(" to ", F.col("plausible_min").cast("string"), F.col("plausible_max").cast("string"))
    alien = ~F.coalesce(is_ascii(F.col("unit")), F.lit(True))
    return found_many(
        assessed,
        key,
        [
            (a.isin("overflow", "impossible"), "CLAIM.VALUE.PHYSICALLY_IMPOSSIBLE", "error", value, F.coalesce("normalized", "value"), F.col("hard_min")),
            (checked & (alien | (a == "unit_error")), "CLAIM.UNITS.INCONSISTENT", "error", unit, F.col("unit"), F.col("canonical")),
            (checked & (a != "unit_error") & (F.col("first_token") != F.col("token")), "CLAIM.UNITS.INCONSISTENT", "warning", unit, F.col("unit"), F.col("first_token")),
            (a == "sentinel", "CLAIM.SENTINEL.SUSPECTED", "warning", value, F.col("value")),
            (a == "implausible", "CLAIM.UNSUPPORTED.PROPERTY_ASSERTION", "warning", value, F.col("normalized"), plausible),
            (a == "unsupported", "CLAIM.UNSUPPORTED.PROPERTY_ASSERTION", "note", value, F.col("normalized"), plausible),
        ],
    )

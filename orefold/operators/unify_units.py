"""Quantities recorded in different units: every claim, temperature and cell length in its common unit."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefold.functions.units import conversion, noted_temperature_unit, stated_unit

CONVERSION = T.StructType([T.StructField("status", T.StringType()), T.StructField("scale", T.DoubleType()), T.StructField("offset", T.DoubleType())])
SAME = 1e-12


def resolve(quantity: str | None, unit: str | None, text: str | None) -> tuple[str, float | None, float | None]:
    """(status, scale, offset): same, converted, or unknown if the unit column holds no unit of the quantity.

    The unit column decides if it is not null or blank, else a statement in the text, else the common unit.
    """
    if quantity is None:
        return "unknown", None, None
    if unit is not None and unit.strip():
        found = conversion(quantity, unit.strip())
    else:
        said = None if text is None else noted_temperature_unit(text) if quantity == "temperature" else stated_unit(quantity, text)
        found = (1.0, 0.0) if said is None else conversion(quantity, said)
    if found is None:
        return "unknown", None, None
    scale, offset = found
    return ("same" if abs(scale - 1) < SAME and abs(offset) < SAME else "converted"), scale, offset


#: Texts up to this length are remembered with their result; longer ones are read again.
SHORT = 400
_remembered = lru_cache(maxsize=1 << 15)(resolve)


def _resolved(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for q, u, t in batches:
        rows = pd.MultiIndex.from_arrays([q, u, t]).factorize()
        found = [(resolve if isinstance(x[2], str) and len(x[2]) > SHORT else _remembered)(*(v if isinstance(v, str) else None for v in x)) for x in rows[1]]
        yield pd.DataFrame(found, columns=["status", "scale", "offset"]).iloc[rows[0]].reset_index(drop=True)


def _resolve(quantity: str, unit: str, text: str) -> Column:
    """resolve() of three columns. Said to be nondeterministic so that filters stay above it and it runs once."""
    return F.pandas_udf(_resolved, CONVERSION).asNondeterministic()(quantity, unit, text)


def _blank(unit: Column) -> Column:
    return unit.isNull() | (F.trim(F.regexp_replace(unit, r"[\s\x{00A0}]", " ")) == "")


def quantities(df: DataFrame, key: str) -> DataFrame:
    """(key, field_kind, pos, quantity, value, unit, text): every non-null quantity, long; text only where the
    unit column is blank."""
    claims = df.select(key, "rationale", F.posexplode("claimed_properties").alias("pos", "c")).select(
        key, F.lit("claim").alias("field_kind"), "pos", F.col("c.name").alias("quantity"), F.col("c.value").alias("value"), F.col("c.unit").alias("unit"), F.col("rationale").alias("text")
    )
    heat = df.select(
        key, F.lit("temperature").alias("field_kind"), F.lit(0).alias("pos"), F.lit("temperature").alias("quantity"), F.col("synthesis_hint.temperature").alias("value"), F.col("synthesis_hint.temperature_unit").alias("unit"), F.col("synthesis_hint.notes").alias("text")
    )
    lattice = F.col("structure.lattice")
    cell = df.where(lattice.isNotNull()).select(key, "rationale", lattice.alias("l")).select(
        key, F.lit("lattice").alias("field_kind"), F.posexplode(F.array("l.a", "l.b", "l.c")).alias("pos", "value"), F.lit("lattice").alias("quantity"), F.col("l.length_unit").alias("unit"), F.col("rationale").alias("text")
    )
    cols = [key, "field_kind", "pos", "quantity", "value", "unit", "text"]
    out = claims.select(*cols).unionByName(heat.select(*cols)).unionByName(cell.select(*cols))
    return out.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("text", F.when(_blank(F.col("unit")), F.col("text")))


def common_units(df: DataFrame, key: str) -> DataFrame:
    """quantities() with status and common, the value in the common unit; null where the unit is unknown.

    Null structs, arrays and elements give no rows; a claim of a property without a common unit is unknown;
    infinite values stay infinite."""
    q = quantities(df, key).withColumn("_r", _resolve("quantity", "unit", "text"))
    return q.select(key, "field_kind", "pos", "quantity", "value", "unit", F.col("_r.status").alias("status"), (F.col("value") * F.col("_r.scale") + F.col("_r.offset")).alias("common"))


def converted(df: DataFrame, key: str) -> DataFrame:
    """(key, field_kind, pos, milli): the quantities recorded in another unit than the common one."""
    c = common_units(df, key).where((F.col("status") == "converted") & (F.abs("common") < 9e15))
    return c.select(key, "field_kind", F.col("pos").cast("int").alias("pos"), F.round(F.col("common") * 1000).cast("bigint").alias("milli"))

"""Findings as long rows, and the small tables they are joined with."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.functions.text import fingerprint, truncate
from orefold.reference.taxonomy import CODES
from orefold.reference.wording import MESSAGES

#: observed and expected are texts; observed_kind says what the observed one was: string, number, integer, boolean.
COLUMNS = ("code", "level", "json_pointer", "message", "observed", "observed_kind", "expected", "confidence")
OBSERVED, MESSAGE = 2000, 1000
_KINDS = {"double": "number", "float": "number", "integer": "integer", "long": "integer", "short": "integer", "boolean": "boolean"}
Case = tuple[Column, str, str, Column | str, Column | None] | tuple[Column, str, str, Column | str, Column | None, Column | str | None]


def message(code: str, observed: Column, expected: Column) -> Column:
    """What a finding says, from the wording of its code; {observed} and {expected} stand for the values."""
    parts = re.split(r"\{(observed|expected)\}", MESSAGES.get(code, "{observed}"))
    value = {"observed": F.coalesce(observed, F.lit("nothing")), "expected": F.coalesce(expected, F.lit("nothing"))}
    return truncate(F.concat(*[value[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)]), MESSAGE)


def _kinds(df: DataFrame, columns: Sequence[Column | None]) -> list[str | None]:
    """What the columns hold, told by one analysis of df."""
    some = [c.alias(f"c{i}") for i, c in enumerate(columns) if c is not None]
    types = iter(df.select(*some).schema if some else ())
    return [None if c is None else _KINDS.get(next(types).dataType.typeName(), "string") for c in columns]


def finding(kind: str | None, code: str, level: str, at: Column | str, observed: Column | None = None, expected: Column | str | None = None, confidence: float | None = None) -> Column:
    """One finding as a struct of COLUMNS; kind is what the observed column holds."""
    seen = F.lit(None).cast("string") if observed is None else truncate(observed.cast("string"), OBSERVED)
    want = F.lit(expected).cast("string") if not isinstance(expected, Column) else truncate(expected.cast("string"), OBSERVED)
    values = (F.lit(code), F.lit(level), F.lit(at) if isinstance(at, str) else at, message(code, seen, want), seen, F.when(seen.isNotNull(), F.lit(kind)), want, F.lit(confidence).cast("double"))
    return F.struct(*[v.alias(c) for c, v in zip(COLUMNS, values)])


def found(df: DataFrame, key: str, when: Column, code: str, level: str, at: Column | str, observed: Column | None = None, expected: Column | str | None = None) -> DataFrame:
    """The rows of df for which the condition holds, as findings (key, COLUMNS)."""
    (kind,) = _kinds(df, [observed])
    return df.where(when).select(key, finding(kind, code, level, at, observed, expected).alias("_f")).select(key, "_f.*")


def found_many(df: DataFrame, key: str, cases: Sequence[Case]) -> DataFrame:
    """Several conditions in one pass: each row yields a finding for every condition that holds.

    A case is (when, code, level, at, observed) and, where something else was wanted, expected."""
    kinds = _kinds(df, [case[4] for case in cases])
    items = [F.when(case[0], finding(kind, *case[1:])) for kind, case in zip(kinds, cases)]
    return df.select(key, F.inline(F.array_compact(F.array(*items))))


def with_fingerprint(findings: DataFrame) -> DataFrame:
    """findings with their fingerprint; without a column observed_kind what was observed is a text."""
    kind = F.col("observed_kind") if "observed_kind" in findings.columns else None
    return findings.withColumn("fingerprint", fingerprint(F.col("code"), F.col("json_pointer"), F.col("observed"), kind))


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODES, "code string, phase string, default_level string, gate boolean, unverifiable boolean")


def with_phase(findings: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Findings with phase, gate and unverifiable of their code; an unknown code has phase meta.

    codes is a table of codes, whose number is fixed; the own one where it is not given."""
    t = F.broadcast((taxonomy(findings.sparkSession) if codes is None else codes).select("code", "phase", "gate", "unverifiable"))
    out = findings.join(t, "code", "left")
    return out.withColumns({"phase": F.coalesce("phase", F.lit("meta")), "gate": F.coalesce("gate", F.lit(False)), "unverifiable": F.coalesce("unverifiable", F.lit(False))})

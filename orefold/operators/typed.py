"""Conformance of proposals that are already typed columns: value constraints as column predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefold.schemas import SCHEMA, Items, Number, Record, Text

CODE = "FMT.SCHEMA.TYPE_MISMATCH"


def _wrong(value: Column, rule: object) -> Column | None:
    """Whether a value that is there breaks its rule; None for rules without a constraint on typed values."""
    bad: Column | None = None

    def also(c: Column) -> None:
        nonlocal bad
        bad = c if bad is None else bad | c

    if isinstance(rule, Number):
        if rule.low is not None:
            also(value < rule.low)
        if rule.high is not None:
            also(value > rule.high)
    elif isinstance(rule, Text):
        if rule.least:
            also(F.length(value) < rule.least)
        if rule.most is not None:
            also(F.length(value) > rule.most)
        if rule.among is not None:
            also(~value.isin(*rule.among))
        if rule.pattern is not None:
            also(~value.rlike(rule.pattern))
    elif isinstance(rule, Items):
        if rule.least:
            also(F.size(value) < rule.least)
        if rule.most is not None:
            also(F.size(value) > rule.most)
    return bad


def _walk(value: Column, rule: object, pointer: Column, fields: set[str] | None) -> list[Column]:
    out = []
    if isinstance(rule, Record):
        for name, inner in rule.fields.items():
            if fields is None or name in fields:
                out += _walk(value[name], inner, F.concat(pointer, F.lit(f"/{name}")), None)
    else:
        bad = _wrong(value, rule)
        if bad is not None:
            out.append(F.array(F.when(value.isNotNull() & bad, pointer)))
    return out


def issues(df: DataFrame, key: str, columns: tuple[str, ...] = ("proposal_id", "composition", "claimed_properties", "synthesis_hint", "generator_confidence")) -> DataFrame:
    """(key, json_pointer, code): constraints of the closed schema that typed columns break. Nulls break none.

    Only fields the table has are checked; elements of arrays of records are checked in place."""
    lists = []
    have = {f.name: f.dataType for f in df.schema.fields}
    for c in columns:
        rule, kind = SCHEMA.fields[c], have[c]
        if isinstance(rule, Items):
            present = {f.name for f in kind.elementType.fields}
            for name, inner in rule.of.fields.items():
                if name in present and _wrong(F.lit(None), inner) is not None:
                    def each(x: Column, i: Column, name: str = name, inner: object = inner) -> Column:
                        return F.when(x[name].isNotNull() & _wrong(x[name], inner), F.concat(F.lit(f"/{c}/"), i.cast("string"), F.lit(f"/{name}")))

                    lists.append(F.transform(F.col(c), _two(each)))
            bad = _wrong(F.col(c), rule)
            if bad is not None:
                lists.append(F.array(F.when(F.col(c).isNotNull() & bad, F.lit(f"/{c}"))))
        elif isinstance(rule, Record):
            lists += _walk(F.col(c), rule, F.lit(f"/{c}"), {f.name for f in kind.fields})
        else:
            lists += _walk(F.col(c), rule, F.lit(f"/{c}"), None)
    none = F.array().cast("array<string>")
    found = F.array_compact(F.flatten(F.array(*[F.coalesce(x, none) for x in lists])))
    return df.select(key, F.explode(found).alias("json_pointer"), F.lit(CODE).alias("code"))


def _two(f):
    return lambda x, i: f(x, i)

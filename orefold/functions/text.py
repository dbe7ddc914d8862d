"""Text functions as columns: invisible characters, folds, slugs, truncation, hashes, timestamps."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?"
OFFSET = r"([Zz]|[+-]\d{2}:\d{2})$"


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Cf}", "")


def fold_separators(text: Column) -> Column:
    """Adduct dots become *, dashes -, digits of other scripts plain, blanks nothing; as formulas are folded."""
    from orefold.functions.formula import ADDUCTS, DASHES, SCRIPT_DIGITS

    folded = F.translate(text, ADDUCTS + DASHES + SCRIPT_DIGITS, "*" * len(ADDUCTS) + "-" * len(DASHES) + "0123456789" * 2)
    return F.regexp_replace(folded, r"[ \t\n\r\f\x0B]+", "")


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def slug(text: Column) -> Column:
    """Path-safe form: other characters become _, as does each run of two and more dots; outer dots go, then
    outer underscores; the first 64 characters count. Null, and what nothing is left of, is `record`."""
    s = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_"), r"\.{2,}", "_")
    s = F.regexp_replace(F.regexp_replace(s, r"^\.+|\.+$", ""), "^_+|_+$", "")
    return F.when(s.isNull() | (s == ""), F.lit("record")).otherwise(F.substring(s, 1, 64))


def first_bare_word(text: Column) -> Column:
    """The first word outside of brackets: the formula part of a precursor's name."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", " "), r"\[[^\]]*\]", " "))
    return F.split(bare, " ")[0]


def sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


@F.pandas_udf(T.StringType())
def _fingerprint(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for rows in batches:
        out = []
        for code, pointer_, seen, kind in zip(*rows):
            value = None if not isinstance(seen, str) else float(seen) if kind == "number" else seen == "true" if kind == "boolean" else seen
            value = int(value) if kind == "integer" else value
            out.append("sha256:" + digest(canonical({"code": code, "json_pointer": pointer_, "observed": value})))
        yield pd.Series(out)


def fingerprint(code: Column, pointer: Column, observed: Column, kind: Column | None = None) -> Column:
    """Identity of a finding wherever it occurs: code, pointer and observed value, not record or run.

    The digest of the canonical JSON of the three; kind says whether the text of observed is a string (also
    where it is not given), a number, an integer or a boolean."""
    return _fingerprint(code, pointer, observed, F.lit("string") if kind is None else kind)


def is_naive_timestamp(text: Column) -> Column:
    """Whether a timestamp lacks an offset; such a one is refused, never taken as UTC."""
    return text.rlike(RFC3339) & ~text.rlike(OFFSET)


def pointer(*parts: Column | str) -> Column:
    """JSON pointer of escaped steps."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat(*[F.concat(F.lit("/"), F.replace(F.replace(c.cast("string"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))) for c in cols])


def significant(value: float | None, digits: int = 6) -> float | None:
    """The value to so many significant digits, without a negative zero; not finite stays as it is."""
    if value is None or not math.isfinite(value) or value == 0:
        return 0.0 if value == 0 else value
    return float(f"{value:.{digits - 1}e}") + 0.0


def rounded(value: object, digits: int = 6) -> object:
    if isinstance(value, float):
        return significant(value, digits)
    if isinstance(value, dict):
        return {k: rounded(v, digits) for k, v in value.items()}
    return [rounded(v, digits) for v in value] if isinstance(value, (list, tuple)) else value


def canonical(value: object, *, ascii_only: bool = False) -> str:
    """Compact JSON with sorted keys; keys of candidates keep other scripts, artifacts escape them."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


@F.pandas_udf(T.DoubleType())
def significant_digits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda v: significant(v) if v == v else None)


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.str.normalize("NFKC")

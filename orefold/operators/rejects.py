"""Rows that fail to parse: valid lines are loaded, the others set apart with a reason.

The lines are tiled into fields by one pattern inside the JVM, once, and written. Each distinct value of a
checked column is cast once; the dictionary of values with its verdicts, one for all columns, is joined back
beside the structural checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefold.plans.skew import dictionary_join
from orefold.session import cut, scratch, stored

#: The header of the claim lines.
CLAIM_HEADER = ("proposal_id", "name", "value", "unit", "uncertainty", "basis", "temperature", "temperature_unit", "note")
#: A comma and the field behind it; possessive, so that long fields neither backtrack nor recurse.
FIELD = r',("[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
NUMBER = r"^ *[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)? *\z"


def csv_fields(line: Column) -> Column:
    """The fields of a line, quotes still on; tiles the line exactly if it is readable."""
    return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(FIELD), F.lit(1))


def is_readable(line: Column, fields: Column) -> Column:
    """Whether the fields cover the line without a gap, which fails for a stray or unclosed quote."""
    covered = F.aggregate(fields, F.lit(0), lambda n, f: n + 1 + F.length(f))
    return covered == F.length(line) + 1


def unquote(field: Column) -> Column:
    inner = F.replace(F.substr(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
    return F.when(F.startswith(field, F.lit('"')), inner).otherwise(field)


def is_number(text: Column) -> Column:
    """Decimal ASCII digits with optional sign, point and exponent, finite as a 64-bit float."""
    value = F.abs(F.trim(text).try_cast("double"))
    return F.coalesce(text.rlike(NUMBER) & (value < F.lit(float("inf"))), F.lit(False))


def reject_lines(
    lines: DataFrame,
    id_col: str,
    line_col: str,
    *,
    header: tuple[str, ...] = CLAIM_HEADER,
    required: tuple[str, ...] = ("value",),
    optional: tuple[str, ...] = ("temperature",),
    with_fields: bool = True,
) -> DataFrame:
    """(id, fields, reason): reason is null for a valid line, else the first that applies of quoting,
    column_count and the name of the first column, in header order, that is not a number; fields, left out
    unless with_fields, are null where the line is unreadable or has another number of them.

    required columns must hold a number; optional ones may be empty or blank. A null line is unreadable
    (quoting); an empty line has one field (column_count). Repeated lines each keep their row.
    """
    checked = [c for c in header if c in required or c in optional]
    f = F.col("_f")
    parsed = lines.select(F.col(id_col).alias("_id"), F.col(line_col).alias("_line")).withColumn("_f", csv_fields(F.col("_line")))
    why = F.when(F.col("_line").isNull() | ~is_readable(F.col("_line"), f), F.lit("quoting")).when(F.size(f) != len(header), F.lit("column_count"))
    parsed = parsed.withColumn("_why", why)
    ok = F.col("_why").isNull()
    values = [F.when(ok, unquote(F.get(f, F.lit(header.index(c))))).alias(f"_v{i}") for i, c in enumerate(checked)]
    with scratch(lines.sparkSession) as work:
        kept = [F.when(ok, F.transform(f, unquote)).alias("_f")] if with_fields else []
        parsed = stored(parsed.select("_id", "_why", *values, *kept), f"{work}/parsed")
        each = F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(f"_v{i}").alias("_v")) for i in range(len(checked))]))
        words = parsed.select(each).where(F.col("_v").isNotNull()).groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("n"))
        blank = F.col("_c").isin([i for i, c in enumerate(checked) if c in optional]) & (F.trim(F.regexp_replace("_v", r"\s", " ")) == "")
        words = stored(words.withColumn("_bad", ~(is_number(F.col("_v")) | blank)), f"{work}/words")
        total, out = parsed.count(), parsed
        for i in range(len(checked)):
            mine = words.where(F.col("_c") == i).select(F.col("_v").alias(f"_v{i}"), "n", F.col("_bad").alias(f"_bad{i}"))
            out = dictionary_join(out, mine, [f"_v{i}"], spread=F.col("_id"), total=total, keep=F.col(f"_bad{i}"))
        reason = F.coalesce(F.col("_why"), *[F.when(F.col(f"_bad{i}"), F.lit(c)) for i, c in enumerate(checked)])
        return cut(out.select(F.col("_id").alias(id_col), *[F.col("_f").alias("fields")] * with_fields, reason.alias("reason")))


def load_lines(rejected: DataFrame, id_col: str, *, header: tuple[str, ...] = CLAIM_HEADER, numbers: tuple[str, ...] = ("value", "temperature")) -> DataFrame:
    """The valid lines of reject_lines as typed columns; blank optional numbers become null."""
    cols = [F.get(F.col("fields"), F.lit(i)).alias(c) for i, c in enumerate(header)]
    out = rejected.where(F.col("reason").isNull()).select(id_col, *cols)
    return out.withColumns({c: F.trim(F.col(c)).try_cast("double") for c in numbers})

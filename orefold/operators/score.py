"""Gated weighted mean and status from findings and component values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOVELTY = {"no_evidence": 1.0, "computed_only": 0.6, "literature_mention": 0.4, "experimentally_reported": 0.0}
FEASIBILITY = {"plausible": 1.0, "marginal": 0.6, "implausible": 0.0}


def by_level(errors: Column, warnings: Column) -> Column:
    """Component value of a phase: 0 with an error, a half with a warning, else 1."""
    return F.when(errors > 0, 0.0).when(warnings > 0, 0.5).otherwise(1.0)


def mapped(value: Column, table: dict[str, float], unknown: float) -> Column:
    """Value of a label; unknown labels score the neutral value, a missing one stays missing."""
    out = F.when(value.isNull(), F.lit(None).cast("double"))
    for k, v in table.items():
        out = out.when(value == k, F.lit(v))
    return out.otherwise(F.lit(unknown))


def weighted(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over the components present, terms in fixed order; 1 if none is."""
    top: Column = F.lit(0.0)
    total: Column = F.lit(0.0)
    for name in weights:
        v = F.least(F.greatest(values[name], F.lit(0.0)), F.lit(1.0))
        top = top + F.when(values[name].isNotNull(), v * F.lit(weights[name])).otherwise(F.lit(0.0))
        total = total + F.when(values[name].isNotNull(), F.lit(weights[name])).otherwise(F.lit(0.0))
    return F.when(total > 0, top / total).otherwise(F.lit(1.0))


def status(gate_failed: Column, out_of_scope: Column, unavailable: Column, has_error: Column) -> Column:
    return F.when(gate_failed, "rejected").when(out_of_scope | unavailable, "unverifiable").when(has_error, "rejected").otherwise("accepted")


def findings_score(findings: DataFrame, key: str, *, weights: dict[str, float] | None = None) -> DataFrame:
    """(key, n_findings, n_errors, gate_failed, reward, status) of findings with phase, level, gate, unverifiable.

    Phases stand for components; a phase without findings is absent from the mean. Every phase counts
    once, whatever the number of its findings, which are summed before the shuffle."""
    weights = weights or {"composition": 0.25, "structure": 0.20, "novelty": 0.25, "feasibility": 0.15, "claims": 0.15}
    error, warning = F.col("level") == "error", F.col("level") == "warning"
    aggs = [F.count(F.lit(1)).alias("n_findings"), F.count_if(error).alias("n_errors"), F.max(F.col("gate") & error).alias("gate_failed"), F.max("unverifiable").alias("_away")]
    for p in weights:
        here = F.col("phase") == p
        aggs += [F.count_if(here).alias(f"_n{p}"), F.count_if(here & error).alias(f"_e{p}"), F.count_if(here & warning).alias(f"_w{p}")]
    g = findings.groupBy(key).agg(*aggs)
    values = {p: F.when(F.col(f"_n{p}") > 0, by_level(F.col(f"_e{p}"), F.col(f"_w{p}"))) for p in weights}
    gate = F.coalesce("gate_failed", F.lit(False))
    return g.select(
        key,
        "n_findings",
        "n_errors",
        gate.alias("gate_failed"),
        F.when(gate, 0.0).otherwise(weighted(values, weights)).alias("reward"),
        status(gate, F.lit(False), F.coalesce("_away", F.lit(False)), F.col("n_errors") > 0).alias("status"),
    )

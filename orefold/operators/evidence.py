"""Prior art with three-valued answers: hit, miss, unavailable; tiers and conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.functions import formula as fm
from orefold.operators.findings import found, found_many
from orefold.plans.skew import SMALL_ROWS
from orefold.reference.corpora import PROVIDERS, TIERS
from orefold.session import cut


def corpus_rows() -> list[tuple[str, str, str, str, int | None]]:
    """(provider, key, reduced formula, identifier, documents); the first spelling of a composition counts."""
    out = []
    for p in PROVIDERS:
        seen = set()
        for formula, identifier, documents in p.entries():
            counts = fm.parse(formula).counts
            k = fm.key(counts)
            if k not in seen:
                seen.add(k)
                out.append((p.name, k, fm.spell(counts), identifier, documents))
    return out


def corpora(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(corpus_rows(), "provider string, key string, reduced_formula string, identifier string, n_documents int")


def providers(spark: SparkSession, *, only: Sequence[str] | None = None, failed: Sequence[str] = ()) -> DataFrame:
    """The providers with their mode and class; available is false for those whose corpus could not be loaded.

    An unknown name in only is an error: dropping it would make an empty answer look like a complete one."""
    names = {p.name for p in PROVIDERS}
    if unknown := sorted({*(only or ()), *failed} - names):
        raise ValueError(f"unknown providers: {', '.join(unknown)}")
    rows = [(p.name, p.mode, p.evidence, p.name not in failed) for p in PROVIDERS if only is None or p.name in only]
    return spark.createDataFrame(rows, "provider string, mode string, evidence string, available boolean")


def answers(df: DataFrame, key: str, composition: str, sources: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, provider, mode, evidence, status, identifiers) of every provider for every row with a composition.

    sources is the fixed provider table, entries the corpora, broadcast only while they are small. A load failure is unavailable; entries
    that all record no document are a miss; other entries a hit; else replay is unavailable, snapshot a miss."""
    known = entries.groupBy("provider", F.col("key").alias("_k")).agg(F.min(F.coalesce(F.col("n_documents") == 0, F.lit(False))).alias("empty"), F.array_sort(F.collect_set("identifier")).alias("identifiers"))
    rows = df.where(F.col(composition).isNotNull()).select(key, F.col(composition).alias("_k"))
    each = sources.agg(F.collect_list(F.struct("provider", "mode", "evidence", "available")).alias("p"))
    asked = rows.join(F.broadcast(each)).select(key, "_k", F.inline("p"))
    known = cut(known)
    a = asked.join(F.broadcast(known) if known.count() <= SMALL_ROWS else known, ["provider", "_k"], "left")
    status = F.when(~F.col("available"), "unavailable").when(F.col("empty"), "miss").when(F.col("identifiers").isNotNull(), "hit").when(F.col("mode") == "replay", "unavailable").otherwise("miss")
    return a.select(key, "provider", "mode", "evidence", status.alias("status"), F.when(status == "hit", F.col("identifiers")).alias("identifiers"))


def tiers(answered: DataFrame, key: str) -> DataFrame:
    """(key, tier, confidence, supporters, n_unavailable): the strongest class with a hit decides; without one
    any unavailable provider makes the tier unknown, else there is no evidence."""
    hit = F.col("status") == "hit"
    aggs = [F.max(F.when(hit & (F.col("evidence") == e), 1).otherwise(0)).alias(f"_{e}") for e, _, _ in TIERS]
    aggs.append(F.count_if(F.col("status") == "unavailable").alias("n_unavailable"))
    aggs += [F.array_sort(F.collect_set(F.when(hit & (F.col("evidence") == e), F.col("provider")))).alias(f"_s{e}") for e, _, _ in TIERS]
    aggs.append(F.array_sort(F.collect_set("provider")).alias("_all"))
    t = answered.groupBy(key).agg(*aggs)
    tier: Column | None = None
    sure: Column | None = None
    who: Column | None = None
    less = F.when(F.col("n_unavailable") > 0, 0.1).otherwise(0.0)
    for e, name, confidence in TIERS:
        c = F.col(f"_{e}") == 1
        tier = F.when(c, name) if tier is None else tier.when(c, name)
        sure = F.when(c, F.lit(confidence) - less) if sure is None else sure.when(c, F.lit(confidence) - less)
        who = F.when(c, F.col(f"_s{e}")) if who is None else who.when(c, F.col(f"_s{e}"))
    away = F.col("n_unavailable") > 0
    return t.select(
        key,
        tier.when(away, "unknown").otherwise("no_evidence").alias("tier"),
        F.round(sure.when(away, 0.1).otherwise(0.45), 3).alias("confidence"),
        who.when(away, F.array().cast("array<string>")).otherwise(F.col("_all")).alias("supporters"),
        "n_unavailable",
    )


def conflicts(answered: DataFrame, key: str) -> DataFrame:
    """(key, evidence, providers): classes in which at least two providers answered and not all alike."""
    told = answered.where(F.col("status") != "unavailable")
    c = told.groupBy(key, "evidence").agg(F.countDistinct("status").alias("n"), F.array_join(F.array_sort(F.collect_set("provider")), ", ").alias("providers"))
    return c.where(F.col("n") > 1).drop("n")


def evidence_findings(df: DataFrame, key: str, answered: DataFrame, tiered: DataFrame) -> DataFrame:
    """Findings on prior art. df has the reduced formula as reduced."""
    at = "/composition/formula"
    t = tiered.join(df.select(key, "reduced"), key)
    tier, told, away = F.col("tier"), F.col("reduced"), F.col("status") == "unavailable"
    known = (("experimentally_reported", "NOVEL.DUPLICATE.EXACT_MATCH", "error"), ("computed_only", "NOVEL.DUPLICATE.COMPOSITION_MATCH", "warning"), ("literature_mention", "NOVEL.PRIOR_ART.LITERATURE_MENTION", "note"))
    out = found_many(t, key, [(tier == name, code, level, at, told) for name, code, level in known])
    out = out.unionByName(found(conflicts(answered, key), key, F.lit(True), "NOVEL.EVIDENCE.SOURCES_DISAGREE", "note", at, F.col("providers")))
    silent = [(away & (F.col("mode") == "replay"), "VERIFY.UNAVAILABLE.OFFLINE_CACHE_MISS", "none", at, F.col("provider")), (away & (F.col("mode") != "replay"), "VERIFY.UNAVAILABLE.PROVIDER_ERROR", "none", at, F.col("provider"))]
    return out.unionByName(found_many(answered, key, silent))

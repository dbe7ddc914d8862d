"""Queries of the verification operators over the data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.functions import geometry as g
from orefold.functions import text as tx
from orefold.operators import admission, audit, claims_audit, composition, crossrun, evidence, feasibility, score, structure, summarize, typed
from orefold.operators import findings as fd
from orefold.plans import verification
from orefold.queries.reference_sql import SQL as SQL
from orefold.reference.config import DEFAULTS
from orefold.session import tune
from orefold.sources import envelopes as env
from orefold.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
NO = "proposal_no"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _facts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    p = table(tune(spark), folder, "proposals", NO, "composition", *columns)
    return composition.with_facts(p.withColumn("formula", F.col("composition.formula")), NO, "formula")


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    return table(tune(spark), folder, "proposals", NO, "structure").where(F.col("structure").isNotNull())


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    return claims_audit.long_claims(table(tune(spark), folder, "proposals", NO, "claimed_properties"), NO, NO)


def _violations(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(tune(spark), folder, "violations", *columns)


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    codes = table(spark, folder, "taxonomy_codes", "code", "phase", "gate").withColumn("unverifiable", F.lit(False))
    v = _violations(spark, folder, "record_id", "code", "level", "unverifiable").where(F.col("record_id").isNotNull()).withColumnRenamed("unverifiable", "away")
    v = fd.with_phase(v, codes).drop("unverifiable").withColumnRenamed("away", "unverifiable")
    return score.findings_score(v, "record_id")


@query
def formula_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder).select(NO, F.explode("facts.counts").alias("element", "amount"))


@query
def composition_identity(spark: SparkSession, folder: str) -> DataFrame:
    f = F.col("facts")
    return _facts(spark, folder).where(f["key"].isNotNull()).select(NO, f["key"].alias("composition_key"), f["chemsys"].alias("chemsys"), f["divisor"].cast("bigint").alias("divisor"), F.size(f["elements"]).cast("bigint").alias("n_elements"))


@query
def scope_and_class(spark: SparkSession, folder: str) -> DataFrame:
    f = F.col("facts")
    return _facts(spark, folder).where(f["key"].isNotNull()).select(NO, f["out_of_scope"].isNull().alias("in_scope"), f["metallic"].alias("metallic"))


@query
def charge_balance(spark: SparkSession, folder: str) -> DataFrame:
    f = F.col("facts")
    states = F.array_join(F.transform(f["elements"], lambda e: F.concat(e, F.lit(":"), f["states"][e].cast("string"))), ",")
    return _facts(spark, folder).where(f["key"].isNotNull()).select(NO, f["charge"].alias("outcome"), F.when(f["charge"] == "balanced", states).alias("states"))


@query
def electronegativity_order(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder).where(F.col("facts.misplaced").isNotNull()).select(NO, F.col("facts.misplaced").alias("element"))


@query
def element_map_disagreement(spark: SparkSession, folder: str) -> DataFrame:
    d = _facts(spark, folder).select(NO, composition.map_disagreement(F.col("facts.counts"), F.col("composition.elements")).alias("differing"))
    return d.where(F.col("differing").isNotNull())


@query
def lattice_measures(spark: SparkSession, folder: str) -> DataFrame:
    c = structure.density(structure.cells(_cells(spark, folder)))
    return c.where("evaluated").select(NO, F.round("volume", 4).alias("volume"), F.round("density", 4).alias("density"))


@query
def lattice_bounds(spark: SparkSession, folder: str) -> DataFrame:
    c = structure.cells(_cells(spark, folder)).where("evaluated")
    (lo, hi), (alo, ahi) = DEFAULTS["validity"]["lattice"], DEFAULTS["validity"]["angles"]
    cases = [(~F.col(x).between(*((lo, hi) if len(x) == 1 else (alo, ahi))), "STRUCT.GEOM.IMPLAUSIBLE_LATTICE", "error", f"/structure/lattice/{x}", None) for x in ("a", "b", "c", "alpha", "beta", "gamma")]
    return fd.found_many(c, NO, cases).select(NO, "json_pointer")


@query
def symmetry_agreement(spark: SparkSession, folder: str) -> DataFrame:
    c = structure.cells(_cells(spark, folder)).where(F.col("volume").isNotNull())
    c = c.select(NO, g.family_of_group(F.col("structure.space_group.number")).alias("asserted"), g.family_of_metric(*[F.col(x) for x in ("a", "b", "c", "alpha", "beta", "gamma")]).alias("metric"))
    return c.withColumn("agree", g.families_agree(F.col("asserted"), F.col("metric")))


@query
def min_image_distance(spark: SparkSession, folder: str) -> DataFrame:
    m = structure.measured(_cells(spark, folder))
    return m.where(F.col("nearest.distance").isNotNull()).select(NO, F.round("nearest.distance", 4).alias("distance"))


@query
def site_totals(spark: SparkSession, folder: str) -> DataFrame:
    c = structure.site_totals(structure.cells(_cells(spark, folder)))
    return c.select(NO, F.explode("totals").alias("element", "total")).withColumn("total", F.round("total", 6))


@query
def occupancy_ratio(spark: SparkSession, folder: str) -> DataFrame:
    f = _facts(spark, folder, "structure")
    c = structure.site_totals(structure.cells(f.where(F.col("structure").isNotNull())))
    return c.select(NO, structure.disproportion(F.col("totals"), F.col("facts.counts")).alias("differing")).where(F.col("differing").isNotNull())


@query
def unit_normalization_log(spark: SparkSession, folder: str) -> DataFrame:
    a = claims_audit.assess(_claims(spark, folder), NO)
    return claims_audit.normalizations(a, NO).withColumn("pos", F.col("pos").cast("bigint"))


@query
def batch_unit_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    return claims_audit.first_units(_claims(spark, folder), NO).select("name", "first_token")


@query
def claim_assessment(spark: SparkSession, folder: str) -> DataFrame:
    a = claims_audit.assess(_claims(spark, folder), NO)
    return a.select(NO, F.col("pos").cast("bigint").alias("pos"), "assessment", F.round("normalized", 4).alias("normalized"))


@query
def claim_findings(spark: SparkSession, folder: str) -> DataFrame:
    a = claims_audit.assess(_claims(spark, folder), NO)
    return claims_audit.claim_findings(a, NO).select(NO, "code", "level", "json_pointer")


@query
def sentinel_values(spark: SparkSession, folder: str) -> DataFrame:
    a = claims_audit.assess(_claims(spark, folder), NO)
    return a.where(F.col("assessment") == "sentinel").select(NO, F.col("pos").cast("bigint").alias("pos"), "value")


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = _facts(spark, folder).withColumn("k", F.col("facts.key"))
    return evidence.answers(rows, NO, "k", evidence.providers(spark), evidence.corpora(spark))


@query
def provider_status_tristate(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark, folder).select(NO, "provider", "status")


@query
def novelty_tier(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.tiers(_answers(spark, folder), NO).select(NO, "tier", "confidence", F.col("n_unavailable").alias("n_unavailable"))


@query
def same_class_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.conflicts(_answers(spark, folder), NO)


@query
def hint_kelvin(spark: SparkSession, folder: str) -> DataFrame:
    h = F.col("synthesis_hint")
    p = table(tune(spark), folder, "proposals", NO, "synthesis_hint").where(h["temperature"].isNotNull())
    return p.select(NO, F.round(feasibility.kelvin(h["temperature"], h["temperature_unit"]), 4).alias("kelvin"))


@query
def oxygen_potential(spark: SparkSession, folder: str) -> DataFrame:
    h = F.col("synthesis_hint")
    p = table(tune(spark), folder, "proposals", NO, "synthesis_hint").where((h["temperature"] > 0) & h["atmosphere"].isNotNull())
    return p.select(NO, F.round(feasibility.oxygen_potential(h["atmosphere"], h["temperature"]), 6).alias("potential"))


@query
def atmosphere_survival(spark: SparkSession, folder: str) -> DataFrame:
    s = feasibility.screen(_facts(spark, folder, "synthesis_hint").withColumn("hint", F.col("synthesis_hint")), NO, DEFAULTS["feasibility"])
    return s.select(NO, F.inline("forces")).withColumn("force", F.round("force", 6))


@query
def hull_binary_energy(spark: SparkSession, folder: str) -> DataFrame:
    f = F.col("facts")
    return _facts(spark, folder).where((F.size(f["elements"]) == 2) & f["hull"].isNotNull()).select(NO, F.round(f["hull"], 6).alias("hull"))


@query
def feasibility_verdict(spark: SparkSession, folder: str) -> DataFrame:
    s = feasibility.screen(_facts(spark, folder, "synthesis_hint").withColumn("hint", F.col("synthesis_hint")), NO, DEFAULTS["feasibility"])
    return s.where(F.col("feasibility").isNotNull()).select(NO, "feasibility", "frame", F.round("facts.hull", 6).alias("hull"), F.round("facts.above", 6).alias("above_hull"))


@query
def route_rank_topk(spark: SparkSession, folder: str) -> DataFrame:
    return feasibility.ranked_routes(_facts(spark, folder).where(F.col("facts.key").isNotNull()), NO)


@query
def hint_findings(spark: SparkSession, folder: str) -> DataFrame:
    rows = _facts(spark, folder, "synthesis_hint").withColumn("hint", F.col("synthesis_hint"))
    s = feasibility.screen(rows, NO, DEFAULTS["feasibility"])
    return feasibility.route_findings(s, NO, DEFAULTS["routes"]).where(F.col("code") == "FEAS.SYNTH.HINT_INCOHERENT").select(NO, "json_pointer")


@query
def precursor_names(spark: SparkSession, folder: str) -> DataFrame:
    p = table(tune(spark), folder, "proposals", NO, "synthesis_hint")
    e = p.select(NO, F.posexplode("synthesis_hint.precursors").alias("pos", "raw"))
    return e.select(NO, F.col("pos").cast("bigint").alias("pos"), tx.first_bare_word(F.col("raw")).alias("name"))


@query
def gated_reward(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).withColumn("reward", F.round("reward", 6))


@query
def eligible_projection(spark: SparkSession, folder: str) -> DataFrame:
    return summarize.scalar_rewards(_scored(spark, folder)).select("record_id", F.round("reward", 6).alias("reward"), "status")


@query
def reward_summary_upper_median(spark: SparkSession, folder: str) -> DataFrame:
    s = summarize.upper_median(_scored(spark, folder).withColumn("reward", F.round("reward", 6)), "reward")
    return s.select("n", F.round("mean", 6).alias("mean"), "min", "max", "p50")


@query
def code_field_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    return summarize.code_by_field(_violations(spark, folder, "code", "json_pointer"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    p = table(tune(spark), folder, "proposals", "proposal_id", "claimed_properties", "generator_confidence")
    c = p.select("proposal_id", F.posexplode("claimed_properties").alias("i", "c"), F.col("generator_confidence").isNull().alias("unavailable")).where(F.col("c.confidence").isNotNull())
    c = c.select("proposal_id", F.concat(F.lit("/claimed_properties/"), F.col("i").cast("string")).alias("json_pointer"), F.col("c.confidence").alias("confidence"), "unavailable")
    return summarize.calibration_outcomes(c, _violations(spark, folder, "proposal_id", "level", "json_pointer"), "proposal_id")


@query
def calibration_prefix_join(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).groupBy("json_pointer", "outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query
def calibration_brier(spark: SparkSession, folder: str) -> DataFrame:
    c = summarize.calibration(_pairs(spark, folder))
    return c.select("n_pairs", *[F.round(x, 6).alias(x) for x in ("brier", "mean_confidence_when_correct", "mean_confidence_when_incorrect")])


@query
def recommendations_ranked(spark: SparkSession, folder: str) -> DataFrame:
    t = table(tune(spark), folder, "taxonomy_codes", "code", "phase", "default_level")
    rules = t.groupBy(F.col("phase").alias("advice_id"), F.col("default_level").alias("target")).agg(F.collect_set("code").alias("codes"))
    v = _violations(spark, folder, "proposal_id", "code")
    r = summarize.recommendations(v, "proposal_id", rules, v.select(F.count_distinct("proposal_id")).first()[0])
    return r.select(F.col("rank").cast("bigint").alias("rank"), "advice_id", "target", "n_records", F.round("fraction", 6).alias("fraction"))


@query
def recommendation_evidence(spark: SparkSession, folder: str) -> DataFrame:
    t = table(tune(spark), folder, "taxonomy_codes", "code", "phase", "default_level")
    rules = t.groupBy(F.col("phase").alias("advice_id"), F.col("default_level").alias("target")).agg(F.collect_set("code").alias("codes"))
    v = _violations(spark, folder, "record_id", "proposal_id", "code", "json_pointer")
    r = summarize.recommendations(v, "record_id", rules, 1, pointer="json_pointer", example="proposal_id")
    return r.select("advice_id", "target", "n_records", *[F.array_join(c, ",").alias(c) for c in ("codes", "json_pointers", "example_ids")])


@query
def tier_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.tiers(_answers(spark, folder), NO).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query
def tier_supporters(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.tiers(_answers(spark, folder), NO).select(NO, F.array_join("supporters", ",").alias("supporters"))


@query
def corpus_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.corpora(spark).groupBy("provider").agg(F.count(F.lit(1)).alias("n_entries"))


@query
def decomposition_products(spark: SparkSession, folder: str) -> DataFrame:
    s = feasibility.screen(_facts(spark, folder, "synthesis_hint").withColumn("hint", F.col("synthesis_hint")), NO, DEFAULTS["feasibility"])
    return s.select(NO, F.inline("decomposition")).withColumn("products", F.array_join("products", ","))


@query
def symmetry_rank(spark: SparkSession, folder: str) -> DataFrame:
    a = symmetry_agreement(spark, folder).where(F.col("asserted").isNotNull())
    return a.select(NO, g.rank(F.col("metric")).cast("bigint").alias("metric_rank"), g.more_symmetric(F.col("metric"), F.col("asserted")).alias("more_symmetric"))


@query
def schema_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Unknown and missing fields at the top of every proposal that stands in a list."""
    b = table(tune(spark), folder, "batch_files", "batch_no", "payload")
    each = b.select("batch_no", F.posexplode(F.from_json("payload", "proposals array<string>")["proposals"]).alias("pos", "doc")).where(F.col("doc").isNotNull() & F.json_object_keys("doc").isNotNull())
    found = each.select("batch_no", F.col("pos").cast("bigint").alias("pos"), F.explode(env.conformance("doc")).alias("i")).select("batch_no", "pos", "i.*")
    return found.where(F.col("code").isin("FMT.SCHEMA.UNKNOWN_FIELD", "FMT.SCHEMA.REQUIRED_FIELD_MISSING") & (F.length("json_pointer") - F.length(F.replace("json_pointer", F.lit("/"), F.lit(""))) == 1))


@query
def top_code_fields(spark: SparkSession, folder: str) -> DataFrame:
    c = summarize.code_by_field(_violations(spark, folder, "code", "json_pointer")).where(F.col("code").isNotNull() & F.col("json_pointer").isNotNull())
    return summarize.top_k(c, "n", ["code", "json_pointer"], 20)


@query
def pooled_rates(spark: SparkSession, folder: str) -> DataFrame:
    v = _violations(spark, folder, "code", "json_pointer", "run_id", "record_id")
    return crossrun.pooled(v, "run_id", v.select(F.count_distinct("record_id")).first()[0])


@query
def cross_run_trend(spark: SparkSession, folder: str) -> DataFrame:
    v = _violations(spark, folder, "code", "batch_seq", "record_id", "recorded_at")
    runs = crossrun.runs_of(v, "batch_seq", "record_id", "batch_seq")
    return crossrun.trend(v, runs, "batch_seq")


@query
def code_rates_by_batch(spark: SparkSession, folder: str) -> DataFrame:
    v = _violations(spark, folder, "code", "batch_seq", "record_id")
    return crossrun.rates(v, crossrun.runs_of(v, "batch_seq", "record_id", "batch_seq"), "batch_seq")


@query
def component_means(spark: SparkSession, folder: str) -> DataFrame:
    p = table(tune(spark), folder, "proposals", NO, "generator_confidence", "composition", "synthesis_hint")
    v = p.select(F.col("generator_confidence.overall").alias("overall"), F.col("composition.charge").alias("charge"), F.col("synthesis_hint.duration_hours").alias("duration_hours"))
    return summarize.component_means(v, ["overall", "charge", "duration_hours"]).withColumn("mean", F.round("mean", 6))


@query
def finding_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    return crossrun.lifecycle(_violations(spark, folder, "fingerprint", "batch_seq"), "batch_seq")


@query
def comparability_flags(spark: SparkSession, folder: str) -> DataFrame:
    aspects = ["taxonomy_version", "reward_fn_id", "corpus_fingerprint", "config_sha256", "source_sha256"]
    r = table(tune(spark), folder, "run_files", "payload")
    return crossrun.comparability(r.select(*[F.get_json_object("payload", f"$.{a}").alias(a) for a in aspects]), aspects)


@query
def run_table(spark: SparkSession, folder: str) -> DataFrame:
    return crossrun.runs_of(_violations(spark, folder, "run_id", "record_id", "recorded_at"), "run_id", "record_id", "recorded_at").drop("logical_time")


@query
def runs_per_code(spark: SparkSession, folder: str) -> DataFrame:
    n = _violations(spark, folder, "code", "run_id").where(F.col("code").isNotNull()).groupBy("code", "run_id").agg(F.count(F.lit(1)).alias("n"))
    return crossrun.ranked(n, "code", [F.desc("n"), F.asc_nulls_last("run_id")], 3).withColumn("rank", F.col("rank").cast("bigint"))


def _text_keys(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    d = table(tune(spark), folder, "documents", "doc_id", "text", "created_at").withColumn("content_key", tx.sha256(F.col("text")))
    old = F.col("created_at") < F.lit("2026-06-01").cast("timestamp_ntz")
    return d.where(~old), d.where(old)


@query
def incremental_misses(spark: SparkSession, folder: str) -> DataFrame:
    new, old = _text_keys(spark, folder)
    return crossrun.misses(new, old, "content_key").select("doc_id", "content_key")


@query
def incremental_hits(spark: SparkSession, folder: str) -> DataFrame:
    new, old = _text_keys(spark, folder)
    cache = old.groupBy("content_key").agg(F.min("doc_id").alias("cached_from"))
    return crossrun.hits(new.select("doc_id", "content_key"), cache, "content_key").select("doc_id", "cached_from")


def _sendings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    p = table(tune(spark), folder, "proposals", NO, "proposal_id", "composition", "received_at").where(F.col("proposal_id").isNotNull())
    d = F.sha2(F.col("composition.formula"), 256)
    first = p.groupBy("proposal_id").agg(F.min_by(d, F.struct("received_at", NO)).alias("digest"))
    last = p.groupBy("proposal_id").agg(F.max_by(d, F.struct("received_at", NO)).alias("digest"))
    return first, last


@query
def lineage_states(spark: SparkSession, folder: str) -> DataFrame:
    recorded, _ = _sendings(spark, folder)
    v = _violations(spark, folder, "proposal_id", "observed").where(F.col("proposal_id").isNotNull())
    _, current = _sendings(spark, folder)
    seen = v.select("proposal_id").distinct()
    return crossrun.lineage(recorded, current.join(seen, "proposal_id", "left_semi"), "proposal_id", "digest").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query
def config_diff(spark: SparkSession, folder: str) -> DataFrame:
    recorded = table(tune(spark), folder, "taxonomy_codes", "code", "default_level").select(F.col("code").alias("path"), F.col("default_level").alias("value"))
    v = _violations(spark, folder, "code", "level").where(F.col("code").isNotNull()).groupBy(F.col("code").alias("path")).agg(F.max("level").alias("value"))
    return crossrun.differences(recorded, v)


@query
def admission_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    p = table(tune(spark), folder, "proposals", NO, "proposal_id", "received_at", "claimed_properties")
    return admission.admit(p, "proposal_id", ["received_at", NO], F.col("claimed_properties").isNotNull()).select(NO, "decision")


@query
def admission_count_identity(spark: SparkSession, folder: str) -> DataFrame:
    p = table(tune(spark), folder, "proposals", NO, "proposal_id", "received_at", "claimed_properties")
    return admission.counts(admission.admit(p, "proposal_id", ["received_at", NO], F.col("claimed_properties").isNotNull()))


def _issues(spark: SparkSession, folder: str) -> DataFrame:
    return typed.issues(table(tune(spark), folder, "proposals", NO, "proposal_id", "composition", "claimed_properties", "synthesis_hint", "generator_confidence"), NO)


@query
def conformance_findings(spark: SparkSession, folder: str) -> DataFrame:
    return _issues(spark, folder)


@query
def quarantine_first_code(spark: SparkSession, folder: str) -> DataFrame:
    return admission.quarantine_codes(_issues(spark, folder), NO)


@query
def rule_ledger_with_zeros(spark: SparkSession, folder: str) -> DataFrame:
    rules = table(tune(spark), folder, "taxonomy_codes", "code", "phase").select(F.col("code").alias("rule_id"), F.col("phase").alias("action"), "code")
    hits = _violations(spark, folder, "code", "record_id", "finding_id").select(F.col("code").alias("rule_id"), F.col("record_id").alias("example"), F.col("finding_id").alias("seq"))
    return admission.ledger(hits, rules).select("rule_id", "n_hits", F.array_join("examples", ",").alias("examples"))


@query
def strip_format_chars(spark: SparkSession, folder: str) -> DataFrame:
    d = table(tune(spark), folder, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    s = tx.strip_invisible(F.col("text"))
    return d.select("doc_id", (F.length("text") - F.length(s)).cast("bigint").alias("removed"), tx.sha256(s).alias("digest"))


@query
def fold_separators(spark: SparkSession, folder: str) -> DataFrame:
    d = table(tune(spark), folder, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    return d.select("doc_id", tx.sha256(tx.fold_separators(F.col("text"))).alias("digest"))


@query
def non_ascii_reject(spark: SparkSession, folder: str) -> DataFrame:
    d = table(tune(spark), folder, "documents", "doc_id", "text")
    return d.where(~tx.is_ascii(F.col("text"))).select("doc_id")


@query
def safe_slug(spark: SparkSession, folder: str) -> DataFrame:
    d = table(tune(spark), folder, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    return d.select("doc_id", tx.slug(F.col("text")).alias("slug"))


@query
def candidate_key_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(tune(spark), folder, "batch_files", "batch_no", "payload").select("batch_no", tx.sha256(F.col("payload")).alias("candidate_key"))


@query
def finding_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    v = _violations(spark, folder, "finding_id", "code", "json_pointer", "observed")
    return v.select("finding_id", tx.fingerprint(F.col("code"), F.col("json_pointer"), F.col("observed")).alias("own_fingerprint"))


@query
def naive_timestamp_flag(spark: SparkSession, folder: str) -> DataFrame:
    r = table(tune(spark), folder, "run_files", "row_no", "payload")
    t = F.get_json_object("payload", "$.logical_time")
    return r.select("row_no", tx.is_naive_timestamp(t).alias("naive")).where(F.col("naive").isNotNull())


@query
def truncated_messages(spark: SparkSession, folder: str) -> DataFrame:
    return _violations(spark, folder, "finding_id", "message").select("finding_id", tx.truncate(F.col("message"), 60).alias("message"))


@query
def round_significant(spark: SparkSession, folder: str) -> DataFrame:
    c = _claims(spark, folder).where(F.col("value").isNotNull())
    return c.select(NO, F.col("pos").cast("bigint").alias("pos"), tx.significant_digits("value").alias("value"))


@query
def orphan_codes(spark: SparkSession, folder: str) -> DataFrame:
    v = _violations(spark, folder, "finding_id", "code")
    return audit.orphans(v, table(spark, folder, "taxonomy_codes", "code"), "code", "code").select("finding_id", "code")


@query
def missing_rows(spark: SparkSession, folder: str) -> DataFrame:
    p = table(tune(spark), folder, "proposals", NO, "proposal_id")
    return audit.orphans(p, _violations(spark, folder, "proposal_id"), "proposal_id", "proposal_id").select(NO, "proposal_id")


@query
def length_rederivation_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    d = table(tune(spark), folder, "documents", "doc_id", "text", "n_chars")
    return audit.mismatched(d, F.col("n_chars"), F.length("text")).select("doc_id", "n_chars", F.length("text").cast("bigint").alias("derived"))


@query
def ordering_violations(spark: SparkSession, folder: str) -> DataFrame:
    v = _violations(spark, folder, "finding_id", "recorded_at").where(F.col("recorded_at").isNotNull())
    return audit.unordered(v, "finding_id", ["recorded_at"]).select("finding_id")


@query
def required_phases_missing(spark: SparkSession, folder: str) -> DataFrame:
    t = table(tune(spark), folder, "taxonomy_codes", "phase", "gate").where("gate")
    return audit.missing(t, "phase", ["parse", "schema", "composition", "structure", "novelty", "feasibility", "claims", "route", "meta"])


@query
def address_findings(spark: SparkSession, folder: str) -> DataFrame:
    return audit.with_url(table(tune(spark), folder, "batch_files", "batch_no", "batch_id", "payload"), "batch_no", ["batch_id", "payload"])


@query
def proposal_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("composition", "structure", "claimed_properties", "synthesis_hint", "generator_confidence")
    p = table(tune(spark), folder, "proposals", NO, "proposal_id", *columns)
    docs = p.select(F.lpad(F.col(NO).cast("string"), 12, "0").alias("key"), "proposal_id", F.concat(F.lit("proposal "), F.col(NO).cast("string")).alias("candidate_key"), *columns)
    v = verification.check(docs, DEFAULTS).verdicts
    return v.select(F.col("key").cast("bigint").alias(NO), "status", F.round("reward", 6).alias("reward"), "tier", "feasibility", "n_findings")

"""The verification plan: admitted proposals to findings, scores, verdicts, repairs and batch summaries."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold import __version__
from orefold.functions.text import slug
from orefold.operators import admission, claims_audit, composition, crossrun, evidence, feasibility, findings as fd, repair, score, structure, summarize
from orefold.reference.config import digest, resolve
from orefold.reference.taxonomy import TAXONOMY_VERSION
from orefold.schemas import PROPOSAL
from orefold.session import cut, exists
from orefold.sources import envelopes as env

KEY = "key"
SCREENED = ("CHEM.CHARGE.NOT_NEUTRAL", "CHEM.ELECTRONEG.IMBALANCED", "CHEM.FORMULA.INCONSISTENT_WITH_ELEMENTS")


@dataclass
class Checked:
    verdicts: DataFrame
    findings: DataFrame
    screened: DataFrame
    claims: DataFrame
    answers: DataFrame
    units: DataFrame | None = None


def parsed(docs: DataFrame) -> DataFrame:
    """(key, doc, columns of the proposal) from (key, doc); docs that have the columns already stay as they are."""
    if "composition" in docs.columns:
        return docs
    out = docs.withColumn("p", F.from_json("doc", PROPOSAL))
    return out.select(*docs.columns, *[F.col(f"p.{c}").alias(c) for c in ("composition", "structure", "claimed_properties", "synthesis_hint", "generator_confidence")])


def check(docs: DataFrame, config: dict, *, units: DataFrame | None = None, sources: DataFrame | None = None, entries: DataFrame | None = None) -> Checked:
    """All checks of (key, doc, proposal_id, ...) rows that conform; one finding per row, one verdict per key.

    The parsed rows with the facts of their formula are written once into the shared folder, since every
    check starts from them. Claims are judged against units, or against the first units of these rows."""
    spark = docs.sparkSession
    base = parsed(docs).withColumns({"formula": F.col("composition.formula"), "elements": F.col("composition.elements"), "hint": F.col("synthesis_hint")})
    base = cut(composition.with_facts(base, KEY, "formula"))
    v = config["validity"]
    m = structure.measured(base.where(F.col("structure").isNotNull()), metric_length=v["metric_length"], metric_angle=v["metric_angle"])
    m = cut(m.select(KEY, "evaluated", "a", "b", "c", "alpha", "beta", "gamma", "volume", "density", "totals", "nearest", "metric", "asserted", F.col("facts.counts").alias("counts")))
    sources = evidence.providers(spark, only=config["evidence"]["only"]) if sources is None else sources
    entries = evidence.corpora(spark) if entries is None else entries
    answered = cut(evidence.answers(base.withColumn("composition_key", F.col("facts.key")), KEY, "composition_key", sources, entries))
    tiered = evidence.tiers(answered, KEY)
    if sources.isEmpty():
        tiered = base.where(F.col("facts.key").isNotNull()).select(KEY, F.lit("unknown").alias("tier"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("supporters"), F.lit(1).alias("n_unavailable"))
    s = feasibility.screen(base, KEY, config["feasibility"])
    claims = claims_audit.assess(claims_audit.long_claims(base, KEY, KEY), KEY, units=units)
    parts = [
        composition.composition_findings(base, KEY, neutrality_level=v["neutrality_level"]),
        structure.structure_findings(m, KEY, v, F.col("counts")),
        evidence.evidence_findings(base.select(KEY, F.col("facts.reduced").alias("reduced")), KEY, answered, tiered),
        feasibility.feasibility_findings(s, KEY, config["feasibility"]),
        feasibility.route_findings(s, KEY, config["routes"]),
        claims_audit.claim_findings(claims, KEY),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = cut(fd.with_fingerprint(fd.with_phase(found)))
    return Checked(_verdicts(base, m, s, tiered, answered, claims, found, config["reward"]), found, s, claims, answered)


def _verdicts(base: DataFrame, m: DataFrame, s: DataFrame, tiered: DataFrame, answered: DataFrame, claims: DataFrame, found: DataFrame, reward: dict) -> DataFrame:
    level, code = F.col("level"), F.col("code")
    counted = found.groupBy(KEY).agg(
        F.count_if(level == "error").alias("n_errors"), F.count_if(level == "warning").alias("n_warnings"), F.count(F.lit(1)).alias("n_findings"),
        F.count_if((level == "error") & code.isin(*SCREENED)).alias("ce"), F.count_if((level == "warning") & code.isin(*SCREENED)).alias("cw"),
        F.count_if((level == "error") & (F.col("phase") == "structure")).alias("se"), F.count_if((level == "warning") & (F.col("phase") == "structure")).alias("sw"),
    )
    split = evidence.conflicts(answered, KEY).groupBy(KEY).agg(F.array_sort(F.collect_list(F.concat_ws(": ", "evidence", "providers"))).alias("conflicts"))
    audited = claims.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(claims_audit.is_bad(F.col("assessment"))).alias("n_bad"))
    out = base.select(KEY, "proposal_id", "candidate_key", F.col("facts.key").alias("composition_key"), F.col("facts.reduced").alias("reduced"), F.col("facts.out_of_scope").alias("out_of_scope"), F.col("facts.charge").alias("charge"), F.size("facts.routes").alias("n_routes"))
    out = out.join(s.select(KEY, "feasibility", "frame"), KEY, "left").join(tiered, KEY, "left").join(m.select(KEY, "evaluated"), KEY, "left").join(counted, KEY, "left").join(audited, KEY, "left").join(split, KEY, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ok = F.col("composition_key").isNotNull()
    values = {
        "composition_valid": F.when(ok, score.by_level(zero("ce"), zero("cw"))),
        "structure_valid": F.when(F.col("evaluated"), score.by_level(zero("se"), zero("sw"))),
        "novelty": F.when(ok, score.mapped(F.col("tier"), score.NOVELTY, reward["unknown"])),
        "feasibility": F.when(ok, score.mapped(F.col("feasibility"), score.FEASIBILITY, reward["unknown"])),
        "claims_supported": F.when(F.col("n_claims") > 0, (F.col("n_claims") - F.col("n_bad")) / F.col("n_claims")),
    }
    points = F.when(ok, score.weighted(values, reward["weights"])).otherwise(0.0)
    state = score.status(~ok, F.col("out_of_scope").isNotNull(), zero("n_unavailable") > 0, zero("n_errors") > 0)
    return out.select(
        KEY, "proposal_id", "candidate_key", "composition_key", "reduced", "out_of_scope", "tier", F.col("confidence").alias("tier_confidence"), "supporters", "conflicts", "feasibility", "frame", "charge", "n_routes",
        zero("n_claims").alias("n_claims"), zero("n_bad").alias("n_bad"), zero("se").alias("structure_errors"), zero("sw").alias("structure_warnings"),
        *[x.alias(f"value_{n}") for n, x in values.items()], points.alias("reward"), state.alias("status"), zero("n_findings").alias("n_findings"), zero("n_errors").alias("n_errors"), (zero("n_unavailable") > 0).alias("unavailable"),
    )


def checks(verdicts: DataFrame) -> DataFrame:
    """(key, check_id, phase, outcome, detail) of every check of every record, a record's rows in order of phase
    and id. An outcome is pass, warn, fail, not_applicable or unavailable: what could not be asked never passes."""
    v, away, ok = F.col, F.lit("not_applicable"), F.col("composition_key").isNotNull()
    inside = ok & v("out_of_scope").isNull()
    by_count = lambda errors, warnings: F.when(errors > 0, "fail").when(warnings > 0, "warn").otherwise("pass")
    rows = (
        ("claims.audit", "claims", F.when(v("n_claims") == 0, away).otherwise(by_count(v("n_bad"), F.lit(0))), F.concat(v("n_bad").cast("string"), F.lit(" of "), v("n_claims").cast("string"), F.lit(" claims do not hold"))),
        ("composition.charge_neutrality", "composition", F.when(v("charge") == "balanced", "pass").when(v("charge") == "unbalanced", "warn").otherwise(away), v("charge")),
        ("composition.formula_normalize", "composition", F.when(ok, "pass").otherwise("fail"), v("composition_key")),
        ("feasibility.screen", "feasibility", F.when(~ok, away).when(v("feasibility") == "plausible", "pass").when(v("feasibility") == "marginal", "warn").when(v("feasibility") == "implausible", "fail").otherwise("unavailable"), v("frame")),
        ("novelty.prior_art", "novelty", F.when(~ok, away).when(v("unavailable"), "unavailable").otherwise("pass"), v("tier")),
        ("parse.envelope", "parse", F.lit("pass"), F.lit("the file was read within its bounds")),
        ("route.enumeration", "route", F.when(~inside, away).when(v("n_routes") > 0, "pass").otherwise("warn"), F.concat(F.coalesce(v("n_routes"), F.lit(0)).cast("string"), F.lit(" routes"))),
        ("schema.record_conformance", "schema", F.lit("pass"), F.lit("the record keeps the closed schema")),
        ("structure.coherence", "structure", F.when(v("value_structure_valid").isNull(), away).otherwise(by_count(v("structure_errors"), v("structure_warnings"))), F.concat(v("structure_errors").cast("string"), F.lit(" errors, "), v("structure_warnings").cast("string"), F.lit(" warnings"))),
    )
    made = [F.struct(F.lit(i).alias("check_id"), F.lit(p).alias("phase"), o.alias("outcome"), d.alias("detail")) for i, p, o, d in rows]
    return verdicts.select(KEY, F.inline(F.array(*made)))


def reverified(checked: Checked, docs: DataFrame, config: dict, units: DataFrame, options: Options | None = None) -> DataFrame:
    """Repairs of the checked rows with the status and reward their patched proposals get, and whether they
    improve; the patched rows pass the same checks once, repairs are not proposed for repairs."""
    offered = cut(repair.proposals(docs, checked.findings, KEY))
    again = offered.select(F.concat_ws("~", KEY, "repair_id").alias(KEY), F.col("patched").alias("doc"), F.get_json_object("patched", "$.proposal_id").alias("proposal_id"), F.concat(F.lit("sha256:"), F.sha2("patched", 256)).alias("candidate_key"))
    options = options or Options()
    after = check(again, config, units=units, sources=options.sources, entries=options.entries).verdicts.select(KEY, F.col("status").alias("status_after"), F.col("reward").alias("reward_after"))
    before = checked.verdicts.select(KEY, F.col("status").alias("status_before"), F.col("reward").alias("reward_before"))
    joined = offered.withColumn("_again", F.concat_ws("~", KEY, "repair_id")).join(after.withColumnRenamed(KEY, "_again"), "_again", "left").drop("_again")
    return joined.join(before, KEY).withColumn("improves", F.coalesce(F.col("reward_after") > F.col("reward_before"), F.lit(False)))


def preference_pairs(repaired: DataFrame) -> DataFrame:
    """Rejected records with a repair that scores higher."""
    return repaired.where(F.col("improves") & (F.col("status_before") == "rejected")).select(KEY, "repair_id", F.col("reward_before").alias("rejected_reward"), F.col("reward_after").alias("chosen_reward"), "targets")


@dataclass
class Options:
    """Where a run takes its corpora from, keeps its verdicts, and when it begins no further part."""

    cache: str | None = None
    seconds: float | None = None
    sources: DataFrame | None = None
    entries: DataFrame | None = None
    chunks: int = 16
    clock: Callable[[], float] = time.monotonic


def check_batches(batches: DataFrame, config: dict, options: Options | None = None, seen: DataFrame | None = None) -> tuple[Checked | None, DataFrame, DataFrame]:
    """(checked, admitted, all proposals with their decision) of parsed envelopes; checked is None if none is
    admitted. Rejected envelopes take no part. Records left out by a time budget have the decision unprocessed; those
    whose proposal_id stands in seen are duplicates."""
    options = options or Options()
    rows = admission.admit(env.proposals_of(batches), "proposal_id", ["path", "pos"], F.size("issues") == 0)
    if seen is not None:
        told = seen.select("proposal_id").distinct().withColumn("_seen", F.lit(True))
        rows = rows.join(told, "proposal_id", "left").withColumn("decision", F.when(F.col("_seen") & (F.col("decision") == "admitted"), "duplicate").otherwise(F.col("decision"))).drop("_seen")
    rows = cut(rows)
    docs = rows.where(F.col("decision") == "admitted").drop("decision", "issues")
    if docs.isEmpty():
        return None, docs, rows
    units = cut(claims_audit.first_units(claims_audit.long_claims(parsed(docs), KEY, KEY), KEY))

    def judge(part: DataFrame, units: DataFrame) -> Checked:
        if options.cache is not None:
            return cached(part, config, options.cache, units=units, sources=options.sources, entries=options.entries)[0]
        return check(part, config, units=units, sources=options.sources, entries=options.entries)

    if options.seconds is None:
        checked = judge(docs, units)
    else:
        checked, left = check_within(docs, config, options.seconds, chunks=options.chunks, clock=options.clock, judge=judge)
        left = cut(left.select(KEY, F.lit(True).alias("_left")))
        rows = cut(rows.join(left, KEY, "left").withColumn("decision", F.when(F.col("_left"), "unprocessed").otherwise(F.col("decision"))).drop("_left"))
        docs = rows.where(F.col("decision") == "admitted").drop("decision", "issues")
        if checked is None:
            return None, docs, rows
    checked.units = units
    return checked, docs, rows


def content_keys(docs: DataFrame, config: dict, units: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """docs with content_key: digest of everything a verdict depends on but the run it is part of.

    That is the candidate, the thresholds, the versions of engine, taxonomy and reference tables, corpora from
    files among them, and the batch's first units, which decide findings too."""
    from orefold.plans.report import corpus_fingerprint

    own = ""
    if entries is not None:
        each = F.xxhash64(*[F.col(c) for c in sorted(entries.columns)])
        own = str(entries.agg(F.count(F.lit(1)), F.bit_xor(each), F.sum(F.pmod(each, F.lit(1 << 40)))).first())

    used = units.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", "first_token"))), ",").alias("u")).first()["u"]
    base = _hash("|".join([__version__, digest(config), TAXONOMY_VERSION, corpus_fingerprint(), used or "", own]))
    return docs.withColumn("content_key", F.sha2(F.concat_ws("|", F.lit(base), F.col("candidate_key")), 256))


#: The tables of Checked that a store keeps, one row or several per content key.
STORED = ("verdicts", "findings", "screened", "claims", "answers")


def cached(docs: DataFrame, config: dict, folder: str, *, units: DataFrame | None = None, sources: DataFrame | None = None, entries: DataFrame | None = None) -> tuple[Checked, int]:
    """(checked, number computed) of docs, taking from folder what was judged before.

    The store holds the tables of each content key, partitioned by the key's first two digits, and only the
    partitions of the keys asked for are read. New content is found by an anti-join, checked once whatever the
    number of its records, and appended under a mark of its own; a mark is entered in the list of complete
    ones last, so rows of a write that broke off are never read. Keys, ids and run of records are stamped on
    when the stored rows are joined back."""
    spark = docs.sparkSession
    units = cut(claims_audit.first_units(claims_audit.long_claims(parsed(docs), KEY, KEY), KEY)) if units is None else units
    wanted = cut(content_keys(docs, config, units, entries).withColumn("shard", F.substring("content_key", 1, 2)))
    shards = [r["shard"] for r in wanted.select("shard").distinct().collect()]  # 256 at most
    marks = _marks(spark, folder)
    here = lambda name: spark.read.parquet(f"{folder}/{name}").where(F.col("shard").isin(shards) & F.col("mark").isin(marks))
    todo = crossrun.misses(wanted, here("verdicts").select("content_key"), "content_key") if marks else wanted
    fresh = cut(todo.groupBy("content_key").agg(F.min("doc").alias("doc"), F.min("proposal_id").alias("proposal_id"), F.min("candidate_key").alias("candidate_key")))
    n = fresh.count()
    if n:
        mark = uuid.uuid4().hex
        done = check(fresh.withColumnRenamed("content_key", KEY), config, units=units, sources=sources, entries=entries)
        for name in STORED:
            df = getattr(done, name).drop("proposal_id", "candidate_key", "doc").withColumnRenamed(KEY, "content_key")
            df.withColumns({"mark": F.lit(mark), "shard": F.substring("content_key", 1, 2)}).write.mode("append").partitionBy("shard").parquet(f"{folder}/{name}")
        spark.createDataFrame([(mark,)], "mark string").coalesce(1).write.mode("append").parquet(f"{folder}/complete")
        marks = [*marks, mark]
    stamp = wanted.select(KEY, "content_key", "proposal_id", "candidate_key", "shard")

    def back(name: str, *own: str) -> DataFrame:
        return here(name).drop("mark").join(stamp.select(KEY, "content_key", "shard", *own), ["shard", "content_key"]).drop("shard", "content_key")

    return Checked(*[back(t, *(["proposal_id", "candidate_key"] if t == "verdicts" else [])) for t in STORED], units), n


def _marks(spark: SparkSession, folder: str) -> list[str]:
    """The complete writes of a store, one for each run that found something new; none where there is no store."""
    if not exists(spark, f"{folder}/complete"):
        return []
    return sorted(r["mark"] for r in spark.read.parquet(f"{folder}/complete").collect())


def cached_check(docs: DataFrame, config: dict, folder: str, *, units: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(verdicts, findings, number computed): cached() for those who need no more."""
    done, n = cached(docs, config, folder, units=units)
    return done.verdicts, done.findings, n


def check_within(docs: DataFrame, config: dict, seconds: float, *, chunks: int = 16, clock=time.monotonic, judge: Callable[[DataFrame, DataFrame], Checked] | None = None) -> tuple[Checked | None, DataFrame]:
    """(checked, left out) with a budget of seconds: records are checked in chunks by the hash of their key, and
    no chunk is begun after the budget. What was not begun is returned for quarantine as VERIFY.BUDGET.EXHAUSTED.

    Units are taken from all records, so a cut-off run judges each record as a full one would; judge(part, units)
    stands in for check()."""
    begun = clock()
    docs = docs.withColumn("_chunk", F.pmod(F.xxhash64(KEY), F.lit(chunks)))
    units = cut(claims_audit.first_units(claims_audit.long_claims(parsed(docs), KEY, KEY), KEY))
    done: Checked | None = None
    for i in range(chunks):
        if clock() - begun >= seconds:
            left = docs.where(F.col("_chunk") >= i).select(KEY, "proposal_id", F.lit("VERIFY.BUDGET.EXHAUSTED").alias("violation_code"))
            return done, left
        part = docs.where(F.col("_chunk") == i).drop("_chunk")
        if part.isEmpty():
            continue
        c = check(part, config, units=units) if judge is None else judge(part, units)
        c.verdicts = cut(c.verdicts)
        done = c if done is None else Checked(*[getattr(done, f).unionByName(getattr(c, f)) for f in ("verdicts", "findings", "screened", "claims", "answers")], units)
    return done, docs.limit(0).select(KEY, "proposal_id", F.lit("VERIFY.BUDGET.EXHAUSTED").alias("violation_code"))


@dataclass
class Run:
    run_id: str
    exit_code: int
    batches: DataFrame
    admitted: DataFrame | None = None
    quarantined: DataFrame | None = None
    checked: Checked | None = None
    repaired: DataFrame | None = None
    ledger: DataFrame | None = None
    counts: dict | None = None


def run(spark: SparkSession, path: str, *, config: dict | None = None, seed: int = 0, logical_time: str = "1970-01-01T00:00:00Z", repairs: bool = True, options: Options | None = None) -> Run:
    """One run over a file or folder of batches. The first rejected file ends it with exit code 3; 4 says that
    records were quarantined or a provider could not answer; 0 that nothing is missing. options name a store of
    verdicts, a time budget and corpora from files."""
    config = resolve() if config is None else config
    batches = cut(env.envelopes(spark, path, config["input"]))
    shas = batches.agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("digest", F.lit("-")))), "|").alias("d")).first()["d"]
    run_id = "run-" + _hash("|".join([digest(config), str(seed), logical_time, shas or ""]))[:24]
    if not batches.where(F.col("code").isNotNull()).isEmpty():
        return Run(run_id, 3, batches)
    checked, docs, rows = check_batches(batches, config, options)
    why = F.when(F.col("decision") == "duplicate", "FMT.ID.DUPLICATE_PROPOSAL_ID").when(F.col("decision") == "unprocessed", "VERIFY.BUDGET.EXHAUSTED")
    aside = rows.where(F.col("decision") != "admitted").select("key", "proposal_id", why.otherwise(F.col("issues")[0]["code"]).alias("violation_code"))
    if checked is None:
        c = admission.counts(rows).first().asDict()
        return Run(run_id, 4, batches, docs, aside, counts=c)
    checked.verdicts = cut(checked.verdicts.withColumn("run_id", F.lit(run_id)).withColumn("record_id", F.concat(F.lit(run_id + ":"), slug(F.col("proposal_id")))))
    hits = _hits(batches, rows, checked)
    c = admission.counts(rows).first().asDict()
    c |= {r["status"]: r["n"] for r in checked.verdicts.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    away = not checked.answers.where(F.col("status") == "unavailable").isEmpty()
    repaired = reverified(checked, docs, config, checked.units, options) if repairs else None
    return Run(run_id, 4 if away or c["quarantined"] else 0, batches, docs, aside, checked, repaired, admission.ledger(hits, admission.rules(spark)), c)


def _hits(batches: DataFrame, rows: DataFrame, checked: Checked) -> DataFrame:
    """(rule_id, example, seq) of everything the ledger counts, taken from the rows themselves."""
    one = lambda df, rule, example, seq: df.select(F.lit(rule).alias("rule_id"), example.alias("example"), seq.alias("seq"))
    out = one(batches.select("path", F.explode("naive").alias("p")), "input.timezone_naive_timestamps", F.col("p"), F.col("path"))
    out = out.unionByName(one(rows.where(F.col("decision") == "nonconforming"), "record.schema_conformance", F.col("proposal_id"), F.col("key")))
    out = out.unionByName(one(rows.where(F.col("decision") == "duplicate"), "record.duplicate_proposal_id", F.col("proposal_id"), F.col("key")))
    out = out.unionByName(one(claims_audit.normalizations(checked.claims, KEY), "claims.unit_normalization", F.col(KEY), F.col(KEY)))
    return out.unionByName(one(checked.claims.where(F.col("assessment") == "sentinel"), "claims.sentinel_values", F.col(KEY), F.col(KEY)))


def _hash(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def summary(r: Run) -> dict[str, DataFrame]:
    """The batch summaries of a run, each a table."""
    c = r.checked
    n = r.counts["admitted"]
    pairs = c.screened.where(F.col("generator_confidence.per_field").isNotNull()).select(KEY, F.explode("generator_confidence.per_field").alias("json_pointer", "confidence"))
    pairs = pairs.join(c.verdicts.select(KEY, "unavailable"), KEY)
    outcomes = summarize.calibration_outcomes(pairs, c.findings, KEY)
    return {
        "code_by_field": summarize.code_by_field(c.findings),
        "reward": summarize.upper_median(c.verdicts, "reward"),
        "component_means": summarize.component_means(c.verdicts, [x for x in c.verdicts.columns if x.startswith("value_")]),
        "ledger_totals": c.screened.agg(F.count_if(F.size("facts.steps") > 0).alias("records_modified")).join(c.answers.agg(F.count_if(F.col("status") == "unavailable").alias("unavailable_queries"))),
        "tiers": c.verdicts.where(F.col("tier").isNotNull()).groupBy("tier").agg(F.count(F.lit(1)).alias("n")),
        "calibration_pairs": outcomes,
        "calibration": summarize.calibration(outcomes),
        "recommendations": summarize.recommendations(c.findings.join(c.verdicts.select(KEY, "proposal_id"), KEY), KEY, summarize.advice(c.findings.sparkSession), n, pointer="json_pointer", example="proposal_id"),
        "checks": checks(c.verdicts),
        "scalar_reward": summarize.scalar_rewards(c.verdicts),
        "routes": feasibility.ranked_routes(c.screened.where(F.col("facts.key").isNotNull()), KEY),
    }

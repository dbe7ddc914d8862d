"""DataFrame operators on small inputs with nulls, ties, empty tables and clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orefold.operators import admission, audit, claims_audit, composition, crossrun, evidence, feasibility, findings as fd, score, structure, summarize, typed
from orefold.plans.skew import dictionary_join
from orefold.reference.config import DEFAULTS, digest, merge, redact, resolve
from orefold.reference.corpora import PROVIDERS


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_dictionary_join_equals_a_left_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}" if i % 7 else None) for i in range(3000)], "id bigint, k string")
    words = left.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.upper("k"))
    got = rows(dictionary_join(left, words, ["k"], spread=F.col("id"), total=3000))
    assert got == rows(left.join(words.drop("n"), "k", "left").select("id", "k", "v"))
    kept = dictionary_join(left, words, ["k"], spread=F.col("id"), total=10**9, keep=F.col("k") == "k3")
    assert {r.v for r in kept.collect()} == {None, "K3"}
    assert dictionary_join(left.limit(0), words, ["k"], spread=F.col("id"), total=1).count() == 0


def test_admission_lets_the_first_conforming_win(spark):
    df = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "a", True), (4, "a", False), (5, None, True), (6, None, True), (7, "b", None)], "n int, id string, ok boolean").withColumn("_x", F.lit(1))
    got = {r.n: r.decision for r in admission.admit(df, "id", ["n"], F.col("ok")).collect()}
    assert got == {1: "nonconforming", 2: "admitted", 3: "duplicate", 4: "duplicate", 5: "admitted", 6: "admitted", 7: "nonconforming"}
    c = admission.counts(admission.admit(df, "id", ["n"], F.col("ok"))).first()
    assert c.records_in == c.admitted + c.quarantined == 7 and c.duplicates == 2


def test_ledger_keeps_rules_without_hits(spark):
    hits = spark.createDataFrame([("r1", f"e{9 - i % 9}", i) for i in range(40)] + [("r1", None, 99)], "rule_id string, example string, seq int")
    rules = spark.createDataFrame([("r1", "flag", "A"), ("r2", "flag", "B")], "rule_id string, action string, code string")
    got = {r.rule_id: (r.n_hits, r.examples) for r in admission.ledger(hits, rules).collect()}
    assert got == {"r1": (41, ["e5", "e6", "e7", "e8", "e9"]), "r2": (0, [])}
    assert admission.rules(spark).count() == 14


def test_first_issue(spark):
    i = spark.createDataFrame([(1, "/b", "X"), (1, "/a", "Z"), (1, "/a", "Y")], "k int, json_pointer string, code string")
    assert rows(admission.quarantine_codes(i, "k")) == [(1, "Y", 3)]


def test_facts_and_findings(spark):
    df = spark.createDataFrame([(1, "Fe4O6", {"Fe": 4.0, "O": 6.0}), (2, "TiO2", {"Ti": 1.0, "O": 3.0}), (3, "ТiO2", None), (4, None, {}), (5, "C8H8", None), (6, "Fe17O23", {"Fe": 17.0}), (7, "Fe​2O3", None)], "k int, formula string, elements map<string,double>")
    f = composition.with_facts(df, "k", "formula")
    got = {(r.k, r.code) for r in composition.composition_findings(f, "k").collect()}
    assert got == {
        (1, "CHEM.FORMULA.NOT_REDUCED"), (2, "CHEM.FORMULA.INCONSISTENT_WITH_ELEMENTS"), (3, "FMT.ENCODING.NON_ASCII_SYMBOL"), (4, "CHEM.FORMULA.UNPARSEABLE"), (5, "CHEM.FORMULA.NOT_REDUCED"),
        (5, "CHEM.SCOPE.NOT_INORGANIC_CRYSTALLINE"), (5, "CHEM.CHARGE.NOT_NEUTRAL"), (6, "CHEM.CHARGE.NOT_NEUTRAL"), (6, "CHEM.FORMULA.INCONSISTENT_WITH_ELEMENTS"), (7, "FMT.ENCODING.INVISIBLE_CHARACTER"),
    } | {x for x in got if x[0] == 5 and x[1] == "CHEM.ELECTRONEG.IMBALANCED"}
    assert composition.with_facts(df.limit(0), "k", "formula").count() == 0


STRUCT = "k int, structure struct<lattice:struct<a:double,b:double,c:double,alpha:double,beta:double,gamma:double,length_unit:string,angle_unit:string>,sites:array<struct<element:string,frac_coords:array<double>,occupancy:double>>,space_group:struct<number:int>>, counts map<string,double>"


def test_structure(spark):
    cell = (4.594, 4.594, 2.959, 90.0, 90.0, 90.0, None, None)
    rutile = [("Ti", [0.0, 0.0, 0.0], None), ("Ti", [0.5, 0.5, 0.5], 1.0)] + [("O", [x, y, z], 1.0) for x, y, z in ((0.305, 0.305, 0.0), (0.695, 0.695, 0.0), (0.195, 0.805, 0.5), (0.805, 0.195, 0.5))]
    tio2 = {"Ti": 1.0, "O": 2.0}
    data = [
        (1, (cell, rutile, (136,)), tio2),
        (2, (cell, rutile[:5], (225,)), tio2),
        (3, ((0.4594, 0.4594, 0.2959, 90.0, 90.0, 90.0, "nm", "degree"), [("Zn", [0.0, 0.0, 0.0], 1.0), ("Zn", [0.0, 0.0, 0.999], 1.0)], None), None),
        (4, ((4.0, 4.0, 4.0, 150.0, 150.0, 150.0, None, None), None, None), None),
        (5, ((4.0, 4.0, 4.0, 90.0, 90.0, 90.0, "parsec", None), None, None), None),
        (6, None, None),
        (7, ((1000.0, 4.0, 4.0, 1.5707963, 1.5707963, 1.5707963, None, "radian"), [], None), None),
    ]
    m = structure.measured(spark.createDataFrame(data, STRUCT))
    r = {x.k: x for x in m.collect()}
    assert r[1].density == pytest.approx(4.23, abs=0.05) and r[1].metric == "tetragonal" == r[1].asserted and r[1].totals == {"O": 4.0, "Ti": 2.0}
    assert r[4].volume is None and not r[5].evaluated and not r[6].evaluated
    got = {(x.k, x.code.split(".")[2], x.json_pointer) for x in structure.structure_findings(m, "k", DEFAULTS["validity"], F.col("counts")).collect()}
    assert {g for g in got if g[0] == 1} == set() and (2, "OCCUPANCY_INCONSISTENT", "/structure/sites") in got and (2, "SPACEGROUP_INCONSISTENT", "/structure/space_group/number") in got
    assert (3, "ATOM_OVERLAP", "/structure/sites/1/frac_coords") in got and (4, "IMPLAUSIBLE_LATTICE", "/structure/lattice") in got and (7, "IMPLAUSIBLE_LATTICE", "/structure/lattice/a") in got


def test_claims(spark):
    cs = [("band_gap", 2.0, "eV"), ("band_gap", 2000.0, "meV"), ("band_gap", -1.0, "eV"), ("band_gap", -0.5, "eV"), ("band_gap", 30.0, "eV"), ("band_gap", 1e31, "eV"), ("band_gap", 1.0, "furlong"), ("colour", 1.0, "nm"), ("band_gap", None, "eV"), ("melting_point", 32.0, "F"), ("melting_point", 9999.0, "K"), ("band_gap", 1.0, "e V"), ("band_gap", float("nan"), "eV"), (None, 1.0, None)]
    df = spark.createDataFrame([(1, cs), (2, None), (3, [])], "k int, claimed_properties array<struct<name:string,value:double,unit:string>>")
    long = claims_audit.long_claims(df, "k", "k")
    a = claims_audit.assess(long, "k")
    got = {r.pos: r.assessment for r in a.collect()}
    assert got == {0: "unsupported", 1: "unsupported", 2: "sentinel", 3: "impossible", 4: "implausible", 5: "overflow", 6: "unit_error", 7: "unknown_property", 8: "not_a_number", 9: "unsupported", 10: "sentinel", 11: "unsupported", 12: "overflow", 13: "unknown_property"}
    assert {r.name: r.first_token for r in claims_audit.first_units(long, "k").collect()} == {"band_gap": "ev", "colour": "nm", "melting_point": "f"}
    f = {(r.json_pointer, r.code, r.level) for r in claims_audit.claim_findings(a, "k").collect()}
    assert ("/claimed_properties/1/unit", "CLAIM.UNITS.INCONSISTENT", "warning") in f and ("/claimed_properties/11/unit", "CLAIM.UNITS.INCONSISTENT", "error") in f
    assert {r.pos for r in claims_audit.normalizations(a, "k").collect()} == {1, 9}


def test_evidence_is_three_valued(spark):
    df = spark.createDataFrame([(1, "O:2|Ti:1"), (2, "Fe:17|O:23"), (3, "Xe:1"), (4, "C:1|H:1"), (5, "Al:2|O:5|Si:1"), (6, None)], "k int, c string")
    entries = evidence.corpora(spark)
    a = evidence.answers(df, "k", "c", evidence.providers(spark), entries)
    t = {r.k: (r.tier, r.confidence, r.n_unavailable) for r in evidence.tiers(a, "k").collect()}
    assert t == {1: ("experimentally_reported", 0.9, 0), 2: ("no_evidence", 0.45, 0), 3: ("unknown", 0.1, 1), 4: ("literature_mention", 0.7, 0), 5: ("experimentally_reported", 0.8, 1)}
    assert {r.k for r in evidence.conflicts(a, "k").collect()} == {5}
    broken = evidence.answers(df, "k", "c", evidence.providers(spark, failed=["experimental_snapshot"]), entries)
    assert {r.status for r in broken.where("provider = 'experimental_snapshot'").collect()} == {"unavailable"}
    with pytest.raises(ValueError, match="nobody"):
        evidence.providers(spark, only=["nobody"])
    assert len(evidence.corpus_rows()) == sum(len(p.entries()) for p in PROVIDERS)


def test_score(spark):
    f = spark.createDataFrame([("a", "composition", "error", False, False), ("a", "claims", "note", False, False), ("b", "schema", "error", True, False), ("c", "novelty", "warning", False, True), ("d", "meta", "note", False, False)], "k string, phase string, level string, gate boolean, unverifiable boolean")
    got = {r.k: (round(r.reward, 6), r.status) for r in score.findings_score(f, "k").collect()}
    assert got == {"a": (round(0.15 / 0.40, 6), "rejected"), "b": (0.0, "rejected"), "c": (0.5, "unverifiable"), "d": (1.0, "accepted")}


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0, 2.0, 2.0], [1.0, None, 5.0, 4.0], [], [None], [7.0] * 30, [i % 997 / 7 for i in range(30_000)]])
def test_upper_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    got = summarize.upper_median(df, "v").first()
    real = sorted(v for v in values if v is not None)
    assert got.n == len(real) and got.p50 == (real[len(real) // 2] if real else None)
    if real:
        assert got.mean == pytest.approx(sum(real) / len(real)) and (got.min, got.max) == (real[0], real[-1])


def test_calibration_counts_findings_below_a_field(spark):
    c = spark.createDataFrame([("r", "/a", 0.9, False), ("r", "/a/b", 0.8, False), ("r", "/ab", 0.7, True), ("r", "/c", 0.6, True), ("s", "/a", 0.5, False)], "k string, json_pointer string, confidence double, unavailable boolean")
    f = spark.createDataFrame([("r", "error", "/a/b/0"), ("r", "warning", "/c/x"), ("r", "note", "/ab"), ("q", "error", "/a"), ("r", "error", None), (None, "error", "/a")], "k string, level string, json_pointer string")
    o = summarize.calibration_outcomes(c, f, "k")
    assert {(r.k, r.json_pointer): r.outcome for r in o.collect()} == {("r", "/a"): "incorrect", ("r", "/a/b"): "incorrect", ("r", "/ab"): "unverifiable", ("r", "/c"): "correct", ("s", "/a"): "correct"}
    s = summarize.calibration(o).first()
    assert s.n_pairs == 5 and s.brier == pytest.approx((0.81 + 0.64 + 0.16 + 0.25) / 4) and s.mean_confidence_when_incorrect == pytest.approx(0.85)


def test_histograms_and_recommendations(spark):
    f = spark.createDataFrame([("A", "/x", 1), ("A", "/x", 1), ("B", "/y", 2), ("B", None, None)], "code string, json_pointer string, k int")
    h = {(r.code, r.json_pointer): r.n for r in summarize.code_by_field(f).collect()}
    assert h[("A", None)] == 2 and h[(None, "/x")] == 2 and h[("A", "/x")] == 2 and h[("B", "(null)")] == 1
    rules = spark.createDataFrame([("r1", "prompt", ["A", "B"]), ("r2", "data", ["C"]), ("r3", "data", ["A"])], "advice_id string, target string, codes array<string>")
    got = [(r["rank"], r.advice_id, r.n_records, r.fraction) for r in summarize.recommendations(f, "k", rules, 4).orderBy("rank").collect()]
    assert got == [(1, "r1", 2, 0.5), (2, "r3", 1, 0.25)]
    assert summarize.observed_fields(f, rules).where("advice_id = 'r3'").first().pointers == ["/x"]
    assert summarize.advice(spark).count() == 13


def test_across_runs(spark):
    f = spark.createDataFrame([("A", "/x", 1, "f1"), ("A", "/x", 2, "f1"), ("B", "/x", 2, "f2"), ("A", "/x", 1, "f3"), ("A", "/x", 1, None)], "code string, json_pointer string, run int, fingerprint string")
    assert {r.fingerprint: r.state for r in crossrun.lifecycle(f, "run").collect()} == {"f1": "persistent", "f2": "new", "f3": "resolved"}
    runs = spark.createDataFrame([(1, 10, 10), (2, 20, 0)], "run int, logical_time int, n_records int")
    got = {r.code: (r.first_per_100, r.last_per_100, r.change) for r in crossrun.trend(f, runs, "run").collect()}
    assert got == {"A": (30.0, None, None), "B": (0.0, None, None)}
    assert {(r.total_findings, r.runs_present_in, r.per_100) for r in crossrun.pooled(f, "run", 50).collect()} == {(4, 2, 8.0), (1, 1, 2.0)}
    only = f.where("run = 1")
    assert {r.state for r in crossrun.lifecycle(only, "run").collect()} == {"new"} and crossrun.lifecycle(f.limit(0), "run").count() == 0


def test_lineage_and_differences(spark):
    a = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", None)], "path string, value string")
    b = spark.createDataFrame([("p", "1"), ("q", "3"), ("s", "4")], "path string, value string")
    assert {(r.path, r.change) for r in crossrun.differences(a, b).collect()} == {("q", "changed"), ("s", "added"), ("r", "removed")}
    assert {(r.path, r.state) for r in crossrun.lineage(a, b, "path", "value").collect()} == {("p", "MATCH"), ("q", "DIVERGED"), ("r", "UNKNOWN"), ("s", "UNKNOWN")}


def test_incremental_recompute(spark, tmp_path):
    calls = []

    def compute(df):
        calls.append(df.count())
        return df.withColumn("v", F.upper("k"))

    first = spark.createDataFrame([("a",), ("b",)], "k string")
    assert rows(crossrun.recompute(first, str(tmp_path / "c"), "k", compute)) == [("a", "A"), ("b", "B")]
    more = spark.createDataFrame([("b",), ("c",)], "k string")
    assert rows(crossrun.recompute(more, str(tmp_path / "c"), "k", compute)) == [("b", "B"), ("c", "C")] and calls == [2, 1]


def test_unordered_sees_across_empty_blocks(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (100, 4), (101, 5), (900, 1), (1700, 2)], "n bigint, v int").repartition(4)
    assert [r.n for r in audit.unordered(df, "n", ["v"], block=3).orderBy("n").collect()] == [100, 900]
    wide = df.selectExpr("n * 100000 AS n", "v")
    assert [r.n for r in audit.unordered(wide, "n", ["v"]).orderBy("n").collect()] == [10_000_000, 90_000_000]


def test_audit(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 2, 5, 4, 6, 3, 9, 10, 8])], "n bigint, v int").repartition(4)
    assert [r.n for r in audit.unordered(df, "n", ["v"]).orderBy("n").collect()] == [4, 6, 9]
    assert [r.n for r in audit.unordered(df, "n", ["v"], block=3).orderBy("n").collect()] == [4, 6, 9]
    child = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "n int, k string")
    assert [r.n for r in audit.orphans(child, spark.createDataFrame([("a",), (None,)], "p string"), "k", "p").orderBy("n").collect()] == [2, 3]
    assert [r.k for r in audit.missing(child, "k", ["a", "b"]).collect()] == ["b"]
    m = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (None, None), (None, 1.0)], "s double, d double")
    assert audit.mismatched(m, F.col("s"), F.col("d")).count() == 2
    t = spark.createDataFrame([(1, "see https://x", "/home/u"), (2, "a/home/b", None)], "n int, a string, b string")
    assert rows(audit.with_url(t, "n", ["a", "b"])) == [(1, "a"), (1, "b")]


def test_feasibility_columns(spark):
    df = spark.createDataFrame([(1, "Fe2O3", 1000.0, "C", "H2"), (2, "TiO2", None, None, None), (3, "NaCl", 500.0, "K", "H2"), (4, "Fe17O23", None, None, "air")], "k int, formula string, t double, u string, g string")
    df = df.withColumn("hint", F.struct(F.col("t").alias("temperature"), F.col("u").alias("temperature_unit"), F.col("g").alias("atmosphere"), F.array(F.lit("TiO2 (x)"), F.lit("??")).alias("precursors")))
    s = feasibility.screen(composition.with_facts(df, "k", "formula"), "k", DEFAULTS["feasibility"])
    got = {r.k: (r.feasibility, r.frame, r.unstable) for r in s.collect()}
    assert got == {1: ("marginal", "grand_potential", ["H2"]), 2: ("plausible", "grand_potential", []), 3: ("plausible", "closed_0k", []), 4: ("implausible", "closed_0k", [])}
    codes = {(r.k, r.code, r.json_pointer) for r in feasibility.feasibility_findings(s, "k", DEFAULTS["feasibility"]).unionByName(feasibility.route_findings(s, "k", DEFAULTS["routes"])).collect()}
    assert (1, "FEAS.ATMOSPHERE.UNSTABLE", "/synthesis_hint/atmosphere") in codes and (1, "FEAS.SYNTH.HINT_INCOHERENT", "/synthesis_hint/atmosphere") in codes
    assert (3, "FEAS.FRAME.INAPPROPRIATE", "/synthesis_hint/atmosphere") in codes and (2, "FEAS.SYNTH.PRECURSOR_UNAVAILABLE", "/synthesis_hint/precursors/1") in codes
    assert [r.route_id for r in feasibility.ranked_routes(s.where("k = 2"), "k").collect()] == ["route-element"]


def test_typed_issues_skip_nulls(spark):
    df = spark.createDataFrame(
        [(1, "ok", ("NaCl", 2000), [("x y", 1.0, 2.0)], ("oven", "K", None, -1.0), (1.5,)), (2, None, None, None, None, None)],
        "k int, proposal_id string, composition struct<formula:string,formula_units_per_cell:int>, claimed_properties array<struct<name:string,value:double,confidence:double>>, synthesis_hint struct<route:string,temperature_unit:string,precursors:array<string>,duration_hours:double>, generator_confidence struct<overall:double>",
    )
    assert {r.json_pointer for r in typed.issues(df, "k").collect()} == {"/composition/formula_units_per_cell", "/claimed_properties/0/name", "/claimed_properties/0/confidence", "/synthesis_hint/route", "/synthesis_hint/duration_hours", "/generator_confidence/overall"}


def test_fingerprint_ignores_record_and_run(spark):
    f = spark.createDataFrame([("a", "C", "/x", "1"), ("b", "C", "/x", "1"), ("c", "C", "/x", None), ("d", "C", "/y", "1")], "k string, code string, json_pointer string, observed string")
    got = {r.k: r.fingerprint for r in fd.with_fingerprint(f).collect()}
    assert got["a"] == got["b"] and len(set(got.values())) == 3


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"routes": {"low_force": 0.1}, "api_key": "x"}')
    c = resolve(str(p), evidence={"only": ["mineral_reference"]})
    assert c["routes"] == {"max_routes": 3, "low_force": 0.1} and c["evidence"]["only"] == ["mineral_reference"]
    assert redact(c)["api_key"] == "[redacted]" and digest(c) != digest(resolve()) and merge({"a": 1}, {"b": 2}) == {"a": 1, "b": 2}


def test_a_median_of_many_values_is_narrowed_down(spark, monkeypatch):
    monkeypatch.setattr(summarize, "SORTED", 50)
    v = spark.range(40_001).selectExpr("double(pmod(xxhash64(id), 1000003)) AS x")
    want = sorted(r.x for r in v.collect())[40_001 // 2]
    assert summarize.upper_median(v, "x", margin=1 / 200).first().p50 == want
    same = spark.range(1000).selectExpr("double(id % 2) AS x")
    assert summarize.upper_median(same, "x").first().p50 == 1.0

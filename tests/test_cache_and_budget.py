from __future__ import annotations

import json

from orefold.operators import crossrun, evidence, summarize
from orefold.plans import verification
from orefold.reference.config import DEFAULTS, resolve
from orefold.sources import corpus_files
from tests.test_verification import prop

SCHEMA = "key string, doc string, proposal_id string, candidate_key string"
DOCS = [(f"k{i}", json.dumps(prop(f"p{i}", f, claimed_properties=[{"name": "band_gap", "value": 1.0, "unit": "eV"}])), f"p{i}", f"c{f}") for i, f in enumerate(["TiO2", "Fe17O23", "TiO2", "ТiO2", "FeO"])]


def table(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_cached_results_equal_computed_ones(spark, tmp_path):
    docs = spark.createDataFrame([(k, json.dumps(prop("x", json.loads(d)["composition"]["formula"], claimed_properties=json.loads(d)["claimed_properties"])), p, c) for k, d, p, c in DOCS], SCHEMA)
    plain = verification.check(docs, DEFAULTS)
    store = str(tmp_path / "store")
    v, f, n = verification.cached_check(docs, DEFAULTS, store)
    assert n == 4 and table(v) == table(plain.verdicts) and table(f) == table(plain.findings)
    v, f, n = verification.cached_check(docs, DEFAULTS, store)
    assert n == 0 and table(v) == table(plain.verdicts)
    assert verification.cached_check(docs, resolve(feasibility={"threshold": 0.01}), store)[2] == 4


def test_budget_leaves_rows_for_quarantine(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    ticks = iter([0.0, 0.0, 5.0, *[100.0] * 9])
    done, left = verification.check_within(docs, DEFAULTS, 10.0, chunks=4, clock=lambda: next(ticks))
    some = 0 if done is None else done.verdicts.count()
    assert some + left.count() == len(DOCS) and {r.violation_code for r in left.collect()} <= {"VERIFY.BUDGET.EXHAUSTED"}
    done, left = verification.check_within(docs, DEFAULTS, 1e9, chunks=2)
    assert left.count() == 0 and table(done.verdicts) == table(verification.check(docs, DEFAULTS).verdicts)


def test_corpus_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"entries": [{"formula": "Ti2O4", "identifier": "a1"}, {"formula": "TiO2", "identifier": "a2"}, {"formula": "??", "identifier": "a3"}, {"formula": "FeO", "identifier": "a4", "n_documents": 0}]}))
    (tmp_path / "b.json").write_text("{broken")
    files = {n: (str(tmp_path / f"{n}.json"), "snapshot", "experimental") for n in ("a", "b", "none")}
    sources, entries = corpus_files.load(spark, files)
    assert {r.provider: r.available for r in sources.collect()} == {"a": True, "b": False, "none": False}
    assert {(r.key, r.identifier) for r in entries.collect()} == {("O:2|Ti:1", "a1"), ("Fe:1|O:1", "a4")}
    df = spark.createDataFrame([(1, "O:2|Ti:1"), (2, "Fe:1|O:1")], "k int, c string")
    got = {(r.k, r.provider): r.status for r in evidence.answers(df, "k", "c", sources, entries).collect()}
    assert got == {(1, "a"): "hit", (2, "a"): "miss", (1, "b"): "unavailable", (2, "b"): "unavailable", (1, "none"): "unavailable", (2, "none"): "unavailable"}
    assert corpus_files.load(spark, {"b": files["b"]})[1].count() == 0


def test_rates_and_component_means(spark):
    f = spark.createDataFrame([("A", 1), ("A", 1), ("B", 2), (None, 2)], "code string, run int")
    runs = spark.createDataFrame([(1, 10), (2, 4), (3, 0)], "run int, n_records int")
    got = {(r.code, r.run): r.per_100 for r in crossrun.rates(f, runs, "run").collect()}
    assert got == {("A", 1): 20.0, ("A", 2): 0.0, ("B", 1): 0.0, ("B", 2): 25.0, ("A", 3): None, ("B", 3): None}
    v = spark.createDataFrame([(1.0, None), (0.5, None), (None, None)], "a double, b double")
    assert [tuple(r) for r in summarize.component_means(v, ["a", "b"]).collect()] == [("a", 2, 0.75)]

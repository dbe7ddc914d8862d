"""The verification plan end to end on our own batches."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from orefold.plans import verification
from orefold.reference.config import DEFAULTS, resolve
from orefold.sources import envelopes as env


def batch(*proposals, **more):
    return {"schema_version": "1-0-0", "batch_id": "t", "created_at": "2026-01-01T00:00:00Z", "generator": {"model_id": "m", "prompt_id": "p"}, "proposals": [*proposals], **more}


def prop(i, formula, **more):
    return {"proposal_id": i, "composition": {"formula": formula, **more.pop("composition", {})}, **more}


def write(folder, name, doc):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(doc if isinstance(doc, bytes) else (doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False)).encode())
    return str(folder)


FIRST = batch(
    prop("R-1", "Fe2O3", synthesis_hint={"temperature": 700, "temperature_unit": "C"}, claimed_properties=[{"name": "band_gap", "value": 2.1, "unit": "eV"}], generator_confidence={"overall": 0.9, "per_field": {"/composition/formula": 0.8, "/claimed_properties": 0.7}}),
    prop("R-2", "LiFePO4", claimed_properties=[{"name": "average_voltage", "value": 3.4, "unit": "V"}]),
    prop("R-3", "Fe17O23", claimed_properties=[{"name": "band_gap", "value": 1.0, "unit": "eV"}]),
    prop("R-4", "C8H8"),
    prop("R-5", "Fe4O6", claimed_properties=[{"name": "density", "value": -999, "unit": "g/cm3"}, {"name": "density", "value": 5.2, "unit": "kg/m3"}], synthesis_hint={"atmosphere": "H2", "temperature": 1000, "temperature_unit": "C"}),
    prop("R-6", "Al2SiO5"),
    prop("bad id", "TiO2"),
    {**prop("R-7", "TiO2"), "extra": 1},
    {**prop("R-8", "NaCl"), "composition": {}},
    created_at="2026-01-01T00:00:00",
)
SECOND = batch(prop("R-1", "TiO2"), prop("R-7", "TiO2", composition={"elements": {"Ti": 1, "O": 3}}), prop("R-9", "ТiO2"))


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("in") / "b"
    write(d, "a.json", FIRST)
    write(d, "b.json", SECOND)
    write(d, "ignored.txt", "x")
    return verification.run(spark, str(d))


def test_counts_and_exit(ran):
    c = ran.counts
    assert ran.exit_code == 4 and c["records_in"] == 12 == c["admitted"] + c["quarantined"] and c["duplicates"] == 1
    assert c["admitted"] == c.get("accepted", 0) + c.get("rejected", 0) + c.get("unverifiable", 0) == ran.checked.verdicts.count()
    q = {(r.key, r.violation_code) for r in ran.quarantined.collect()}
    assert q == {("a.json#000006", "FMT.SCHEMA.TYPE_MISMATCH"), ("a.json#000007", "FMT.SCHEMA.UNKNOWN_FIELD"), ("a.json#000008", "FMT.SCHEMA.REQUIRED_FIELD_MISSING"), ("b.json#000000", "FMT.ID.DUPLICATE_PROPOSAL_ID")}


def test_verdicts(ran):
    v = {r.proposal_id: r for r in ran.checked.verdicts.collect()}
    assert (v["R-1"].status, round(v["R-1"].reward, 6), v["R-1"].tier) == ("rejected", 0.6875, "experimentally_reported")
    assert (v["R-2"].status, round(v["R-2"].reward, 6), v["R-2"].feasibility) == ("rejected", 0.59375, "unknown")
    assert (v["R-3"].status, round(v["R-3"].reward, 6), v["R-3"].tier) == ("accepted", 0.65625, "no_evidence")
    assert v["R-4"].status == "unverifiable" and v["R-4"].out_of_scope
    assert v["R-6"].status == "unverifiable" and v["R-6"].unavailable and v["R-6"].tier == "experimentally_reported"
    assert v["R-7"].proposal_id == "R-7" and v["R-9"].reward == 0.0 and v["R-9"].status == "rejected" and v["R-9"].tier is None
    assert all(r.record_id.startswith(ran.run_id + ":") for r in v.values())


def test_repairs_are_checked_again_once(ran):
    r = {x.repair_id: x for x in ran.repaired.collect()}
    assert {k.split(":")[1] for k in r if k.startswith("R-5")} == {"reduce-formula", "oxidising-atmosphere", "drop-placeholder-claimed_properties-0-value"}
    assert r["R-7:sync-elements"].improves and r["R-7:sync-elements"].reward_after > r["R-7:sync-elements"].reward_before
    assert not [k for k in r if k.startswith("R-9")]
    pairs = {p.repair_id for p in verification.preference_pairs(ran.repaired).collect()}
    assert "R-7:sync-elements" in pairs and all(r[p].status_before == "rejected" for p in pairs)


def test_ledger_and_summaries(ran):
    hits = {r.rule_id: r.n_hits for r in ran.ledger.collect()}
    assert len(hits) == 14 and hits["input.timezone_naive_timestamps"] == 1 and hits["record.schema_conformance"] == 3 and hits["claims.sentinel_values"] == 1 and hits["input.duplicate_keys"] == 0
    s = verification.summary(ran)
    n = ran.checked.findings.count()
    assert s["code_by_field"].where("code IS NOT NULL AND json_pointer IS NULL").agg(F.sum("n")).first()[0] == n
    assert s["reward"].first().n == ran.counts["admitted"] and s["tiers"].agg(F.sum("n")).first()[0] == 7
    assert {(r.json_pointer, r.outcome) for r in s["calibration_pairs"].collect()} == {("/composition/formula", "incorrect"), ("/claimed_properties", "correct")}
    assert {r.status for r in s["scalar_reward"].collect()} <= {"accepted", "rejected"} and s["recommendations"].where("target = 'prompt'").count() > 0
    assert s["routes"].where("rank = 1").count() > 0


def test_result_does_not_depend_on_partitions(spark, tmp_path, ran):
    d = write(tmp_path / "b", "a.json", FIRST)
    write(tmp_path / "b", "b.json", SECOND)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        again = verification.run(spark, d, repairs=False)
        assert again.run_id == ran.run_id
        key = lambda df: sorted(map(tuple, df.drop("record_id").collect()), key=repr)
        assert key(again.checked.verdicts) == key(ran.checked.verdicts) and key(again.checked.findings) == key(ran.checked.findings)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert verification.run(spark, d, seed=1, repairs=False).run_id != ran.run_id


@pytest.mark.parametrize(
    ("doc", "code"),
    [
        ('{"a": NaN}', "FMT.JSON.NON_FINITE_NUMBER"), ('{"a": -Infinity}', "FMT.JSON.NON_FINITE_NUMBER"), ('{"a": 1e999}', "FMT.JSON.NON_FINITE_NUMBER"), ('{"a": 1, "a": 2}', "FMT.JSON.DUPLICATE_KEY"), ("[" * 33 + "]" * 33, "FMT.JSON.DEPTH_EXCEEDED"),
        ("{", "FMT.JSON.UNPARSEABLE"), (b"\xff\xfe", "FMT.JSON.UNPARSEABLE"), ("[]", "FMT.JSON.UNPARSEABLE"), (json.dumps(batch(prop("a", "NaCl"), schema_version="2-0-0")), "FMT.SCHEMA.VERSION_UNSUPPORTED"), (json.dumps(batch()), "FMT.SCHEMA.REQUIRED_FIELD_MISSING"),
        (json.dumps(batch(prop("a", "NaCl", rationale="x" * 10_001))), "FMT.SCHEMA.TYPE_MISMATCH"), (json.dumps(batch(prop("a", "NaCl", rationale="x" * 40_000_000))), "FMT.JSON.SIZE_EXCEEDED"),
    ],
)
def test_rejected_envelopes(spark, tmp_path, doc, code):
    r = verification.run(spark, write(tmp_path / "b", "x.json", doc))
    assert r.exit_code == 3 and [x.code for x in r.batches.collect()] == [code]


def test_depth_is_measured_outside_strings():
    env.check_depth('{"a": "[[[[\\"[[[[", "b": [1]}', 2)
    env.check_depth("[" * 32 + "]" * 32, 32)
    with pytest.raises(env.Rejected):
        env.check_depth('[["a"]]', 1)


def test_unknown_provider_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="nobody"):
        verification.run(spark, write(tmp_path / "b", "x.json", batch(prop("a", "NaCl"))), config=resolve(evidence={"only": ["nobody"]}))


def test_config_moves_a_code(spark):
    docs = spark.createDataFrame([("k", json.dumps(prop("a", "FeO")), "a", "x")], "key string, doc string, proposal_id string, candidate_key string")
    codes = lambda c: {r.code for r in verification.check(docs, c).findings.collect()}
    strict = resolve(feasibility={"threshold": 0.01})
    assert codes(strict) - codes(DEFAULTS) == {"FEAS.THERMO.EHULL_ABOVE_THRESHOLD", "FEAS.THERMO.DECOMPOSES"}

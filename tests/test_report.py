"""Writing, verifying, pooling and streaming runs."""

from __future__ import annotations

import json

import pytest

from orefold import cli
from orefold.plans import report, verification
from orefold.reference.config import resolve
from orefold.sources import artifacts
from orefold.streaming import watch
from tests.test_verification import FIRST, SECOND, write


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("w")
    src = write(d / "in", "a.json", FIRST)
    r = verification.run(spark, src, logical_time="2026-01-01T00:00:00Z")
    report.write(r, str(d / "one"), logical_time="2026-01-01T00:00:00Z")
    strict = resolve(feasibility={"threshold": 0.0001, "temperature": 2000.0})
    r2 = verification.run(spark, write(d / "in2", "b.json", SECOND), config=strict, logical_time="2026-01-02T00:00:00Z", repairs=False)
    report.write(r2, str(d / "two"), config=strict, logical_time="2026-01-02T00:00:00Z")
    return d


def test_artifacts_are_canonical_and_verify(spark, written):
    assert report.verify(spark, str(written / "one")) == [] and report.verify(spark, str(written / "two")) == []
    lines = (written / "one" / "verdicts.jsonl").read_text().splitlines()
    assert all(json.dumps(json.loads(x), sort_keys=True, separators=(",", ":")) == x for x in lines)
    m = json.loads((written / "one" / "manifest.json").read_text())
    assert {a["path"] for a in m["artifacts"]} >= {"verdicts.jsonl", "findings.jsonl", "report.html", "scalar_reward.jsonl", "preference_pairs.jsonl", "calibration_pairs.jsonl", "figure-hull-1.svg", "figure-hull-1.json"}
    page = (written / "one" / "report.html").read_text()
    assert page.count("<section>") == 9 and "http" not in page


def test_same_input_same_bytes(spark, written, tmp_path):
    r = verification.run(spark, str(written / "in"), logical_time="2026-01-01T00:00:00Z")
    report.write(r, str(tmp_path / "again"), logical_time="2026-01-01T00:00:00Z")
    digests = lambda d: {a["path"]: a["sha256"] for a in json.loads((d / "manifest.json").read_text())["artifacts"]}
    assert digests(tmp_path / "again") == digests(written / "one")


def test_tampering_is_seen(spark, written, tmp_path):
    import shutil

    bad = tmp_path / "bad"
    shutil.copytree(written / "two", bad)
    text = (bad / "verdicts.jsonl").read_text()
    (bad / "verdicts.jsonl").write_text(text.replace('"rejected"', '"accepted"', 1))
    (bad / "stray.txt").write_text("x")
    problems = report.verify(spark, str(bad))
    assert any("verdicts.jsonl" in p for p in problems) and any("stray" in p for p in problems) and any("accepted" in p for p in problems)
    assert report.verify(spark, str(tmp_path / "none"))[0].startswith("manifest")


def test_lineage_and_config(spark, written):
    states = dict(report.lineage(str(written / "two")))
    assert states["config"] == "DIVERGED" and states["corpora"] == "MATCH" and states["commit"] == "UNKNOWN"
    d = report.config_differences(spark, resolve(), resolve(routes={"low_force": 0.1}, extra={"x": 1}))
    assert {(r.path, r.change) for r in d.collect()} == {("routes.low_force", "changed"), ("extra.x", "added")}


def test_pooled_runs(spark, written):
    one, two = str(written / "one"), str(written / "two")
    p = report.pool(spark, [two, one])
    assert {r.aspect: r.comparable for r in p["comparability"].collect()}["config_sha256"] is False
    assert {r.state for r in p["lifecycle"].collect()} <= {"new", "resolved", "persistent"}
    same = report.pool(spark, [one, one])
    assert {r.state for r in same["lifecycle"].collect()} in ({"persistent"}, {"new"})
    total = sum(r.total_findings for r in p["code_by_field"].collect())
    assert total == sum(len((written / x / "findings.jsonl").read_text().splitlines()) for x in ("one", "two"))
    assert {r.code for r in p["trend"].collect()} == {r.code for r in p["code_by_field"].collect()}
    with pytest.raises(ValueError, match="no runs"):
        report.pool(spark, [])


def test_rejected_run_writes_a_manifest(spark, tmp_path):
    r = verification.run(spark, write(tmp_path / "x", "a.json", "{"))
    m = report.write(r, str(tmp_path / "out"))
    assert m["exit_code"] == 3 and m["rejected"][0]["code"] == "FMT.JSON.UNPARSEABLE" and artifacts.verify_files(str(tmp_path / "out")) == []


def test_command_line(spark, written, tmp_path, capsys):
    assert cli.main(["run", str(tmp_path / "nothing"), "--out", str(tmp_path / "o")]) == 2
    assert cli.main(["verify", str(written / "one")]) == 0 and cli.main(["lineage", str(written / "two")]) == 1
    assert cli.main(["aggregate", str(written / "one"), str(written / "two"), "--out", str(tmp_path / "agg")]) == 0
    assert cli.main(["schema"]) == 0 and "composition struct" in capsys.readouterr().out


def test_stream_takes_each_file_once(spark, tmp_path):
    src, sink = write(tmp_path / "in", "a.json", FIRST), str(tmp_path / "sink")
    watch.verify_stream(spark, src, sink)
    n = spark.read.parquet(f"{sink}/verdicts").count()
    watch.verify_stream(spark, src, sink)
    assert spark.read.parquet(f"{sink}/verdicts").count() == n == 6
    write(tmp_path / "in", "b.json", SECOND)
    watch.verify_stream(spark, src, sink)
    v = spark.read.parquet(f"{sink}/verdicts")
    assert v.count() == n + 2 and v.select("micro_batch").distinct().count() == 2
    refused = {(r.key, r.decision, r.micro_batch) for r in spark.read.parquet(f"{sink}/refused").collect()}
    assert ("b.json#000000", "duplicate", 1) in refused and v.groupBy("proposal_id").count().where("count > 1").count() == 0

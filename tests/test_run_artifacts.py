"""What a written run says, and that every broken invariant is seen."""

from __future__ import annotations

import hashlib
import json
import shutil

import pytest

from orefold import cli
from orefold.plans import report, verification
from orefold.reference.config import resolve
from orefold.sources import artifacts
from tests.test_verification import FIRST, SECOND, prop, write

OXIDE = prop("R-0", "CuO", synthesis_hint={"atmosphere": "H2", "temperature": 1000, "temperature_unit": "C", "precursors": ["CuO (99 %)", "???"]})


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("run")
    src = write(d / "in", "a.json", {**FIRST, "proposals": [*FIRST["proposals"], OXIDE]})
    write(d / "in", "b.json", SECOND)
    r = verification.run(spark, src)
    report.write(r, str(d / "out"), tables=str(d / "tables"))
    return d


def lines(path):
    return [json.loads(x) for x in path.read_text().splitlines()]


def test_findings_say_what_they_mean(run):
    f = {(x["proposal_id"], x["code"], x["json_pointer"]): x for x in lines(run / "out" / "findings.jsonl")}
    placeholder = f["R-5", "CLAIM.SENTINEL.SUSPECTED", "/claimed_properties/0/value"]
    assert placeholder["observed"] == -999 and isinstance(placeholder["observed"], (int, float)) and "placeholder" in placeholder["message"]
    reduced = f["R-5", "CHEM.FORMULA.NOT_REDUCED", "/composition/formula"]
    assert reduced["observed"] == "Fe4O6" and reduced["expected"] == "Fe2O3" and "Fe2O3" in reduced["message"]
    assert all(0 < len(x["message"]) <= 1000 for x in f.values())
    one = {"code": placeholder["code"], "json_pointer": placeholder["json_pointer"], "observed": -999.0}
    assert placeholder["fingerprint"] == "sha256:" + hashlib.sha256(json.dumps(one, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_recommendations_carry_their_evidence(run):
    r = lines(run / "out" / "recommendations.jsonl")
    assert [x["rank"] for x in r] == [*range(1, len(r) + 1)] and all(x["statement"] and x["json_pointers"] and x["codes"] for x in r)
    units = next(x for x in r if x["codes"] == ["CLAIM.SENTINEL.SUSPECTED"])
    assert units["json_pointers"] == ["/claimed_properties/0/value"] and units["example_ids"] == ["R-5"] and units["n_records"] == 1
    assert all(x["json_pointers"] == sorted(x["json_pointers"])[:20] and x["example_ids"] == sorted(x["example_ids"])[:5] for x in r)


def test_every_record_has_its_checks(run):
    checks = lines(run / "out" / "checks.jsonl")
    by_record = {}
    for c in checks:
        by_record.setdefault(c["record_id"], []).append(c)
    assert len(by_record) == len(lines(run / "out" / "verdicts.jsonl"))
    for cs in by_record.values():
        assert [(c["phase"], c["check_id"]) for c in cs] == sorted((c["phase"], c["check_id"]) for c in cs) and len(cs) == 9
    got = {(c["proposal_id"], c["check_id"]): c["outcome"] for c in checks}
    assert got["R-9", "composition.formula_normalize"] == "fail" and got["R-9", "novelty.prior_art"] == "not_applicable" and got["R-6", "novelty.prior_art"] == "unavailable" and got["R-1", "structure.coherence"] == "not_applicable" and got["R-5", "claims.audit"] == "fail"


def test_manifest_names_inputs_and_tables(run):
    m = json.loads((run / "out" / "manifest.json").read_text())
    assert [(i["name"], i["sha256"]) for i in m["inputs"]] == [(n, hashlib.sha256((run / "in" / n).read_bytes()).hexdigest()) for n in ("a.json", "b.json")]
    assert all(d["snapshot"] and d["coverage"] and d["license"] and d["entries"] > 0 for d in m["reference_data"]) and m["offline"] is True
    assert {u["provider"] for u in m["unavailable_providers"]} == {"literature_cassette"} and m["config"]["evidence"]["offline"] is True
    index = json.loads((run / "out" / "projections.json").read_text())
    assert {p["name"]: p["rows"] for p in index["projections"]} == {n: len(lines(run / "out" / f"{n}.jsonl")) for n in report.PROJECTIONS}
    known = {v["record_id"] for v in lines(run / "out" / "verdicts.jsonl")}
    assert m["figures"] and all(f["record_id"] in known and (run / "out" / f["data"]).is_file() for f in m["figures"])


def test_figures(run):
    fig = report.potential_figure("CuO")
    assert fig["boundary"] < 0 and {p[2] for p in fig["points"] if p[1] < 0} >= {"H2: Cu + H2O"} and all((x > fig["boundary"]) == (y > 0) for x, y, _ in fig["points"])
    around = report.context_figure("LiFePO4")
    assert any(n.startswith("LiFePO4 (") for _, _, n in around["points"]) and report.context_figure("??") is None and report.potential_figure("NaCl") is None


def test_large_tables_lie_beside(spark, run):
    assert spark.read.parquet(str(run / "tables" / "verdicts")).count() == len(lines(run / "out" / "verdicts.jsonl"))


def edit(folder, name, change):
    """Changes a file of a run and its entry in the manifest, so that only the content is wrong."""
    path = folder / name
    path.write_text(change(path.read_text()))
    m = json.loads((folder / "manifest.json").read_text())
    for a in m["artifacts"]:
        if a["path"] == name:
            a |= {"sha256": artifacts.file_digest(path), "bytes": path.stat().st_size}
    (folder / "manifest.json").write_text(json.dumps(m))


def rows(change):
    return lambda text: "".join(json.dumps(x) + "\n" for x in change([json.loads(t) for t in text.splitlines()]))


TAMPERED = [
    ("verdicts.jsonl", rows(lambda r: [{**r[0], "reward": 0.123}, *r[1:]]), "reward differs"),
    ("verdicts.jsonl", rows(lambda r: [{**r[0], "n_findings": r[0]["n_findings"] + 1}, *r[1:]]), "verdict counts other findings"),
    ("verdicts.jsonl", rows(lambda r: [*r[1:], r[0]]), "verdicts are not in order"),
    ("verdicts.jsonl", rows(lambda r: [{**r[0], "run_id": "run-x"}, *r[1:]]), "verdict of another run"),
    ("verdicts.jsonl", rows(lambda r: [{**r[0], "mood": "fine"}, *r[1:]]), "verdicts.jsonl: unknown mood"),
    ("verdicts.jsonl", lambda t: t + "[1]\n", "verdicts.jsonl: no object"),
    ("findings.jsonl", rows(lambda r: [{**r[0], "record_id": "nobody"}, *r[1:]]), "finding without verdict"),
    ("findings.jsonl", rows(lambda r: [{**r[0], "candidate_key": "other"}, *r[1:]]), "finding with another id or key"),
    ("findings.jsonl", rows(lambda r: [{k: v for k, v in r[0].items() if k != "message"}, *r[1:]]), "findings.jsonl: missing message"),
    ("checks.jsonl", rows(lambda r: [x for x in r if not (x["proposal_id"] == "R-1" and x["phase"] == "novelty")]), "phase without a check"),
    ("scalar_reward.jsonl", rows(lambda r: [{**r[0], "reward": 0.9}, *r[1:]]), "scalar_reward: other reward"),
    ("scalar_reward.jsonl", rows(lambda r: r[1:]), "scalar_reward: record left out"),
    ("calibration_pairs.jsonl", rows(lambda r: [{**r[0], "record_id": "nobody"}, *r[1:]]), "calibration_pairs: row of no record"),
    ("preference_pairs.jsonl", rows(lambda r: [{**r[0], "chosen_reward": 0.0}, *r[1:]]), "preference_pairs: no gain"),
    ("violation_table.jsonl", rows(lambda r: r[1:]), "violation_table.jsonl: other number of rows"),
    ("projections.json", lambda t: t.replace('"run_id":"run-', '"run_id":"walk-'), "projections.json: another run"),
    ("routes.jsonl", lambda t: t + '{"key":"/home/someone/x"}\n', "routes.jsonl: host path"),
    ("report.html", lambda t: t + "http://example.org", "report holds an address"),
]


def test_a_run_is_whole(spark, run):
    assert report.verify(spark, str(run / "out")) == []


@pytest.mark.parametrize("turn", range(6))
def test_every_broken_invariant_is_seen(spark, run, tmp_path, turn):
    """Each turn breaks one more of the invariants of each file, all files at once."""
    bad = tmp_path / "bad"
    shutil.copytree(run / "out", bad)
    nth, todo = {}, []
    for name, change, problem in TAMPERED:
        nth[name] = nth.get(name, -1) + 1
        if nth[name] == turn:
            edit(bad, name, change)
            todo.append(problem)
    found = report.verify(spark, str(bad))
    assert todo and all(any(p.startswith(problem) for p in found) for problem in todo), (todo, found)


def test_manifest_and_figures_are_checked(spark, run, tmp_path):
    bad = tmp_path / "bad"
    shutil.copytree(run / "out", bad)
    m = json.loads((bad / "manifest.json").read_text())
    m["reference_data"][0]["snapshot"], m["figures"][0]["record_id"], m["counts"]["accepted"] = "latest", "nobody", 99
    gone = m["figures"][1]["data"]
    (bad / gone).unlink()
    m["artifacts"].append({"path": "../x", "sha256": "", "bytes": 0})
    (bad / "manifest.json").write_text(json.dumps(m))
    problems = report.verify(spark, str(bad))
    assert sum(any(w in p for p in problems) for w in ("no version", "figure of no record", "accepted: other count", f"{gone}: missing", "leaves the folder")) == 5


def test_lineage_of_inputs(run, tmp_path):
    states = dict(report.lineage(str(run / "out"), inputs=str(run / "in")))
    assert states["input a.json"] == states["input b.json"] == states["artifacts"] == states["config"] == states["source"] == "MATCH"
    moved = tmp_path / "in"
    shutil.copytree(run / "in", moved)
    (moved / "a.json").write_text("{}")
    states = dict(report.lineage(str(run / "out"), inputs=str(moved), config=resolve(evidence={"only": ["mineral_reference"]})))
    assert states["input a.json"] == "DIVERGED" and states["config"] == "MATCH" and dict(report.lineage(str(run / "out")))["input a.json"] == "UNKNOWN"


def test_command_line_takes_store_budget_and_corpora(run, tmp_path):
    src, store = str(run / "in"), str(tmp_path / "store")
    read = lambda n: {(v["proposal_id"], v["reward"], v["status"]) for v in lines(tmp_path / n / "verdicts.jsonl")}
    assert [cli.main(["run", src, "--out", str(tmp_path / n), "--cache", store]) for n in ("one", "two")] == [4, 4]
    assert read("one") == read("two") == {(v["proposal_id"], v["reward"], v["status"]) for v in lines(run / "out" / "verdicts.jsonl")}
    assert cli.main(["run", src, "--out", str(tmp_path / "late"), "--seconds", "0"]) == 4
    assert {q["violation_code"] for q in lines(tmp_path / "late" / "quarantined.jsonl")} >= {"VERIFY.BUDGET.EXHAUSTED"}
    corpora = tmp_path / "corpora"
    write(corpora, "experimental_snapshot.json", {"entries": [{"formula": "Fe17O23", "identifier": "x1"}]})
    assert cli.main(["run", src, "--out", str(tmp_path / "own"), "--corpora", str(corpora)]) == 4
    v = {x["proposal_id"]: x for x in lines(tmp_path / "own" / "verdicts.jsonl")}
    assert v["R-3"]["tier"] == "experimentally_reported" and v["R-2"]["tier"] == "unknown" and v["R-2"]["status"] == "unverifiable"
    (tmp_path / "c.json").write_text('{"routes": {"speed": 1}}')
    assert cli.main(["run", src, "--out", str(tmp_path / "x"), "--config", str(tmp_path / "c.json")]) == 2
    assert cli.main(["lineage", str(tmp_path / "nowhere")]) == 2 and cli.main(["aggregate", str(tmp_path / "nowhere"), "--out", str(tmp_path / "y")]) == 2

"""Writing a run: artifacts, HTML report with figures, manifest; verifying, comparing and pooling written runs."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold import __version__
from orefold.functions import chemistry as ch
from orefold.functions import formula as fm
from orefold.operators import audit, crossrun, score, summarize
from orefold.operators.evidence import corpus_rows
from orefold.plans import verification as vf
from orefold.reference.config import digest, redact, resolve
from orefold.reference.corpora import PROVIDERS, SNAPSHOT
from orefold.reference.taxonomy import TAXONOMY_VERSION
from orefold.reference.thermochemistry import ENTRIES
from orefold.sources import artifacts as af

FIGURES = 4
#: The projections for training a generator: file columns, which statuses they hold and leave out, and why.
PROJECTIONS = {
    "scalar_reward": (("record_id", "proposal_id", "candidate_key", "reward", "status"), ("accepted", "rejected"), ("unverifiable",), "What could not be checked says nothing about the generator."),
    "preference_pairs": (("record_id", "repair_id", "proposal_id", "rejected_reward", "chosen_reward", "targets"), ("rejected",), ("accepted", "unverifiable"), "Only repairs that were checked again and scored higher."),
    "calibration_pairs": (("record_id", "proposal_id", "json_pointer", "confidence", "outcome"), ("accepted", "rejected"), ("unverifiable",), "An unverifiable outcome measures what we cover, not how sure the generator should be."),
    "violation_table": (("record_id", "proposal_id", "code", "level", "json_pointer"), ("accepted", "rejected", "unverifiable"), (), "Every finding of every record, as an index for diagnosis."),
}
VERDICTS = (
    "key string, record_id string, run_id string, proposal_id string, candidate_key string, composition_key string, reduced string, out_of_scope string, tier string, tier_confidence double, supporters array<string>, conflicts array<string>, feasibility string, frame string, charge string, "
    "n_routes bigint, n_claims bigint, n_bad bigint, structure_errors bigint, structure_warnings bigint, value_composition_valid double, value_structure_valid double, value_novelty double, value_feasibility double, value_claims_supported double, reward double, status string, n_findings bigint, n_errors bigint, unavailable boolean"
)
FINDINGS = "key string, record_id string, proposal_id string, candidate_key string, code string, level string, phase string, gate boolean, unverifiable boolean, json_pointer string, message string, observed string, expected string, confidence double, fingerprint string"
CHECKS = "key string, record_id string, proposal_id string, candidate_key string, check_id string, phase string, outcome string, detail string"
SCHEMAS = {
    "verdicts": (VERDICTS, ("key", "record_id", "run_id", "candidate_key", "reward", "status", "n_findings")),
    "findings": (FINDINGS, ("key", "record_id", "candidate_key", "code", "level", "phase", "json_pointer", "message", "fingerprint")),
    "checks": (CHECKS, ("key", "record_id", "check_id", "phase", "outcome")),
    "scalar_reward": ("record_id string, proposal_id string, candidate_key string, reward double, status string", ("record_id", "reward", "status")),
    "preference_pairs": ("record_id string, repair_id string, proposal_id string, rejected_reward double, chosen_reward double, targets array<string>", ("record_id", "repair_id", "rejected_reward", "chosen_reward")),
    "calibration_pairs": ("record_id string, proposal_id string, json_pointer string, confidence double, outcome string", ("record_id", "json_pointer", "confidence", "outcome")),
    "violation_table": ("record_id string, proposal_id string, code string, level string, json_pointer string", ("record_id", "code", "level", "json_pointer")),
}
#: Phases every record has a check of.
PHASES = ("parse", "composition", "structure", "novelty", "claims")


def datasets(only: Sequence[str] | None = None) -> list[dict]:
    """Every reference table a result rests on: name, how it answers, version, entries, digest, coverage and
    licence; sorted by name."""
    rows = corpus_rows()
    names = [p for p in PROVIDERS if only is None or p.name in only]
    row = lambda name, kind, entries, content, covers: {"id": f"{name}@{SNAPSHOT}", "provider": name, "kind": kind, "snapshot": SNAPSHOT, "entries": entries, "sha256": af.hashlib.sha256(repr(content).encode()).hexdigest(), "coverage": covers, "license": "facts; as this package"}
    out = []
    for p in names:
        own = [r for r in rows if r[0] == p.name]
        out.append(row(p.name, "cassette" if p.mode == "replay" else "snapshot", len(own), own, f"{len(own)} well-known compositions; what is absent is not thereby new"))
    out.append(row("thermochemistry", "snapshot", len(ENTRIES), ENTRIES, f"{len(ENTRIES)} phases with enthalpies at 298 K"))
    return sorted(out, key=lambda d: d["id"])


def corpus_fingerprint() -> str:
    return af.hashlib.sha256("|".join(f"{d['id']}:{d['sha256']}" for d in datasets()).encode()).hexdigest()[:16]


def _svg(title: str, points: list[tuple[float, float, str]], line: list[tuple[float, float]] = ()) -> str:
    """Points and a line, scaled into a fixed frame."""
    xs, ys = [p[0] for p in [*points, *line]], [p[1] for p in [*points, *line]]
    x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
    at = lambda x, y: (40 + 320 * (x - x0) / ((x1 - x0) or 1), 180 - 150 * (y - y0) / ((y1 - y0) or 1))
    path = " ".join("{:.1f},{:.1f}".format(*at(*p)) for p in line)
    marks = "".join('<circle cx="{:.1f}" cy="{:.1f}" r="4"/><text x="{:.1f}" y="{:.1f}" font-size="10">{}</text>'.format(*at(x, y), at(x, y)[0] + 6, at(x, y)[1] - 4, html.escape(n)) for x, y, n in points)
    return f'<svg viewBox="0 0 400 210" role="img" aria-label="{html.escape(title)}"><polyline points="{path}" fill="none" stroke="black"/>{marks}<text x="40" y="205" font-size="11">{html.escape(title)}</text></svg>'


def hull_figure(formula: str) -> dict | None:
    """Known phases of a binary system by the share of the second element, with their lower hull."""
    f = fm.parse(formula)
    if not f.ok or len(f.counts) != 2:
        return None
    _, b = sorted(f.counts)
    points = sorted((p.counts.get(b, 0.0) / p.atoms, p.per_atom, p.formula) for p in ch.phases().values() if set(p.counts) <= set(f.counts))
    return {"kind": "hull", "formula": formula, "points": points, "line": ch.lower_hull([(x, y) for x, y, _ in points])} if len(points) > 1 else None


def potential_figure(formula: str, kelvin: float = 1273.15) -> dict | None:
    """Driving force of an oxide in every atmosphere with an oxygen potential, and the potential at which the
    oxide falls apart; below it the atmosphere's name is followed by what is left."""
    f = fm.parse(formula)
    gases = ["O2", "air", "CO2", "Ar", "sealed_ampoule", "vacuum", "forming_gas", "H2"]
    points = []
    for gas in gases if f.ok else ():
        if (force := ch.survival(f.counts, gas, kelvin)) is not None:
            left = ch.products(fm.reduced(f.counts), gas, kelvin)
            points.append((ch.oxygen_potential(gas, kelvin), force, f"{gas}: {' + '.join(left)}" if left else gas))
    edge = ch.boundary(f.counts) if f.ok else None
    line = [] if edge is None or not points else [(edge, min(p[1] for p in points)), (edge, max(p[1] for p in points))]
    return {"kind": "potential", "formula": formula, "kelvin": kelvin, "boundary": edge, "points": points, "line": line} if points else None


def route_figure(formula: str) -> dict | None:
    f = fm.parse(formula)
    points = [(float(r.rank), r.energy, r.family) for r in (ch.routes(f.counts) if f.ok else []) if r.energy is not None]
    return {"kind": "routes", "formula": formula, "points": points, "line": []} if points else None


def corpus_phases() -> dict[str, list[tuple[str, str]]]:
    """By chemical system, (reduced formula, identifier) of every phase the corpora know, each formula once."""
    out: dict[str, dict[str, str]] = {}
    for _, k, formula, identifier, _ in corpus_rows():
        system = out.setdefault("-".join(sorted(x.split(":")[0] for x in k.split("|"))), {})
        system[formula] = min(identifier, system.get(formula, identifier))
    return {s: sorted(v.items()) for s, v in out.items()}


def context_figure(formula: str) -> dict | None:
    """The phases the corpora know in the chemical system, by the share of its most electronegative element; at
    their energy where the tables have one, else at none."""
    f = fm.parse(formula)
    ranked = sorted((-ch.ELECTRONEGATIVITY[e], e) for e in f.counts if e in ch.ELECTRONEGATIVITY) if f.ok else []
    if not ranked:
        return None
    known = corpus_phases().get("-".join(sorted(f.counts)), [])
    points, unplaced = [], []
    for name, identifier in known:
        counts = fm.parse(name).counts
        phase = ch.phase_of(counts)
        (points if phase is not None else unplaced).append((counts.get(ranked[0][1], 0.0) / sum(counts.values()), phase.per_atom if phase is not None else 0.0, f"{name} ({identifier})"))
    everything = sorted([*points, *unplaced])
    return {"kind": "context", "formula": formula, "element": ranked[0][1], "points": everything, "without_energy": sorted(n for _, _, n in unplaced), "line": []} if everything else None


def _table(df: DataFrame, limit: int = 20) -> str:
    rows = df.limit(limit).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def write(r: vf.Run, folder: str, *, config: dict | None = None, logical_time: str = "1970-01-01T00:00:00Z", tables: str | None = None) -> dict:
    """All artifacts of a run in a fresh folder, the manifest last; returns the manifest. tables names a folder
    that receives verdicts, findings and checks as Parquet besides, written by all tasks."""
    config = resolve() if config is None else config
    out = af.prepare(folder)
    files: list[dict] = []
    only = config["evidence"]["only"]
    inputs = r.batches.select("path", "length", "digest", "batch_id").orderBy("path").collect()
    manifest: dict = {
        "run_id": r.run_id, "exit_code": r.exit_code, "logical_time": logical_time, "config": redact(config), "config_sha256": digest(config), "taxonomy_version": TAXONOMY_VERSION, "reward_fn_id": config["reward"]["id"],
        "corpus_fingerprint": corpus_fingerprint(), "reference_data": datasets(only), "unavailable_providers": [], "source_sha256": af.tree_digest(str(Path(__file__).resolve().parents[1])), "provenance": af.provenance(), "version": __version__, "counts": r.counts,
        "inputs": [{"name": Path(x["path"]).name, "bytes": x["length"], "sha256": x["digest"], "batch_id": x["batch_id"]} for x in inputs],
        "offline": True, "notes": ["No live source was consulted; absence from a table is not absence from the world."],
    }
    rejected = r.batches.where(F.col("code").isNotNull()).select("path", "code", "rule", "detail").orderBy("path").limit(1).collect()
    manifest["rejected"] = [dict(x.asDict(), path=Path(x.path).name) for x in rejected]
    if r.quarantined is not None:
        files.append(af.write_lines(r.quarantined, out / "quarantined.jsonl", ["key"]))
    if r.checked is not None:
        s = vf.summary(r)
        v = r.checked.verdicts
        ids = v.select("key", "record_id", "proposal_id", "candidate_key")
        whole = {"verdicts": v, "findings": r.checked.findings.join(ids, "key"), "checks": s["checks"].join(ids, "key")}
        order = {"verdicts": ["proposal_id", "candidate_key"], "findings": ["proposal_id", "code", "json_pointer", "candidate_key", "level"], "checks": ["proposal_id", "candidate_key", "phase", "check_id"]}
        for name, df in whole.items():
            files.append(af.write_lines(df, out / f"{name}.jsonl", order[name]))
            if tables is not None:
                af.write_table(df, f"{tables}/{name}")
        away = r.checked.answers.where(F.col("status") == "unavailable").groupBy("provider", "mode").agg(F.count(F.lit(1)).alias("records")).orderBy("provider").collect()
        manifest["unavailable_providers"] = [{"provider": x["provider"], "records": x["records"], "reason": "never asked about these compositions" if x["mode"] == "replay" else "could not be consulted"} for x in away]
        files.append(af.write_lines(r.ledger, out / "ledger.jsonl", ["rule_id"]))
        advised = s["recommendations"].join(F.broadcast(summarize.statements(v.sparkSession)), "advice_id", "left")
        for name, df, by in (("code_by_field", s["code_by_field"], ["code", "json_pointer"]), ("recommendations", advised, ["rank"]), ("tiers", s["tiers"], ["tier"]), ("routes", s["routes"], ["key", "rank"])):
            files.append(af.write_lines(df, out / f"{name}.jsonl", by))
        files += _projections(r, s, out, manifest)
        manifest["reward"] = s["reward"].first().asDict()
        manifest["component_means"] = {x.component: x.mean for x in s["component_means"].collect()}
        manifest["totals"] = s["ledger_totals"].first().asDict()
        files.append(af.write_lines(summarize.assumptions(v, vf.KEY, config), out / "assumptions.jsonl", ["key"]))
        manifest["calibration"] = s["calibration"].first().asDict()
        files += _figures(out, v, manifest)
        page = _page(r, s, out)
        (out / "report.html").write_text(page)
        files.append({"path": "report.html", "sha256": af.hashlib.sha256(page.encode()).hexdigest(), "bytes": len(page.encode())})
    manifest["artifacts"] = sorted(files, key=lambda f: f["path"])
    af.write_document(manifest, out / "manifest.json")
    return manifest


def _projections(r: vf.Run, s: dict[str, DataFrame], out: Path, manifest: dict) -> list[dict]:
    """The projections and their index, which says of each what it holds, leaves out, and why."""
    v = r.checked.verdicts
    ids = v.select("key", "record_id", "proposal_id", "status")
    pairs = s["calibration_pairs"].where(F.col("outcome") != "unverifiable").join(ids, "key")
    tables = {
        "scalar_reward": (s["scalar_reward"], ["record_id"]),
        "calibration_pairs": (pairs.where(F.col("status").isin("accepted", "rejected")), ["record_id", "json_pointer"]),
        "violation_table": (r.checked.findings.join(ids.select("key", "record_id", "proposal_id"), "key"), ["record_id", "code", "json_pointer", "level"]),
    }
    if r.repaired is not None:
        tables["preference_pairs"] = (vf.preference_pairs(r.repaired).join(ids.select("key", "record_id", "proposal_id"), "key"), ["record_id", "repair_id"])
    files, index = [], []
    for name, (df, order) in sorted(tables.items()):
        columns, held, left_out, why = PROJECTIONS[name]
        files.append(done := af.write_lines(df.select(*columns), out / f"{name}.jsonl", order))
        index.append({"name": name, "path": done["path"], "rows": done["rows"], "sha256": done["sha256"], "columns": sorted(columns), "eligibility": {"included": held, "excluded": left_out, "reason": why}})
    doc = {"run_id": r.run_id, "taxonomy_version": TAXONOMY_VERSION, "reward_fn_id": manifest["reward_fn_id"], "projections": index, "caveats": caveats(r)}
    return [*files, af.write_document(doc, out / "projections.json")]


def _figures(out: Path, verdicts: DataFrame, manifest: dict) -> list[dict]:
    """Up to FIGURES of a kind for records in scope, each as SVG with its data beside it and linked from the
    manifest. A record has its hull if its system is binary, else its context; records are taken in order until
    there are enough of these and of the routes."""
    inside = verdicts.where(F.col("out_of_scope").isNull() & F.col("reduced").isNotNull()).select("record_id", "reduced", "proposal_id", "candidate_key")
    # Records of one formula have the same figures, so the first records of distinct formulas are enough to choose from.
    first = inside.groupBy("reduced").agg(F.min(F.struct("proposal_id", "candidate_key", "record_id")).alias("r")).orderBy("r.proposal_id", "r.candidate_key").limit(16 * FIGURES).collect()
    files, made, links = [], {"context": 0, "potential": 0, "routes": 0}, []

    def draw(kind: str, fig: dict | None, record: str) -> None:
        if fig is None or made[kind] >= FIGURES:
            return
        made[kind] += 1
        name = f"figure-{fig['kind']}-{sum(x['kind'] == fig['kind'] for x in links) + 1}"
        svg = _svg(f"{fig['kind']} {fig['formula']}", fig["points"], fig["line"])
        files.append(af.write_document({**fig, "record_id": record}, out / f"{name}.json"))
        (out / f"{name}.svg").write_text(svg)
        files.append({"path": f"{name}.svg", "sha256": af.hashlib.sha256(svg.encode()).hexdigest(), "bytes": len(svg.encode())})
        links.append({"record_id": record, "kind": fig["kind"], "path": f"{name}.svg", "data": f"{name}.json"})

    for row in first:
        if made["context"] >= FIGURES and made["routes"] >= FIGURES:
            break
        draw("context", hull_figure(row.reduced) or context_figure(row.reduced), row.r.record_id)
        draw("potential", potential_figure(row.reduced), row.r.record_id)
        draw("routes", route_figure(row.reduced), row.r.record_id)
    manifest["figures"] = links
    return files


def caveats(r: vf.Run) -> list[str]:
    """What the numbers do not say."""
    n = sum(d["entries"] for d in datasets())
    out = [
        f"Novelty is stated against {n} entries of pinned tables, not against the literature.",
        "Hull distances come from tabulated enthalpies at 298 K; entropy is not part of them.",
        "Charge balance looks at common oxidation states only; a miss is a reason to look, not a proof.",
        "Plausible ranges of claimed properties are wide; a value inside one is not confirmed.",
        "Route energies are enthalpies and understate routes that release gas.",
        "A repair shows what scores higher under these checks, not what the proposal meant.",
    ]
    if r.checked is not None and not r.checked.answers.where(F.col("status") == "unavailable").isEmpty():
        out.append("Some providers could not answer; tiers marked unknown are not evidence of absence.")
    return out


def _page(r: vf.Run, s: dict[str, DataFrame], out: Path) -> str:
    figures = "".join(p.read_text() for p in sorted(out.glob("*.svg")))
    both = s["code_by_field"].where(F.col("code").isNotNull() & F.col("json_pointer").isNotNull())
    parts = [
        ("Run", f"<p>{html.escape(r.run_id)}, exit {r.exit_code}</p>"), ("Counts", "<p>" + html.escape(json.dumps(r.counts, sort_keys=True)) + "</p>"), ("Rewards", _table(s["reward"])), ("Codes by field", _table(summarize.top_k(both, "n", ["code", "json_pointer"], 20))),
        ("Novelty", _table(s["tiers"].orderBy("tier"))), ("Recommendations", _table(s["recommendations"].orderBy("rank"))), ("Calibration", _table(s["calibration"])), ("Figures", figures), ("Caveats", "<ul>" + "".join(f"<li>{html.escape(c)}</li>" for c in caveats(r)) + "</ul>"),
    ]
    return '<!doctype html><meta charset="utf-8"><title>Verification report</title>' + "".join(f"<section><h2>{t}</h2>{b}</section>" for t, b in parts)


def verify(spark: SparkSession, folder: str) -> list[str]:
    """Problems of a written run, found from its files alone: digests, schemas, counts, references both ways,
    figures, rewards and gates made again from their components, projections, order, phases, paths and
    addresses. Each is a table of the rows that break it; ok is that all are empty."""
    problems = af.verify_files(folder)
    out = Path(folder)
    if problems and problems[0].startswith("manifest"):
        return problems
    manifest = json.loads((out / "manifest.json").read_text())
    if not (out / "verdicts.jsonl").is_file():
        return [*problems, *(["verdicts are missing"] if manifest["exit_code"] in (0, 4) and (manifest["counts"] or {}).get("admitted") else [])]
    for name, (schema, required) in SCHEMAS.items():
        if (path := out / f"{name}.jsonl").is_file() and not (bad := af.broken_lines(spark, str(path), schema, required)).isEmpty():
            problems.append(f"{name}.jsonl: {bad.first()['why']}")
    v = af.read_lines(spark, str(out / "verdicts.jsonl"), VERDICTS)
    f = af.read_lines(spark, str(out / "findings.jsonl"), FINDINGS)
    counts = manifest["counts"]
    states = {r["status"]: r["n"] for r in v.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts["records_in"] != counts["admitted"] + counts["quarantined"] or counts["admitted"] != sum(states.values()):
        problems.append("counts do not add up")
    problems += [f"{s}: other count in the verdicts" for s in ("accepted", "rejected", "unverifiable") if states.get(s, 0) != counts.get(s, 0)]
    for d in manifest["reference_data"] or [{"id": "reference data"}]:
        if str(d.get("snapshot", "")).lower() in ("", "latest", "none", "null"):
            problems.append(f"{d['id']}: no version")
    broken = {**_broken_records(spark, out, v, f, manifest), **_broken_projections(spark, out, v, manifest, problems)}
    problems += [name for name, rows in broken.items() if not rows.isEmpty()]
    known = {r["record_id"] for r in v.where(F.col("record_id").isin([x["record_id"] for x in manifest["figures"]])).select("record_id").collect()}
    for x in manifest["figures"]:
        if x["record_id"] not in known:
            problems.append(f"{x['path']}: figure of no record")
        problems += [f"{x['path']}: {part} is missing" for part in ("path", "data") if not (out / x.get(part, "-")).is_file()]
    for path in sorted(out.glob("*.json*")):
        if not audit.with_url(spark.read.text(str(path)).withColumn("at", F.lit(path.name)), "at", ["value"]).isEmpty():
            problems.append(f"{path.name}: host path or address")
    if "http" in (out / "report.html").read_text():
        problems.append("report holds an address")
    return problems


def _broken_records(spark: SparkSession, out: Path, v: DataFrame, f: DataFrame, manifest: dict) -> dict[str, DataFrame]:
    """By what is wrong, the verdicts, findings and checks that break it."""
    checks = af.read_lines(spark, str(out / "checks.jsonl"), CHECKS)
    weights, neutral = manifest["config"]["reward"]["weights"], F.col("composition_key").isNull()
    derived = F.when(neutral, 0.0).otherwise(score.weighted({n: F.col(f"value_{n}") for n in weights}, weights))
    told = f.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") == "error").alias("e"))
    both = v.join(told, "record_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "e": F.coalesce("e", F.lit(0))})
    mine = f.select("record_id", F.col("proposal_id").alias("p"), F.col("candidate_key").alias("c")).join(v.select("record_id", "proposal_id", "candidate_key"), "record_id")
    present = checks.where(F.col("phase").isin(*PHASES)).select("record_id", "phase").distinct().groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    order = {"verdicts": (VERDICTS, ["proposal_id", "candidate_key"]), "findings": (FINDINGS, ["proposal_id", "code", "json_pointer", "candidate_key"])}
    return {
        "finding without verdict": audit.orphans(f, v, "record_id", "record_id"),
        "check without verdict": audit.orphans(checks, v, "record_id", "record_id"),
        "finding with another id or key than its verdict": mine.where(~F.col("p").eqNullSafe(F.col("proposal_id")) | ~F.col("c").eqNullSafe(F.col("candidate_key"))),
        "verdict counts other findings": both.where((F.col("n") != F.col("n_findings")) | (F.col("e") != F.col("n_errors"))),
        "verdict of another run": v.where(~F.col("run_id").eqNullSafe(F.lit(manifest["run_id"]))),
        "reward out of range": v.where(~F.coalesce(F.col("reward").between(0, 1), F.lit(False))),
        "reward differs from its components": audit.mismatched(v, F.col("reward"), derived, 1e-5),
        "failed gate with a reward": v.where(neutral & ((F.col("reward") != 0) | (F.col("status") != "rejected"))),
        "accepted with an error": v.where(F.col("status") == "accepted").join(f.where(F.col("level") == "error"), "record_id", "left_semi"),
        "phase without a check": v.join(present.where(F.col("n") == len(PHASES)), "record_id", "left_anti"),
        **{f"{name} are not in order": audit.unordered(af.numbered_lines(spark, str(out / f"{name}.jsonl"), schema), "line", keys) for name, (schema, keys) in order.items()},
    }


def _broken_projections(spark: SparkSession, out: Path, v: DataFrame, manifest: dict, problems: list[str]) -> dict[str, DataFrame]:
    """By what is wrong, the projected rows that break it; what concerns the index goes into problems."""
    index = json.loads((out / "projections.json").read_text())
    if index["run_id"] != manifest["run_id"]:
        problems.append("projections.json: another run")
    broken = {}
    records = v.select("record_id", F.col("status").alias("_status"), F.col("reward").alias("_reward"))
    for p in index["projections"]:
        rows = af.read_lines(spark, str(out / p["path"]), SCHEMAS[p["name"]][0])
        if rows.count() != p["rows"]:
            problems.append(f"{p['path']}: other number of rows")
        if "record_id" not in p["columns"]:
            problems.append(f"{p['path']}: rows without record")
        held = rows.join(records, "record_id", "left")
        broken[f"{p['name']}: row of no record"] = held.where(F.col("_status").isNull())
        broken[f"{p['name']}: row of a record it leaves out"] = held.where(F.col("_status").isin(p["eligibility"]["excluded"]))
        if p["name"] == "scalar_reward":
            broken["scalar_reward: other reward"] = audit.mismatched(held, F.col("reward"), F.col("_reward"))
            broken["scalar_reward: record left out"] = v.where(F.col("status").isin("accepted", "rejected")).join(rows, "record_id", "left_anti")
        if p["name"] == "preference_pairs":
            broken["preference_pairs: no gain or no repair"] = rows.where(F.col("repair_id").isNull() | ~F.coalesce(F.col("chosen_reward") > F.col("rejected_reward"), F.lit(False)))
    return broken


def lineage(folder: str, *, config: dict | None = None, inputs: str | None = None) -> list[tuple[str, str]]:
    """(part, MATCH, DIVERGED or UNKNOWN) of what a run rests on against what is here now: code, versions,
    settings, each reference table, each input file of a file or folder given, and the artifacts themselves."""
    out = Path(folder)
    if not (out / "manifest.json").is_file():
        raise ValueError(f"{folder} holds no run")
    m = json.loads((out / "manifest.json").read_text())
    same = lambda then, now: "UNKNOWN" if then is None or now is None else "MATCH" if then == now else "DIVERGED"
    plain = lambda c: None if c is None else {k: v for k, v in flatten(c) if k not in ("evidence.only", "evidence.offline")}
    commit = af.provenance()["commit"]
    parts = [
        ("config", same(plain(m.get("config")), plain(redact(resolve() if config is None else config)))), ("source", same(m.get("source_sha256"), af.tree_digest(str(Path(__file__).resolve().parents[1])))),
        ("version", same(m.get("version"), __version__)), ("corpora", same(m.get("corpus_fingerprint"), corpus_fingerprint())), ("taxonomy", same(m.get("taxonomy_version"), TAXONOMY_VERSION)), ("commit", same((m.get("provenance") or {}).get("commit"), commit)),
    ]
    now = {d["id"]: d["sha256"] for d in datasets()}
    parts += [(f"corpus {d['id']}", same(d["sha256"], now.get(d["id"]))) for d in m.get("reference_data", [])]
    given = None if inputs is None else Path(inputs)
    for x in m.get("inputs", []):
        path = None if given is None else given if given.is_file() else given / x["name"]
        parts.append((f"input {x['name']}", same(x["sha256"], af.file_digest(path) if path is not None and path.is_file() else None)))
    altered = [a["path"] for a in m.get("artifacts", []) if not (out / a["path"]).is_file() or af.file_digest(out / a["path"]) != a["sha256"]]
    return [*parts, ("artifacts", "DIVERGED" if altered else "MATCH")]


def flatten(value: object, path: str = "") -> list[tuple[str, str]]:
    """(dotted path, value as JSON) of every leaf."""
    if isinstance(value, dict) and value:
        return [x for k in sorted(value) for x in flatten(value[k], f"{path}.{k}" if path else k)]
    return [(path, json.dumps(value, sort_keys=True))]


def config_differences(spark: SparkSession, recorded: dict, current: dict, ignore: tuple[str, ...] = ()) -> DataFrame:
    frame = lambda d: spark.createDataFrame([x for x in flatten(d) if x[0] not in ignore], "path string, value string")
    return crossrun.differences(frame(recorded), frame(current))


def pool(spark: SparkSession, folders: list[str]) -> dict[str, DataFrame]:
    """Written runs together: runs, pooled code rates, trend, life cycle of findings, comparability."""
    if not folders:
        raise ValueError("no runs")
    if missing := [f for f in folders if not (Path(f) / "verdicts.jsonl").is_file()]:
        raise ValueError(f"no finished run in {', '.join(missing)}")
    docs = [json.loads((Path(f) / "manifest.json").read_text()) for f in folders]
    cols = ["run_id", "logical_time", "taxonomy_version", "reward_fn_id", "corpus_fingerprint", "config_sha256", "source_sha256"]
    heads = spark.createDataFrame([tuple(d.get(c) for c in cols) for d in docs], ", ".join(f"{c} string" for c in cols))
    v, f = None, None
    for folder, d in zip(folders, docs):
        vs = af.read_lines(spark, f"{folder}/verdicts.jsonl", VERDICTS).withColumn("run_id", F.lit(d["run_id"]))
        fs = af.read_lines(spark, f"{folder}/findings.jsonl", FINDINGS).withColumn("run_id", F.lit(d["run_id"]))
        v, f = (vs, fs) if v is None else (v.unionByName(vs), f.unionByName(fs))
    n = v.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_records"), F.avg("reward").alias("mean_reward"))
    runs = heads.join(n, "run_id", "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))
    timed = f.join(F.broadcast(heads.select("run_id", F.struct("logical_time", "run_id").alias("run_order"))), "run_id")
    return {
        "runs": runs,
        "code_by_field": crossrun.pooled(f, "run_id", v.count()),
        "rates": crossrun.rates(f, runs, "run_id"),
        "trend": crossrun.trend(f, runs.select("run_id", "logical_time", "n_records"), "run_id"),
        "lifecycle": crossrun.lifecycle(timed, "run_order"),
        "comparability": crossrun.comparability(runs, cols[2:]),
    }


def pooled_page(pooled: dict[str, DataFrame]) -> str:
    """HTML of pooled runs: the runs, what differs between them, the thirty most frequent pairs, the trend."""
    moved = pooled["trend"].orderBy(F.col("change").isNull(), F.desc("change"), "code")
    parts = [("Runs", pooled["runs"].orderBy("logical_time", "run_id")), ("Comparability", pooled["comparability"].orderBy("aspect")), ("Codes by field", summarize.top_k(pooled["code_by_field"], "total_findings", ["code", "json_pointer"], 30)), ("Trend", moved), ("Findings", pooled["lifecycle"].groupBy("state").count().orderBy("state"))]
    return '<!doctype html><meta charset="utf-8"><title>Pooled runs</title>' + "".join(f"<section><h2>{t}</h2>{_table(d, 30)}</section>" for t, d in parts)

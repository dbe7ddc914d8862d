"""Command line: run, verify, lineage, aggregate. Exit codes 0 ok, 1 problems, 2 usage, 3 rejected input, 4 degraded."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orefold")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="verify a batch file or a folder of batches")
    run.add_argument("input")
    run.add_argument("--out", required=True)
    run.add_argument("--config")
    run.add_argument("--seed", type=int, default=0)
    run.add_argument("--now", default="1970-01-01T00:00:00Z")
    run.add_argument("--provider", action="append")
    run.add_argument("--cache", help="folder that keeps what was judged, by content")
    run.add_argument("--seconds", type=float, help="time after which no further part of the records is begun")
    run.add_argument("--corpora", help="folder with a JSON file per provider instead of the built-in corpora")
    run.add_argument("--tables", help="folder that receives the large tables as Parquet besides")
    sub.add_parser("verify").add_argument("run")
    lineage = sub.add_parser("lineage", help="what a run rests on against what is here now")
    lineage.add_argument("run")
    lineage.add_argument("--input", help="the file or folder the run has read")
    agg = sub.add_parser("aggregate", help="pool written runs")
    agg.add_argument("runs", nargs="+")
    agg.add_argument("--out", required=True)
    sub.add_parser("schema", help="print the columns of a proposal")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from orefold.plans import report, verification
    from orefold.reference.config import resolve
    from orefold.schemas import PROPOSAL
    from orefold.session import build_session
    from orefold.sources import corpus_files

    if args.command == "schema":
        print(PROPOSAL)
        return 0
    if args.command == "lineage":
        try:
            states = report.lineage(args.run, inputs=args.input)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        print(json.dumps(dict(states), indent=1))
        return int(any(s == "DIVERGED" for _, s in states))
    spark = build_session()
    if args.command == "verify":
        problems = report.verify(spark, args.run)
        print("\n".join(problems) or "ok")
        return int(bool(problems))
    if args.command == "aggregate":
        try:
            pooled = report.pool(spark, args.runs)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        for name, df in pooled.items():
            df.write.mode("overwrite").parquet(f"{args.out}/{name}")
        Path(args.out, "pooled.html").write_text(report.pooled_page(pooled))
        return 0
    source = Path(args.input)
    if not source.exists() or source.is_dir() and not [*source.glob("*.json")]:
        print(f"no batches in {source}", file=sys.stderr)
        return 2
    try:
        config = resolve(args.config, **({"evidence": {"only": args.provider}} if args.provider else {}))
        sources, entries = corpus_files.load_folder(spark, args.corpora, only=args.provider) if args.corpora else (None, None)
        options = verification.Options(cache=args.cache, seconds=args.seconds, sources=sources, entries=entries)
        r = verification.run(spark, str(source), config=config, seed=args.seed, logical_time=args.now, options=options)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    report.write(r, args.out, config=config, logical_time=args.now, tables=args.tables)
    return r.exit_code


if __name__ == "__main__":
    sys.exit(main())

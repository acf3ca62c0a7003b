"""Command line: ``python cli.py resolve --input entities.jsonl --output clusters.json``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="polynym", description="Entity resolution across languages and scripts.")
    commands = top.add_subparsers(dest="command")
    resolve = commands.add_parser("resolve", help="resolve entity records to clusters")
    resolve.add_argument("--input", required=True, help="JSON lines")
    resolve.add_argument("--output", required=True, help="JSON document")
    for name, default in (("--tier2", 0.85), ("--tier3", 0.82), ("--tier4", 0.75)):
        resolve.add_argument(name, type=float, default=default)
    resolve.add_argument("--force-tfidf", action="store_true", help="use character n-grams in the last tier (the only backend without vectors)")
    resolve.add_argument("-v", "--verbose", action="store_true")
    evaluate = commands.add_parser("evaluate", help="report on labelled title pairs, ROOT/xx_yy/sitelinks.jsonl")
    evaluate.add_argument("--root", required=True, help="folder of language pairs")
    evaluate.add_argument("--output", required=True, help="folder of reports, OUTPUT/xx_yy/REPORT")
    evaluate.add_argument("--pair", nargs=2, action="append", metavar=("L1", "L2"), help="only this pair; may be given again")
    evaluate.add_argument("--force", action="store_true", help="make reports again that are there")
    extract = commands.add_parser("extract", help="title pairs of the knowledge base, written to OUTPUT/xx_yy/sitelinks.jsonl")
    extract.add_argument("--output", required=True, help="folder of language pairs, on any store that Spark writes")
    # The language pairs and rows of each type bucket that are extracted by default.
    extract.add_argument("--pair", nargs=2, action="append", metavar=("L1", "L2"), help="may be given again (default: en de, en zh)")
    extract.add_argument("--n-per-type", type=int, default=100)
    extract.add_argument("--force", action="store_true", help="extract again what is there")
    extract.add_argument("--url", help="another endpoint")
    smoke = commands.add_parser("smoke", help="ask the endpoint for three title pairs")
    smoke.add_argument("--url", help="another endpoint")
    return top


def run_extract(args: argparse.Namespace) -> int:
    from polynym.session import session
    from polynym.sources.entities import read_report
    from polynym.sources.remote import Client, read_sitelinks

    client = Client(query_url=args.url) if args.url else Client()
    for l1, l2 in args.pair or [("en", "de"), ("en", "zh")]:
        target = f"{args.output.rstrip('/')}/{l1}_{l2}/sitelinks.jsonl"
        if not args.force and read_report(session(), target, "qid string") is not None:
            continue
        pairs = read_sitelinks(session(), l1, l2, args.n_per_type, client)
        pairs.orderBy("ord", "rn").drop("ord", "rn").write.mode("overwrite").json(target)
        print(f"Pairs: {target}")
    return 0


def run_smoke(args: argparse.Namespace) -> int:
    from polynym.sources.remote import Client, sitelink_query

    rows = (Client(query_url=args.url) if args.url else Client()).query(sitelink_query("en", "ru", "Q5", 3))
    print(f"{len(rows)} rows")
    for row in rows:
        print(f"  {row.get('l1Title')} | {row.get('l2Title')} | {row.get('entity')}")
    return 0 if rows else 1


def run_evaluate(args: argparse.Namespace) -> int:
    from polynym.plans.evaluation import evaluate
    from polynym.session import session
    from polynym.sources.entities import read_sitelinks
    from polynym.sources.sinks import write_report

    folders = sorted(p.parent for p in Path(args.root).glob("*_*/sitelinks.jsonl"))
    wanted = {"_".join(p) for p in args.pair or []}
    for folder in [f for f in folders if not wanted or f.name in wanted]:
        target = Path(args.output) / folder.name
        if target.exists() and not args.force:
            continue
        l1, _, l2 = folder.name.partition("_")
        for name, report in evaluate(read_sitelinks(session(), str(folder / "sitelinks.jsonl")), l1, l2).items():
            write_report(report, str(target / name))
        print(f"Reports: {target}")
    return 0


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    run = {"evaluate": run_evaluate, "extract": run_extract, "smoke": run_smoke}.get(args.command)
    if run:
        return run(args)
    if args.command != "resolve":
        top.print_help()
        return 0
    if not Path(args.input).exists():
        print(f"Error: input file not found: {args.input}", file=sys.stderr)
        return 1
    from polynym.plans.resolver import Resolver
    from polynym.session import session

    resolver = Resolver(args.tier2, args.tier3, args.tier4, verbose=args.verbose)
    n = resolver.resolve_and_save(session(), args.input, args.output)
    print(f"Clusters: {n} → {args.output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())

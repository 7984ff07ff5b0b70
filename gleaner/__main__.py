"""python -m gleaner STORE COMMAND …: the runs of `gleaner.plans.runs` over a folder of tables."""

from __future__ import annotations

import argparse
import json

from gleaner.plans.runs import Runs
from gleaner.session import get_session
from gleaner.sources.settings import load_profile


def _sources(args) -> dict:
    return {"source_a": args.source_a, "source_b": dict(x.split("=", 1) for x in args.source_b)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gleaner")
    top.add_argument("store", help="folder of the tables")
    top.add_argument("--master", help="Spark master; the session's own if not given")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for flag, options in arguments:
            p.add_argument(flag, **options)
        return p

    sources = (("--source-a", {}), ("--source-b", {"action": "append", "default": [], "metavar": "PORTAL=FOLDER"}))
    out = (("--out", {"default": "digests"}), ("--format", {"choices": ["md", "html"], "default": "md"}))
    command("parse", *sources)
    command("score", ("profile", {"help": "YAML file"}))
    command("digest", ("profile", {"help": "YAML file"}), *out)
    command("daily", ("profiles", {"nargs": "+", "help": "YAML files"}), *sources, *out)
    command("rate", ("profile", {"help": "name"}), ("job", {"type": int}), ("rating", {"type": int, "choices": [1, 0, -1]}), ("--reason", {}), ("--note", {}))
    command("clusters", ("--min-size", {"type": int, "default": 25}))
    command("scrub-raw", ("raw", {}), ("--out", {"help": "without it only what would change is listed"}))
    command("import-reference", ("--taxonomy", {}), ("--places", {"help": "Parquet table"}))
    command("status", ("--raw", {}))
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = get_session("gleaner", args.master)
    runs = Runs(spark, args.store)
    if args.command == "parse":
        print(json.dumps(runs.parse(**_sources(args))))
    elif args.command == "score":
        print(json.dumps(runs.score(load_profile(args.profile))))
    elif args.command == "digest":
        print(runs.digest(load_profile(args.profile).name, args.out, fmt=args.format))
    elif args.command == "daily":
        print("\n".join(runs.daily([load_profile(p) for p in args.profiles], args.out, **_sources(args))))
    elif args.command == "rate":
        runs.rate(args.profile, args.job, args.rating, args.reason, args.note)
    elif args.command == "clusters":
        runs.clusters(min_size=args.min_size).show(50, truncate=False)
    elif args.command == "scrub-raw":
        found = runs.scrub_raw(args.raw, args.out)
        if found is not None:
            found.select("portal", "source_id", "leaks").show(50, truncate=False)
    elif args.command == "import-reference":
        runs.import_reference(taxonomy=args.taxonomy, places=spark.read.parquet(args.places) if args.places else None)
    elif args.command == "status":
        print(json.dumps(runs.status(args.raw), indent=1, default=str))


if __name__ == "__main__":
    main()

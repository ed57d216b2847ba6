"""The command line: `python -m loomtally.cli PATH...`."""

from __future__ import annotations

import argparse
import re
import sys

from loomtally.operators.report import parse_format
from loomtally.sources.config import DEFAULTS, Options, config_path, load_config, write_default_config

VERSION = "0.1.0"


def _jobs(text: str) -> int:
    if (n := int(text)) < 1:
        raise argparse.ArgumentTypeError("at least 1")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomtally", allow_abbrev=False, description="Counts tokens and lines of source trees by language.")
    p.add_argument("paths", nargs="*")
    p.add_argument("-V", "--version", action="version", version=VERSION)
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-m", "--model")
    p.add_argument("-f", "--format")
    p.add_argument("-i", "--ignore", action="append", default=[], help="a directory or language; may be repeated")
    p.add_argument("-e", "--ext", action="append", default=[], help="only this extension; may be repeated")
    p.add_argument("-j", "--jobs", type=_jobs)
    p.add_argument("--init", action="store_true", help="write the default configuration")
    return p


def spelled(argv: list[str]) -> list[str]:
    """-x=VALUE as -xVALUE, up to a lone --."""
    stop = argv.index("--") if "--" in argv else len(argv)
    return [re.sub(r"^-([a-zA-Z])=", r"-\1", a) for a in argv[:stop]] + argv[stop:]


def options(args: argparse.Namespace) -> Options:
    base = load_config() if config_path().exists() else DEFAULTS
    return base.merged(ignore=tuple(args.ignore), exts=tuple(args.ext), model=args.model, format=args.format, partitions=args.jobs, verbose=args.verbose or None)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(spelled(sys.argv[1:] if argv is None else argv))
    if args.init:
        print(write_default_config())
        return 0
    if not args.paths:
        parser().error("a path is needed")
    from loomtally.functions.models import resolve

    chosen = options(args)
    try:
        parse_format(chosen.format)
        if resolve(chosen.model) is None:
            raise ValueError(f"unknown model {chosen.model!r}")
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from loomtally.plans.count import count, diagnostics

    spark = SparkSession.builder.master(f"local[{args.jobs or '*'}]").config("spark.ui.enabled", "false").getOrCreate()
    if chosen.verbose:
        for line in diagnostics(spark, args.paths, chosen):
            print(line, file=sys.stderr)
    out = count(spark, args.paths, chosen)
    print(out, end="") if out else print("no files found", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())

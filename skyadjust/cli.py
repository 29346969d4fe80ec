"""Command line: one command a stage."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from .operators.matching import list_matchers
from .sources import config


def _stages() -> dict[str, tuple[str, Callable]]:
    from .plans import stages as s

    return {
        "run": ("older name of match", s.match), "match": ("match overlapping image pairs", s.match), "build-tracks": ("join matches into tracks", s.build_tracks),
        "triangulate-init": ("make initial points and the adjustment's input", s.triangulate_init), "bundle-adjust": ("adjust images and points", s.bundle_adjust), "run-all": ("all of these in turn", s.run_all),
    }


def main(argv: Sequence[str] | None = None) -> int:
    """Run one command; 0 on success."""
    stages = _stages()
    parser = argparse.ArgumentParser(prog="skyadjust", description="Block adjustment of satellite images on Spark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (text, _) in stages.items():
        commands.add_parser(name, help=text).add_argument("-c", "--config", required=True, help="YAML or JSON file")
    commands.add_parser("list-matchers", help="names of matchers")
    args = parser.parse_args(argv)
    if args.command == "list-matchers":
        print("\n".join(list_matchers()))
        return 0
    from pyspark.sql import SparkSession

    options = config.load(args.config)
    config.set_up_logging(options.logging)
    stages[args.command][1](SparkSession.builder.appName("skyadjust").getOrCreate(), options)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Command line: print a layered config, list stages and queries, run a chain over a table.

``python -m loomtick run base.toml site.toml --set cut.threshold=0.3 --input in --output out``
"""

from __future__ import annotations

import argparse
import sys
import tomllib
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from loomtick.plans import compiler, config, registry
from loomtick.plans.spec import StreamSpec
from loomtick.sources import tables


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomtick", description="timestamped streams on Spark")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("stages", help="names of the stages")
    commands.add_parser("queries", help="names of the registered queries")
    for name, text in (("config", "print the config as it would run"), ("run", "run a chain over a table of (stream_id, pos, pts, value)")):
        sub = commands.add_parser(name, help=text)
        sub.add_argument("files", nargs="+", help="TOML files; later ones win")
        sub.add_argument("--set", action="append", default=[], dest="sets", metavar="KEY=VALUE", help="override one value")
    sub.add_argument("--input", required=True)
    sub.add_argument("--output", required=True)
    sub.add_argument("--format", default="parquet", choices=("parquet", "orc"))
    sub.add_argument("--explain", action="store_true", help="print the plan and stop")
    return top


def _layered(files: list[str], sets: list[str]) -> dict[str, Any]:
    layers = [tomllib.loads(Path(f).read_text(encoding="utf-8")) for f in files]
    return config.checked(config.override(config.merged(*layers), sets))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 on success, 2 if the config is refused; other failures are raised."""
    args = _parser().parse_args(arguments)
    if args.command in ("stages", "queries"):
        print(*(compiler.names() if args.command == "stages" else sorted(registry.queries())), sep="\n")
        return 0
    try:
        chain = _layered(args.files, args.sets)
        compiler.resolve(chain)
    except (config.ConfigError, tomllib.TOMLDecodeError, OSError) as error:
        print(f"loomtick: {error}", file=sys.stderr)
        return 2
    if args.command == "config":
        print(config.dumped(chain), end="")
        return 0
    spark = spark or SparkSession.builder.appName("loomtick").getOrCreate()
    made = compiler.run(chain, compiler.TypedStream(tables.read(spark, args.input, args.format), StreamSpec()))
    if args.explain:
        made.df.explain("formatted")
    else:
        tables.publish({args.output: made.df}, args.format)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""python -m strataline analyze|formats|languages"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from . import analysis
from .sinks import reports


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strataline", description="Metrics and integrations of code graphs, on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("analyze", help="analyse a source tree, an exported graph, or a repository")
    one.add_argument("-p", "--path", help="folder, archive or exported graph")
    one.add_argument("-s", "--solution", help="solution or project file, if there is no path")
    one.add_argument("-r", "--repo", help="URL of a repository to clone, or owner/repo")
    one.add_argument("-f", "--format", default="json", help="json, md, csv or sarif")
    one.add_argument("-o", "--out", "--output", help="file to write; nothing is written if it is left out")
    one.add_argument("-t", "--print", nargs="?", const="true", default="false", help="true: print the report, too")
    one.add_argument("--profile", default="work")
    commands.add_parser("formats", help="report formats")
    commands.add_parser("languages", help="languages with an adapter")
    args = parser.parse_args(argv)
    if args.command == "formats":
        print("\n".join(sorted(reports.WRITERS)))
        return 0
    if args.command == "languages":
        print("\n".join(sorted(analysis.LANGUAGES)))
        return 0
    name = {"": "json", "serif": "sarif"}.get(args.format.strip().lower(), args.format)
    writer = reports.resolve(name)
    spark = SparkSession.builder.appName("strataline").getOrCreate()
    text = writer(analysis.analyze(spark, args.path or args.solution, args.repo, args.profile))
    if args.print.strip().lower() in ("true", "1", "yes", "y"):
        sys.stdout.write(text)
    if args.out:
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(text)
        print(f"Report generated: {os.path.abspath(args.out)}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())

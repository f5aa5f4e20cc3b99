"""Command line over folders of records and artifacts (K6): compile, verify, inspect, diff, redact, archive, head.

Results are JSON lines on the standard output or Parquet folders. Exit codes: 0 all is well, 2
the input can't be used, 3 something does not verify, 4 a target was missed. What is printed
is one row per history; a job over very many of them should write folders instead.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.tables import settle
from .operators import archive, artifact, redact, report, select
from .plans.compile import compile_histories, replay
from .sources import records as source

OK, INPUT, UNVERIFIED, MISSED = 0, 2, 3, 4


def _show(rows: DataFrame) -> None:
    for line in rows.toJSON().toLocalIterator():
        print(line)


def _artifacts(spark: SparkSession, path: str) -> DataFrame:
    return artifact.load(spark.read.parquet(path))


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    read = lambda path: source.read_json(spark, path)
    if args.command == "compile":
        policy = select.Policy(token_budget=args.budget, minimum_ratio=args.ratio)
        done = compile_histories(read(args.records), policy)
        artifact.build(done.items, done.selection, done.summary, done.records, args.active_only).write.parquet(args.out)
        if args.prompts:
            done.prompts().write.parquet(args.prompts)
        _show(done.summary)
        if not done.summary.where("not passed").isEmpty():
            return UNVERIFIED
        return MISSED if args.require_target and not done.selection.where("not target_met").isEmpty() else OK
    if args.command == "verify":
        found = settle(replay(_artifacts(spark, args.artifacts), read(args.records)))
        _show(found)
        return OK if found.isEmpty() else UNVERIFIED
    if args.command == "inspect":
        _show(report.inspect(artifact.items_of(_artifacts(spark, args.artifacts)), args.items))
        return OK
    if args.command == "diff":
        before, after = (artifact.items_of(_artifacts(spark, p)) for p in (args.before, args.after))
        _show(report.diff(before, after).where("change <> 'shared'"))
        return OK
    if args.command == "redact":
        rows = read(args.records)
        masked = redact.redact(rows, args.mask)
        source.write_json(masked.select(*rows.columns), args.out)
        _show(redact.report(redact.findings(masked)))
        return OK
    if args.command == "archive":
        archive.archived(read(args.records)).write.parquet(args.out)
        return OK
    table = spark.read.parquet(args.archive)
    found = settle(archive.verify(table))
    _show(found)
    _show(table.groupBy("history_id").agg(F.max_by("entry", "position").alias("head")))
    return OK if found.isEmpty() else UNVERIFIED


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="spanledger")
    commands = out.add_subparsers(dest="command", required=True)

    def add(name: str, *paths: str) -> argparse.ArgumentParser:
        command = commands.add_parser(name)
        for path in paths:
            command.add_argument(path)
        return command

    one = add("compile", "records", "out")
    one.add_argument("--budget", type=int, default=4000)
    one.add_argument("--ratio", type=float, default=5.0)
    one.add_argument("--prompts")
    one.add_argument("--active-only", action="store_true")
    one.add_argument("--require-target", action="store_true")
    add("verify", "artifacts", "records")
    add("inspect", "artifacts").add_argument("--items", type=int, default=50)
    add("diff", "before", "after")
    add("redact", "records", "out").add_argument("--mask", choices=["*", "#", "█", "■"], default="*")
    add("archive", "records", "out")
    add("head", "archive")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(spark or SparkSession.builder.appName("spanledger").getOrCreate(), args)
    except (PySparkException, ValueError) as error:
        print(str(error).splitlines()[0], file=sys.stderr)
        return INPUT


if __name__ == "__main__":
    sys.exit(main())

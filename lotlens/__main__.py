"""Command line: ``python -m lotlens run-payload|report|query ...``; figures go to standard output."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lotlens", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run-payload", help="a captured payload to layered outputs; exit 1 unless all rows may be priced")
    for name in ("source", "path", "out", "capture-date", "run-id", "city", "state"):
        run.add_argument(f"--{name}", required=True)
    run.add_argument("--captured-at", default="")
    run.add_argument("--as-of-year", type=int, required=True)
    check = commands.add_parser("validate-payload", help="only the payload's contract")
    check.add_argument("--source", required=True)
    check.add_argument("--path", required=True)
    report = commands.add_parser("report", help="field profile and reasons of evaluated rows")
    report.add_argument("--evaluated", required=True)
    diff = commands.add_parser("snapshot-diff", help="totals of two entity tables")
    diff.add_argument("--current", required=True)
    diff.add_argument("--previous")
    query = commands.add_parser("query", help="a registered query over a folder of tables")
    query.add_argument("name")
    query.add_argument("sf_dir")
    query.add_argument("--out", help="write the whole result there as Parquet instead of showing its first rows")
    query.add_argument("--rows", type=int, default=50)
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    from .functions import vocabulary as V
    from .operators import adapters, lifecycle, quality
    from .plans import cases, catalogue, more, packages  # noqa: F401  (cases and more register their queries)
    from .sources import payloads, sinks

    spark = SparkSession.builder.appName("lotlens").getOrCreate()
    if args.command == "run-payload":
        about = adapters.Run(args.captured_at or f"{args.capture_date}T00:00:00Z", args.run_id, args.city, args.state)
        paths = packages.run_payload(spark, args.path, args.source, about, args.as_of_year, args.out, args.capture_date)
        summary = spark.read.json(paths["summary"])
        print(sinks.small_document(summary))
        return 0 if summary.first()["run_ready"] else 1
    if args.command == "validate-payload":
        print(payloads.checked_payload(spark, args.path, args.source).count(), "records")
    elif args.command == "report":
        rows = spark.read.parquet(args.evaluated)
        groups = {"required": [f for fs, _ in V.REQUIRED_GROUPS for f in fs], "high_value": list(V.HIGH_VALUE_FIELDS), "optional": list(V.OPTIONAL_FIELDS)}
        print(sinks.markdown_table(quality.field_profile(rows, groups), "Fields", sum(map(len, groups.values()))))
        print(sinks.markdown_table(quality.histogram(rows, "reasons"), "Reasons"))
    elif args.command == "snapshot-diff":
        before = spark.read.parquet(args.previous) if args.previous else None
        print(sinks.small_document(lifecycle.diff_totals(lifecycle.snapshot_diff(spark.read.parquet(args.current), before))))
    else:
        result = catalogue.QUERIES[args.name](spark, args.sf_dir)
        if args.out:
            result.write.parquet(args.out)
        else:
            print(sinks.markdown_table(result, args.name, args.rows))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

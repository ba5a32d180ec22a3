"""Command line: python -m tidewave.cli batch-extract FOLDER OUT | extract FILE | gold-scorecard | validate FILE REFERENCE |
list-features [--format markdown] | doctor"""

from __future__ import annotations

import argparse
import importlib.util
import json
import os
import sys


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tidewave").getOrCreate()


def put(text: str, output: str | None) -> None:
    """Print, or write to a file."""
    if output is None:
        print(text)
        return
    os.makedirs(os.path.dirname(os.path.abspath(output)), exist_ok=True)
    with open(output, "w", encoding="utf-8") as f:
        f.write(text + "\n")


def batch_extract(args: argparse.Namespace) -> int:
    from tidewave.plans.batch import extract_folder
    from tidewave.sources.files import write_csv, write_json

    rows, errors = extract_folder(session(), args.folder, args.sample_rate, args.frame_length, args.hop_length)
    failed = errors.limit(20).collect()
    for r in failed:
        print(f"{r.path}: {r.error}", file=sys.stderr)
    if failed and args.fail_on_error:
        return 1
    try:
        (write_json if args.format == "json" else write_csv)(rows, args.out)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def extract(args: argparse.Namespace) -> int:
    """The feature row of one file, as JSON."""
    from tidewave.plans.batch import extract_folder

    rows, errors = extract_folder(session(), args.file, args.sample_rate, args.frame_length, args.hop_length)
    failed = errors.limit(1).collect()
    if failed:
        print(f"{failed[0].path}: {failed[0].error}", file=sys.stderr)
        return 1
    for line in rows.toJSON().take(1):
        put(line, args.output)
    return 0


def gold_scorecard(args: argparse.Namespace) -> int:
    from tidewave.plans import scorecard

    found = scorecard.checks(session(), args.sample_rate, args.frame_length, args.hop_length, not args.no_optional).cache()
    total = scorecard.summary(found).first()
    rows = found.collect()
    if args.output:
        put(json.dumps({**total.asDict(), "checks": [r.asDict() for r in rows]}, indent=2), args.output)
    for r in rows:
        print(f"{r.name}: {'passed' if r.passed else 'failed'} (error {r.error if r.error is None else format(r.error, '.6g')}, tolerance {r.tolerance:g})")
    print(f"score {total.score:.1f} of 100")
    return int(total.score < args.min_score or (args.fail_on_any and not total.passed))


def validate(args: argparse.Namespace) -> int:
    """Pitch and formants of a file against a reference file."""
    from tidewave.plans import report
    from tidewave.plans.batch import folder_signals

    spark = session()
    signals = folder_signals(spark, args.file, args.sample_rate)[0].drop("path")
    checks = report.compare_with_reference(signals, report.load_reference(spark, args.reference), args.sample_rate, args.frame_length, args.hop_length, args.profile).collect()
    for r in checks:
        print(f"{r.metric}: {'skipped' if r.skipped else 'passed' if r.passed else 'failed'} (error {r.error}, tolerance {r.tolerance})")
    if args.output:
        put(json.dumps({"passed": all(r.passed for r in checks), "checks": [r.asDict() for r in checks]}, indent=2), args.output)
    return int(not checks or (args.fail_on_tolerance and not all(r.passed for r in checks)))


def list_features(args: argparse.Namespace) -> int:
    from tidewave.plans import catalog

    found = catalog.build_catalog(session())
    if args.format == "table":
        found.show(1000, truncate=False)
    else:
        put(catalog.to_markdown(found) if args.format == "markdown" else json.dumps([r.asDict() for r in found.orderBy("component", "name").collect()], indent=2), args.output)
    return 0


def doctor(_: argparse.Namespace) -> int:
    needed = ("pyspark", "numpy", "pandas", "pyarrow")
    for name in needed:
        print(f"{name}: {'found' if importlib.util.find_spec(name) else 'missing'}")
    return int(not all(map(importlib.util.find_spec, needed)))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewave")
    verbs = p.add_subparsers(required=True)
    b = verbs.add_parser("batch-extract", help="feature rows of a folder of audio files")
    b.add_argument("folder"), b.add_argument("out")
    b.add_argument("--sample-rate", type=int, default=22050), b.add_argument("--frame-length", type=int, default=2048), b.add_argument("--hop-length", type=int, default=512)
    b.add_argument("--format", choices=("csv", "json"), default="csv"), b.add_argument("--fail-on-error", action="store_true")
    b.set_defaults(run=batch_extract)
    e = verbs.add_parser("extract", help="the feature row of one audio file")
    e.add_argument("file")
    e.set_defaults(run=extract)
    g = verbs.add_parser("gold-scorecard", help="operators against signals whose features are known")
    g.add_argument("--min-score", type=float, default=95.0)
    g.add_argument("--no-optional", action="store_true"), g.add_argument("--fail-on-any", action="store_true")
    g.set_defaults(run=gold_scorecard)
    v = verbs.add_parser("validate", help="pitch and formants of a file against a reference file")
    v.add_argument("file"), v.add_argument("reference"), v.add_argument("--profile", default="neutral")
    v.add_argument("--fail-on-tolerance", action="store_true")
    v.set_defaults(run=validate)
    for verb, n, hop in ((e, 2048, 512), (g, 1024, 256), (v, 2048, 512)):
        verb.add_argument("--sample-rate", type=int, default=22050), verb.add_argument("--frame-length", type=int, default=n), verb.add_argument("--hop-length", type=int, default=hop)
    f = verbs.add_parser("list-features", help="the catalogue of operators")
    f.add_argument("--format", choices=("table", "markdown", "json"), default="table")
    f.set_defaults(run=list_features)
    for verb in (e, g, v, f):
        verb.add_argument("--output", help="a file to write to")
    verbs.add_parser("doctor", help="whether the libraries are there").set_defaults(run=doctor)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())

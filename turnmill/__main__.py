"""``python -m turnmill extract|anonymize|convert``: the file-to-file jobs on a session of their own."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="turnmill")
    sub = p.add_subparsers(dest="job", required=True)
    e = sub.add_parser("extract", help="sessions of a provider's local stores")
    e.add_argument("provider", choices=["claude", "codex", "cursor", "hermes", "pi"])
    e.add_argument("--out", required=True)
    e.add_argument("--sessions-dir", action="append")
    e.add_argument("--model")
    e.add_argument("--anonymize", action="store_true")
    a = sub.add_parser("anonymize", help="scrub people and secrets")
    a.add_argument("source")
    a.add_argument("--out", help="in place without it")
    c = sub.add_parser("convert", help="training rows as JSONL")
    c.add_argument("source")
    c.add_argument("--out", required=True)
    c.add_argument("--keep-incomplete", action="store_true")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("turnmill").getOrCreate()
    from .api import anonymize_folder, convert_traces, extract, write_rows
    from .ship import ship
    from .sources.jsonl import trainable

    ship(spark)
    if args.job == "extract":
        done = extract(spark, args.provider, args.out, args.sessions_dir, model=args.model, anonymize=args.anonymize)
        print(json.dumps({"files": done.files, "sources": done.sources, "replaced": done.replaced}))
    elif args.job == "anonymize":
        print(json.dumps(anonymize_folder(spark, args.source, args.out)))
    else:
        write_rows(trainable(convert_traces(spark, args.source, skip_invalid_lines=True), not args.keep_incomplete), args.out)


if __name__ == "__main__":
    main()

"""Command line: list, run or explain a registered query.

    python -m quillrank list
    python -m quillrank run feature_means --data /path/to/tables [--out PATH --format parquet] [--show 20]
    python -m quillrank explain dedup_pages --data /path/to/tables

Under spark-submit the master and resources come from the submit configuration;
``--master`` only matters for local runs.
"""

from __future__ import annotations

import argparse
import sys


def _first_line(fn) -> str:
    doc = (fn.__doc__ or "").strip().splitlines()
    return doc[0] if doc else ""


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="quillrank")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="registered queries")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("--data", required=True, help="folder holding <table>.parquet")
        p.add_argument("--master", default=None)
        if name == "run":
            p.add_argument("--out", default=None, help="write the result here (overwrite)")
            p.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
            p.add_argument("--show", type=int, default=20)
    args = ap.parse_args(argv)

    from quillrank.plans import load_all
    reg = load_all()
    if args.cmd == "list":
        for name in sorted(reg.QUERIES):
            tag = "oracle" if name in reg.ORACLE else "rows"
            print(f"{name:28s} {tag:6s} {_first_line(reg.QUERIES[name])}")
        return 0
    if args.query not in reg.QUERIES:
        print(f"unknown query {args.query!r}; see `python -m quillrank list`", file=sys.stderr)
        return 2

    from quillrank.session import get_spark
    spark = get_spark(args.master)
    df = reg.QUERIES[args.query](spark, args.data)
    if args.cmd == "explain":
        df.explain("formatted")
    elif args.out:
        writer = df.write.mode("overwrite")
        if args.format == "csv":
            writer = writer.option("header", True)
        getattr(writer, args.format)(args.out)
    else:
        df.show(args.show, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())

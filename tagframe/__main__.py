"""Command line: list, run or explain registered queries.

    python -m tagframe list
    python -m tagframe run tag_xml --tables /root/testdata/sf0.1 --out /data/tagged --format parquet
    python -m tagframe explain tag_xml --tables /root/testdata/sf0.01
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tagframe")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="registered queries (S = SQL oracle, R = rows-only)")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("--tables", required=True, help="folder with <table>.parquet files")
        if name == "run":
            p.add_argument("--out", help="output folder; without it the rows are counted only")
            p.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
        p.add_argument("--master", default=None)
    args = ap.parse_args(argv)

    from tagframe.plans import catalog, oracle
    if args.cmd == "list":
        sql = oracle.oracle_sql()
        for q in catalog.REGISTRY:
            print(f"{'S' if q in sql else 'R'} {q}")
        return 0
    if args.query not in catalog.REGISTRY:
        print(f"unknown query {args.query!r}; see `python -m tagframe list`", file=sys.stderr)
        return 2
    from tagframe.session import get_spark
    from tagframe.sources import files
    spark = get_spark(master=args.master)
    df = catalog.REGISTRY[args.query](spark, args.tables)
    if args.cmd == "explain":
        df.explain("formatted")
    elif args.out:
        files.write_table(df, args.out, fmt=args.format)
        print(f"wrote {args.query} to {args.out}")
    else:
        print(f"{args.query}: {df.count()} rows")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Command line: ``python -m quarry <profile|pages> ...``.

    python -m quarry profile REPORT.csv OUT_DIR [--encoding auto] [--header-row 1]
    python -m quarry pages PAGES.parquet OUT_DIR
"""

from __future__ import annotations

import argparse

from quarry.session import get_session


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="quarry")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("profile", help="infer column types and consistency of report CSV files")
    p.add_argument("path")
    p.add_argument("out")
    p.add_argument("--encoding", default="auto")
    p.add_argument("--header-row", type=int, default=1)
    g = sub.add_parser("pages", help="selector table of pages(page_id, url, html) stored as Parquet")
    g.add_argument("path")
    g.add_argument("out")
    a = ap.parse_args(argv)

    from quarry.plans import flows
    spark = get_session()
    if a.cmd == "profile":
        res = flows.profile_report(spark, a.path, a.out, a.encoding, a.header_row)
        res["schema"].show(truncate=False)
        res["profile"].show()
    else:
        res = flows.analyze_pages(spark, spark.read.parquet(a.path), a.out)
        print(f"selectors written to {a.out}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

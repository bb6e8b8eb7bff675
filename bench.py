"""Benchmark the headline queries.

Runs each query over the whole tables in ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and forces full execution
with the ``noop`` sink (no collection to the driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.session import get_session  # noqa: E402

HEADLINE = [
    "schema_table",          # T1-T7 on orders rendered as a report
    "type_census",           # T on all of lineitem (11 columns)
    "table_profile",
    "sensitive_scan",        # D1 over all documents
    "sensitive_summary",
    "list_items",
    "sections",
    "page_summary",          # H1 parse + H2 over all pages
    "links",
    "selector_table",        # H1 + H13 + H16/H18 + H27 over rendered pages
    "css_selector",
    "results_load",          # S4 + A1
    "category_rollup",
    "registry_lookup",
    "read_report_csv",       # S1 round trip through landed CSV files
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", int(cpus))
    from quarry.plans.catalog import QUERIES

    keys = sys.argv[1:] or HEADLINE
    # Warm-up on the smallest scale (JIT, Python workers), not timed.
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        for k in ("schema_table", "page_summary"):
            QUERIES[k](spark, warm).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for k in keys:
        t0 = time.time()
        try:
            QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[k] = round(time.time() - t0, 3)
        except Exception as ex:  # noqa: BLE001 - report and keep measuring the rest
            errors[k] = f"{type(ex).__name__}: {str(ex)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()

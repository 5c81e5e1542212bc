"""Summarise the physical plans of the headline queries: exchanges by kind,
scans and what reaches them.  usage: python scripts/plan_report.py [sf_dir]"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridcast.queries import QUERIES  # noqa: E402
from gridcast.session import build_session  # noqa: E402

NAMES = ["build_features", "build_features_time", "regularize", "quality_report", "interpolate_gaps",
         "walk_forward_folds", "evaluate_models", "leaderboard", "residual_histogram", "make_sequences",
         "recent_window", "head_sample", "forecast_linear", "cold_start_features", "holiday_join", "read_load"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    print("| query | hash exchanges | broadcast exchanges | single-partition exchanges | parquet scans | windows |")
    print("|---|---|---|---|---|---|")
    scans = {}
    for n in NAMES:
        p = QUERIES[n](spark, sf)._jdf.queryExecution().executedPlan().toString()
        print(f"| `{n}` | {len(re.findall(r'Exchange hashpartitioning', p))} | {p.count('BroadcastExchange')} | "
              f"{p.count('SinglePartition')} | {len(re.findall(r'FileScan parquet', p))} | {len(re.findall(r' Window ', p))} |")
        for line in p.splitlines():
            if "FileScan parquet" in line:
                cols = re.search(r"FileScan parquet \[([^\]]*)\]", line)
                pf = re.search(r"PushedFilters: \[([^\]]*)\]", line)
                key = (cols.group(1) if cols else "?", pf.group(1) if pf else "")
                scans.setdefault(key, set()).add(n)
    print("\n| columns read | pushed filters | queries |")
    print("|---|---|---|")
    for (cols, pf), qs in sorted(scans.items()):
        cols = re.sub(r"#\d+", "", cols)
        print(f"| {cols} | {pf} | {', '.join(sorted(qs))} |")
    spark.stop()


if __name__ == "__main__":
    main()

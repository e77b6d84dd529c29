"""Summarise the physical plans of the headline queries (no execution).

usage: python tools/plan_summary.py [sf_dir] > table.md
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from gradeframe.plans import catalog  # noqa: E402
from gradeframe.session import get_session  # noqa: E402


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summarise(text: str) -> dict:
    tree = text.split("\n\n")[0]
    count = lambda pat: len(re.findall(pat, tree))
    scans = re.findall(r"\(\d+\) Scan parquet[^\n]*\n(?:[^\n]+\n)*?ReadSchema: ([^\n]+)", text)
    pushed = len(re.findall(r"PushedFilters: \[[^\]]+\]", text))
    return {"shuffles": count(r"\bExchange \("),
            "broadcasts": count(r"BroadcastExchange \("), "smj": count(r"SortMergeJoin"),
            "windows": count(r"\bWindow \("), "sort_aggs": count(r"SortAggregate \("),
            "scans": len(scans), "scans_with_pushed_filters": pushed,
            "widest_scan_cols": max((s.count(":") for s in scans), default=0)}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", 16)
    cols = ["shuffles", "broadcasts", "smj", "windows", "sort_aggs", "scans",
            "scans_with_pushed_filters", "widest_scan_cols"]
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for name in HEADLINE:
        s = summarise(plan_text(catalog.QUERIES[name](spark, sf)))
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")


if __name__ == "__main__":
    main()

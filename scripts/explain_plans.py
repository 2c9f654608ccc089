"""Summarise the physical plan of every registered query into PLANS.md.

    python scripts/explain_plans.py [sf_dir] > PLANS.md

Plans are taken with AQE off, so the physical plan (with its whole-stage
codegen markers) is printed without running the query; AQE only coalesces
or re-plans shuffles at run time.  The flagship's formatted plan is appended.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logpipe.plans.catalog import QUERIES  # noqa: E402
from logpipe.session import get_spark  # noqa: E402


def final_plan(df) -> str:
    qe = df._jdf.queryExecution()
    return qe.executedPlan().toString()


def summary(plan: str) -> dict:
    exchanges = re.findall(r"Exchange (\w+)", plan)
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    return {
        "exchanges": ", ".join(sorted(set(exchanges))) or "none",
        "n_exchanges": len(exchanges),
        "generate": plan.count("Generate inline"),
        "codegen_ops": len(re.findall(r"\*\(\d+\)", plan)),
        "read": "; ".join(sorted(set(s.replace("struct<", "") for s in scans))),
        "broadcast": "yes" if "BroadcastExchange" in plan else "no",
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `scripts/explain_plans.py` on `{sf_dir}` (local[8], AQE off to show codegen).")
    print("`O5_webhook` reads the events it has rendered once; up to 50,000 rows are one range of its key.\n")
    print("| Query | Exchanges | # | Parse stages (Generate) | Codegen'd operators | Broadcast | Scan columns |")
    print("|---|---|---|---|---|---|---|")
    flagship = None
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        plan = final_plan(df)
        s = summary(plan)
        print(f"| {name} | {s['exchanges']} | {s['n_exchanges']} | {s['generate']} | {s['codegen_ops']} | "
              f"{s['broadcast']} | {s['read']} |")
        if name == "C1_pipeline":
            flagship = df
    if flagship is not None:
        print("\n## Flagship (`C1_pipeline`) formatted plan\n")
        print("```")
        flagship.explain("formatted")
        print("```")


if __name__ == "__main__":
    main()

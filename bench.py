"""Benchmark the headline queries; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The tables come as single files, which are one split each, so they are first
written BENCH_COPIES times (default 8, ids shifted) into a scratch folder, in
two files a core.  Each query is executed completely through Spark's ``noop``
sink (every row is produced, nothing is collected); its time is the median of
BENCH_REPEAT runs (default 3), plan building included.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from logpipe.plans.catalog import QUERIES  # noqa: E402
from logpipe.session import get_spark  # noqa: E402

HEADLINE = [
    "P2_json", "P6_rfc5424", "P7_rfc3164", "P8_access", "P9_error", "P11_auto",
    "S4_normalise", "F2_exclude", "T3_rename", "A1_stats", "A2_throughput",
    "O3_bulk", "O5_webhook", "C1_pipeline",
]
# queries that read one line per event
EVENT_LINE_QUERIES = {"P2_json", "P6_rfc5424", "P7_rfc3164", "P8_access", "P9_error", "P11_auto",
                      "T3_rename", "A2_throughput", "O3_bulk", "O5_webhook", "C1_pipeline"}
IDS = {"events": "event_id", "documents": "doc_id"}


def replicate(spark, sf_dir: str, copies: int, files: int) -> str:
    """The tables that the headline queries read, ``copies`` times over, in ``files`` files each."""
    out = tempfile.mkdtemp(prefix="logpipe-bench-")
    for table, key in IDS.items():
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        span = (df.agg(F.max(key)).first()[0] or 0) + 1
        many = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        many = many.withColumn(key, F.col(key) + F.col("_copy") * F.lit(span)).drop("_copy")
        many.repartition(files).write.parquet(f"{out}/{table}.parquet")
    return out


def run_once(spark, name, sf_dir) -> float:
    t0 = time.perf_counter()  # building may run jobs too (quantiles)
    df = QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    given = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    copies = int(os.environ.get("BENCH_COPIES", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    extra = {"spark.driver.memory": os.environ.get("BENCH_MEM", "16g")}
    if "BENCH_JAVA_OPTS" in os.environ:
        extra["spark.driver.extraJavaOptions"] = os.environ["BENCH_JAVA_OPTS"]
    spark = get_spark(f"local[{cpus}]", "logpipe-bench", shuffle_partitions=cpus, extra_conf=extra)
    spark.sparkContext.setLogLevel("ERROR")
    m = re.search(r"sf([0-9.]+)", given)
    sf_dir = replicate(spark, given, copies, 2 * cpus)
    n_events = spark.read.parquet(f"{sf_dir}/events.parquet").count()

    run_once(spark, only[0], sf_dir)  # JVM / codegen warm-up
    times, spread = {}, {}
    for name in only:
        runs = sorted(run_once(spark, name, sf_dir) for _ in range(repeat))
        times[name] = round(statistics.median(runs), 3)
        spread[name] = round(runs[-1] - runs[0], 3)
    rates = {k: round(n_events / v / cpus) for k, v in times.items() if k in EVENT_LINE_QUERIES and v > 0}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else None, "cpus": cpus,
                      "copies": copies, "event_lines": n_events, "spread": spread,
                      "lines_per_sec_per_core": rates}))
    spark.stop()


if __name__ == "__main__":
    main()

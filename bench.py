"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is timed end to end (plan + run) with a full write to a no-op
sink, so every row is produced but nothing is collected to the driver.
One untimed warm-up pass (table scans, an aggregation, a join) runs first so
JVM start-up and JIT compilation are not charged to whichever query is first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def warm_up(spark, sf_dir: str) -> None:
    from pyspark.sql import functions as F
    from affinity.sources.fixtures import load
    t = load(spark, sf_dir)
    for name in ("customer", "part", "orders", "lineitem", "events", "embeddings"):
        t.raw(name).write.format("noop").mode("overwrite").save()
    (t.log.groupBy("user_id", "item_id").agg(F.sum("rating"), F.max("ts"))
     .join(t.users, "user_id").write.format("noop").mode("overwrite").save())


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from affinity.session import build_session
    from affinity import bench_queries as bq

    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    warm_up(spark, sf_dir)
    timings = {}
    rows = {}
    for name, fn in bq.HEADLINE.items():
        t0 = time.time()
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - t0, 3)
        rows[name] = None
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(timings.values()), 3), "unit": "sec",
           "queries": timings, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()

"""Times every registered query once and prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_ONLY are read from the environment."""

from __future__ import annotations

import json
import os
import time

from tracemill.plans import load
from tracemill.session import build_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [w for w in os.environ.get("BENCH_ONLY", "").split(",") if w]
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: q for n, q in load().QUERIES.items() if not only or any(w in n for w in only)}
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name, query in queries.items():
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    sf = float(os.path.basename(sf_dir.rstrip("/")).replace("sf", "") or 0)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()

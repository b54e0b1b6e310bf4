"""Time the registered queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
cores; BENCH_QUERIES restricts the run to a comma-separated list. Each query runs to a sink
that discards its rows, after one small query that starts the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pvseries.queries import QUERIES  # noqa: E402
from pvseries.session import local_session  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = chosen.split(",") if chosen else list(QUERIES)
    spark = local_session(cpus, "pvseries-bench")
    QUERIES["diurnal_profile"](spark, folder).count()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(folder).name, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()

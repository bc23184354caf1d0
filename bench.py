"""Time the registered queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_ROUNDS``
the timed rounds after one warm-up (the median counts). Arguments pick queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from lakemart.plans import registered
from lakemart.session import cores_from_environment, local_session


def seconds(query, spark, folder: str) -> float:
    begun = time.perf_counter()
    query.run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = cores_from_environment(os.cpu_count() or 4)
    rounds = int(os.environ.get("BENCH_ROUNDS", "2"))
    spark = local_session(cores, partitions=cores)
    spark.sparkContext.setLogLevel("OFF")
    queries = registered()
    names = sys.argv[1:] or list(queries)
    for name in names:
        seconds(queries[name], spark, folder)
    timed = {
        name: round(statistics.median(seconds(queries[name], spark, folder) for _ in range(rounds)), 3)
        for name in names
    }
    print(
        json.dumps(
            {
                "metric": "total of all queries",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

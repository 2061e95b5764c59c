"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import tempfile
import time
from statistics import median

from plumbline.plans import registry
from plumbline.session import build

NAMES = ["cmp_key_cells", "cmp_key_summary", "cmp_dup_summary", "cmp_multiset_summary", "cmp_value_gaps", "cmp_near_match", "prof_stats", "prof_hist", "obs_outliers", "obs_shapes", "key_uniqueness", "key_islands", "key_search", "sniff_counts", "prof_stats_lines", "obs_outliers_lines", "key_search_pair"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(f"local[{cpus}]", {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.local.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
    spark.sparkContext.setLogLevel("ERROR")
    took, queries = {}, registry.queries()
    for name in NAMES:
        runs = []
        for _ in range(3):  # the first run warms up
            t = time.time()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        took[name] = round(median(runs[1:]), 3)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()

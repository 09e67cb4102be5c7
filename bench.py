"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The headline queries include the writing of their layouts. The point of bucketing are later joins of layouts that are
there: `*_read` joins them, `plain_*` is the join of the same tables by shuffling, with broadcasts off, also for keys with
Zipf skew. Each is run once to warm up, then RUNS times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ["join_inner_plain", "smb_join_fixed", "smb_join_coalesced", "smb_join_gcd", "smb_cogroup", "bucket_histogram", "num_buckets", "shards_by_size"]
RUNS = 3
ZIPF = (1.1, 1.4)


def main() -> None:
    from pyspark.sql import SparkSession

    from bucketloom.operators import bucketing, joins
    from bucketloom.plans import catalogue
    from bucketloom.sources import datagen
    from bucketloom.sources.layout import drop_catalogue
    from bucketloom.sources.workspace import fresh_path

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}

    def timed(name: str, make) -> None:
        took = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took[1:]), 3)

    for name in HEADLINE:
        timed(name, lambda: catalogue.QUERIES[name](spark, sf))  # noqa: B023
        drop_catalogue(spark)
    headline = sum(times.values())

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    a, b = catalogue.lineitem(spark, sf), catalogue.orders(spark, sf)
    timed("plain_join_no_broadcast", lambda: joins.plain_join(a, b, "l_orderkey", "o_orderkey"))
    x, y = joins.write_catalogue(a, "l_orderkey", 8), joins.write_catalogue(b, "o_orderkey", 8)
    timed("bucketed_join_read_only", lambda: x.join(y.hint("merge"), x["l_orderkey"] == y["o_orderkey"]))
    m, n = bucketing.write_fixed(a, "l_orderkey", 12), bucketing.write_fixed(b, "o_orderkey", 8)
    timed("gcd_join_read_only", lambda: joins.congruent_join(spark, m, n))
    # the same number of rows with skewed keys, layouts sharded by size
    count, space = a.count(), 10 * b.count()
    keys_at = fresh_path(spark, "bench-keys")
    datagen.keys(spark, space).write.parquet(keys_at)
    keys = spark.read.parquet(keys_at).withColumnRenamed("id", "k_id")
    for s in ZIPF:
        at = fresh_path(spark, "bench-events")
        datagen.events(spark, count, space, b.count(), s).write.parquet(at)
        events = spark.read.parquet(at)
        timed(f"plain_join_zipf_{s}", lambda: joins.plain_join(events, keys, "id", "k_id"))  # noqa: B023
        m, n = bucketing.write_by_size(events, "id", 16), bucketing.write_by_size(keys, "k_id", 4)
        timed(f"skewadj_join_zipf_{s}_read_only", lambda: joins.congruent_join(spark, m, n))  # noqa: B023
    print(json.dumps({"metric": "headline_queries_total", "value": round(headline, 3), "unit": "sec", "queries": times, "sf": Path(sf).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()

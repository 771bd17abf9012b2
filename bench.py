"""Times the headline queries at $BENCH_SF_DIR and prints one JSON line.

Every query is planned and run in full, its rows discarded by the no-op sink; the best of
two runs counts, the first of which also warms the JVM."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from notewright.session import configure  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "orders_extract",
    "device_counts",
    "header_fields",
    "documents_extract",
    "envelope_unwrap",
    "quality_fill",
    "accuracy",
    "response_order",
    "single_pass_result",
    "outputs_order",
    "staged_result",
    "delivery_outcomes",
    "batch_report",
    "stream_extract",
)
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("notewright-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    notes = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total of best times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "notes": notes,
                "rule_notes_per_s": round(notes / seconds["orders_extract"]),
                "rule_ms_per_note": round(1000 * seconds["orders_extract"] / notes, 4),
                "staged_notes_per_s": round(notes / seconds["staged_result"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries; prints one JSON line.

Every query runs once to the end (all columns, no output) in one session. ``input_ledger`` is the time to
derive and write the ledgers that most queries read.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from entry_queries import inputs  # noqa: E402
from entry_queries.catalogue import QUERIES  # noqa: E402

HEADLINE = [
    "x1_parse_money", "x3_parse_date", "s4_records", "s8_table_cells", "a2_lineitem_duplicates", "a5_orders_stats",
    "a7_lineitem_median", "a21_value_counts", "a13_inferred_types", "w1_samples", "a16_control_totals",
    "w4_running_balance", "w5_balance_summary", "r_invalid_money", "r_duplicate_identifier", "r_invalid_numeric",
    "r_balance", "column_profile", "table_profile", "b1_register_batch", "j4_duplicate_files", "b3_profile_corpus",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledgerlens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    start = time.time()
    inputs.ledger(spark, sf_dir)
    seconds["input_ledger"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()

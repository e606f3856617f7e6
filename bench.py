"""Times the headline queries; prints one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose tables and threads."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from leontia.queries import QUERIES

HEADLINE = ("sum_by_country_both", "country_summary", "matrix_summary", "aggregate_rows_sum", "pivot_wide", "technical_coefficients", "induced_production", "environmental_impact_vector")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["sum_by_country_rows"](spark, sf_dir).collect()  # starts the executors and reads the footers once
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else sf_dir}))


if __name__ == "__main__":
    main()

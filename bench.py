"""Times the headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tokenloom.plans.queries import QUERIES

HEADLINES = ("default_features", "index_feature_stats", "simhash60", "compressed_step", "nearest_jaccard", "nearest_hamming", "search_stats", "feature_cooccurrence", "cluster_b", "accuracy_report")


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", 2 * int(cpus)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").count()
    times = {}
    for name in HEADLINES:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()

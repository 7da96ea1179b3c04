"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark import catalog

HEADLINE = ("author_prior", "order_prior_strict_ties", "trailing_mean_rung1", "rung2_with_fallback", "trailing_baseline_meanstd", "yearly_stats", "settling_curve", "balanced_bands", "floor_share", "vocabulary", "skipgram_pairs_static", "average_ranks", "spearman", "nearest_neighbours", "strip_html", "tokens")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["tokens"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the session's code and workers
    times = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1); BENCH_CPUS: threads (default 8). After one query to warm up, each
runs once, its whole result computed and dropped. tokens_per_s: tokens of ``documents``
over the seconds of the distinct queries, the figure that the reference publishes.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.tokens import Filters
from tallyloom.operators.frequency import frequency_totals
from tallyloom.plans import queries
from tallyloom.sources.tables import document_corpus

HEADLINE = ("dedupe_first_seen", "dedupe_alphabetical", "dedupe_unordered", "dedupe_bucketed", "dedupe_stats", "per_file_stats", "token_frequency_top", "token_frequency_all",
            "set_diff", "set_intersect", "set_union", "ngram_bigrams", "ngram_filtered", "html_text_tokens", "word_check", "fuzzy_pairs", "fuzzy_clusters")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.files.maxPartitionBytes", "2m").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries.token_frequency_all(spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts workers and compiles
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    docs = document_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), order_col="doc_id")
    seen = frequency_totals(docs, Filters()).select(F.col("tokens_seen")).collect()[0][0]
    rates = {n: round(seen / took[n]) for n in ("dedupe_first_seen", "dedupe_alphabetical", "dedupe_unordered", "dedupe_bucketed", "token_frequency_all")}
    print(json.dumps({"metric": "headline queries, seconds in all", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": sf_dir.rpartition("/sf")[2] if "/sf" in sf_dir else sf_dir, "tokens": seen, "tokens_per_s": rates}))
    spark.stop()


if __name__ == "__main__":
    main()

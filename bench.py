"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from voxsieve.registry.spark_queries import QUERIES

HEADLINE = (
    "score_recordings", "score_transcripts", "segment_timeline", "text_proxies", "lexicon_polarity", "score_texts",
    "overall_toxicity", "multimodel_features", "segment_outcome", "align_nearest", "align_positional",
    "transcript_stats", "issue_frequency", "annotator_rollup", "contour_summary", "impute", "split_parts",
    "threshold_sweep", "roc_auc", "stratified_split", "regression_metrics", "json_envelope", "train_logistic",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("voxsieve-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per expression
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["score_recordings"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

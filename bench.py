"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tierlabel.plans.catalog import QUERIES  # noqa: E402
from tierlabel.session import local_session  # noqa: E402

HEADLINE = [
    "x01_cleanse",
    "t07_delete_rows_not_in",
    "t08_j3_update_table_columns",
    "t11_split_dataset",
    "a01_drop_duplicates",
    "a02_renumber_ids",
    "v02_tfidf_transform",
    "v03_j5_cosine_top1",
    "v05_top_k_similar",
    "v07_create_embeddings",
    "v08_hierarchical_classify",
    "v09_brand_similarity",
    "v09_brand_similarity_of_documents",
    "v10_v11_svm_of_items",
    "v13_vote",
    "v14_run_ensemble",
    "x05_detect_language",
    "x06_translate_non_english",
    "e02_classification_summary",
    "e06_confidence_full",
    "e07_classification_results",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the JVM's code paths
    seconds = {}
    warm = folder.replace("sf0.1", "sf0.001")
    for name in names:
        if os.path.isdir(warm):  # once unmeasured on a small input, so that compiling its code is not timed
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

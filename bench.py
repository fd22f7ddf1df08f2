"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the test tables, ``BENCH_CPUS`` the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pairmatch.plans import QUERIES
from pairmatch.session import get_session

HEADLINE = [
    "clean_flow",
    "profile_counts",
    "wordcount_histogram",
    "feature_histogram_by_label",
    "zscore",
    "word_frequency",
    "ngrams",
    "stem_tokens",
    "cooccurrence",
    "tfidf_features",
    "word_similarity_grid",
    "semantic_similarity",
    "word_order_similarity",
    "stratified_folds",
    "oversample",
    "batched_accuracy",
    "precision_recall_f1",
    "dedupe_predictions",
    "outer_join_weights",
    "feature_store_scan",
]


def main() -> None:
    """Run every headline query once, after a warm-up of the session."""
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 2)
    print(
        json.dumps(
            {
                "metric": "headline queries, wall time",
                "value": round(sum(seconds.values()), 2),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

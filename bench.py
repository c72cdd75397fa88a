"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from inkspect.catalog import registry
from inkspect.session import local_session

HEADLINE = [
    "class_overview", "clean_docs", "exact_dedup", "cleaning_funnel", "word_count_stats",
    "prof_lexical", "prof_chars", "prof_entropy", "mann_whitney_u", "top_words", "keyword_share",
    "block_b", "block_c", "block_f", "block_a_hashed", "bigram_ppl", "style_signals",
    "window_chunks", "sentence_consistency", "ensemble_verdict", "smote_rows", "knn_classify",
    "gaussian_nb", "roc_auc", "feature_vector", "sentence_ppl", "scaled", "clean_langs",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    all_queries = registry.queries()
    # One untimed query starts the executor threads and the Python workers.
    all_queries["class_overview"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        all_queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print("\n", name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

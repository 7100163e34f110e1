"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The figure of a query is the median of ``$BENCH_RUNS`` runs (3 by default).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from verification.compare import session
from verification.queries import QUERIES

HEADLINES = (
    "silver_jobs silver_resumes quality_report length_histogram document_frequency tfidf_topk "
    "ngram_tfidf_topk tfidf_ml_topk ngram_ml_topk lsh_topk lsh_recall lsh_grid dense_topk "
    "chunk_embed_pool dense_text_topk overlap_pairs pair_scores roc_pr_auc answer_key match_end_to_end"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINES
    # One untimed pass over a small text query starts the JVM and the Python workers.
    QUERIES["chunk_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(runs), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

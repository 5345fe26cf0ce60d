"""Wall time of the headline queries; prints one JSON line.

Every query runs twice: "queries" and "value" are the second, warm run,
"first_run" is the first one in a fresh session.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     cores of the local master (default all)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "dbscan", "eps_sweep", "cluster_tfidf", "feature_idf", "build_interpretable_space",
    "explain_documents", "explain_prediction", "model_performance", "silhouette_cosine",
    "attribution_scores", "attribution_eer_auc", "pairwise_cosine_distance",
    "greedy_select_by_class", "refine_features", "min_frequency_filter", "is_sentence_finished",
    "group_by_author", "encode_documents",
]


def main() -> None:
    from stylegraph.registry.all import QUERIES
    from stylegraph.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, shuffle_partitions=cpus, memory="16g", app="bench")
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    first = {name: run(name) for name in names}     # starts workers, compiles plans
    taken = {name: run(name) for name in names}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(taken.values()), 3), "unit": "sec",
        "queries": taken, "first_run": first, "sf": os.path.basename(folder).removeprefix("sf"), "cpus": cpus,
        "shuffle_partitions": cpus, "value_is": "second run of each query, warm session"}))


if __name__ == "__main__":
    main()

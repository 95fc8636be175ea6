"""Headline-query benchmark: prints one JSON line.

Runs each headline query on $BENCH_SF_DIR (default /root/testdata/sf0.1) with
local[$BENCH_CPUS] (default 8), executing the full plan into Spark's no-op sink,
and reports seconds per query (first run in a fresh session, then a warm re-run).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "label_distribution", "label_cooccurrence", "chi_square_lang_flag", "length_box_stats",
    "parse_output_two_stage", "labels_canonical", "clean_text_space", "split_stratified",
    "metrics_overall", "threshold_sweep", "span_phrases", "trigger_presence", "tfidf_vocabulary",
    "knn_search", "retrieval_prompt", "sft_binary_pairs", "stream_resume",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tagwise.plans.registry import load_all
    from tagwise.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2))
    reg = load_all()
    cold, warm = {}, {}
    for name in HEADLINE:
        for store in (cold, warm):
            t0 = time.time()
            reg[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            store[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total_warm", "value": round(sum(warm.values()), 3), "unit": "sec",
                      "queries": warm, "cold": cold, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()

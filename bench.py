"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up at sf0.001 and is then timed once at the target
scale (BENCH_RUNS to take the best of more). Results go to the no-op sink, so every
output column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "text_search_topk", "doc_normalize", "doc_quality_score", "doc_exact_dedupe", "doc_simhash", "near_dup_pairs", "word_chunks",
    "block_windows_all", "sentences", "sentence_counts", "quality_report", "latency_summary", "slot_inference", "evidence_units", "list_features",
    "entity_topk", "vector_topk", "vector_topk_sharded", "weighted_rerank", "semantic_tagging", "kg_triples", "kg_edges", "kg_walk_2hop",
    "kg_relation_gating", "pattern_hits", "gate_decisions", "answer_metrics", "grounding", "shingle_overlap", "weak_oracle", "budget_selection",
    "incremental_import", "append_stream", "html_text",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    from evisift.plans import CATALOGUE
    from evisift.session import local_session

    spark = local_session(cpus, int(cpus) if str(cpus).isdigit() else 8)
    warm = str(Path(sf_dir).parent / "sf0.001")
    times: dict[str, float] = {}
    for n in names:
        fn = CATALOGUE[n].fn
        if Path(warm).exists():
            fn(spark, warm).write.format("noop").mode("overwrite").save()
        best = float("inf")
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t0)
        times[n] = round(best, 3)
        print(n, times[n], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_wall", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()

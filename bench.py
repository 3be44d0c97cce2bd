"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from tracegrain.registry import QUERIES
from tracegrain.session import build_session

HEADLINE = (
    "log_seal", "log_verify_sealed", "typed_extraction_entities", "entity_versions", "edges_as_of", "bm25_keyword_search",
    "vector_exact_search", "vector_quantised_search", "hybrid_fusion", "personalised_pagerank", "graph_traversal", "salience_ledger",
    "mission_brief", "worker_performance_ledger", "fleet_state", "procedure_mining", "consolidation_proposals", "evidence_numeric_results",
    "date_intervals", "call_resolution", "run_summary", "secret_redaction", "window_counts_session", "merkle_root",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", "bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["log_status"](spark, folder).write.format("noop").mode("overwrite").save()  # ingest: numbers and writes the log once
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(sf.group(1)) if sf else None}))


if __name__ == "__main__":
    main()

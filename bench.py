"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = (
    "hotspot_files", "trust_edges", "resolve_claims", "rank_files", "fair_sample", "call_chain", "comment_evidence",
    "env_var_census", "io_event_census", "find_definitions", "jaccard_pairs", "verify_absence", "quality_gate",
    "module_boundaries", "commit_themes", "sink_with_status",
)


def main() -> None:
    from codeloom.plans import catalog
    from codeloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "codeloom-bench")
    queries = catalog.all_queries()
    names = sys.argv[1:] or [n for n in HEADLINE if n in queries]
    if names == ["all"]:
        names = list(queries)
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs):
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        seconds[name] = round(statistics.median(times), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir),
    }))


if __name__ == "__main__":
    main()

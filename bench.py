"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each query is run
once on the smallest data to warm up and then timed on the real data, best of BENCH_REPEATS (default 1); a run writes its
result to the no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from tidewatch.plans import QUERIES, load_all
from tidewatch.session import local_session

HEADLINE = [
    "cycle_series", "rolling_variance_autocorrelation", "rolling_tau", "kernel_residual", "restricted_mean_time", "giant_component", "bootstrap_mean", "score_runs", "lagging_grid",
    "fpr_curve", "cell_summary", "comparator_lead", "multiplicity_adjustment",
    "permutation_heterogeneity", "spearman_by_flag", "mean_degree", "team_cohesion", "dual_stream", "ipw_mean",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    load_all()
    spark = local_session(cpus, "tidewatch-bench")
    times = {}
    warm = str(Path(sf_dir).parent / "sf0.001")

    def run(name: str, folder: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for name in names:
        if Path(warm).is_dir():
            run(name, warm)
        times[name] = round(min(run(name, sf_dir) for _ in range(repeats)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline benchmark: runs the main operators at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (no collect to the
driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from silolake.plans.catalog import QUERIES  # noqa: E402
from silolake.session import get_spark  # noqa: E402

HEADLINE = [
    "read_transactions",       # 4-way join + unique key
    "feature_table",           # partition + 22 features incl. velocity / in-degree windows
    "standardize",             # per-silo stats + broadcast standardisation (flagship)
    "dirichlet_partition",     # exact distributed rank + cuts
    "in_degree_24h_distinct_lineitem",
    "psi",                     # exact quantiles + histograms, all (silo, feature, window) at once
    "classification_report",   # AUC-ROC / AP / recall@FPR per silo
    "amplify",                 # ×3 scale-up
    "fedavg",
    "qwra",
    "round_updates",
    "train_mode_b",            # one Mode B local training of all silos
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("silolake-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").split("sf")[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and is then timed to its last row (a "noop" write).
``BENCH_QUERIES`` (comma-separated) picks other queries.
"""

from __future__ import annotations

import json
import os
import time

from veilframe import showcase
from veilframe.session import build_session

HEADLINE = [
    "prepare_dataset", "stratified_split", "preprocess", "detect_column_roles", "profile_continuous", "profile_categorical_topk",
    "classical_metrics", "dcr_summary", "nearest_orders", "mia_rank_auc", "jsd_numeric", "tvd_categorical", "marginal_summary",
    "pearson_mae", "cramers_v_mae", "quality_score", "roc_auc_rank", "synth_tree", "synth_copula", "synth_dp_tree",
    "privacy_report", "utility_report", "ml_efficacy", "mia_attack", "run_history_merge", "run_log_extract", "verdict",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          **{"spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    times: dict[str, float] = {}
    for name in names:
        run = showcase.runner(name)
        for _ in range(2):
            started = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

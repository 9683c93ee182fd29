"""Wall time of the headline queries: one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores.
Each query is written to Spark's no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from secondlook.session import local_session  # noqa: E402
from secondlook.workload import QUERIES  # noqa: E402

HEADLINES = [
    "q1_modelling_set", "q2_duplicate_profile", "q3_lead_card_match", "q3_lead_card_rows", "q4_before_after",
    "q5_target_set", "win1_single_texts", "win3_later_rows", "win5_latest_per_key", "win7_global_row_number",
    "smp1_exact_split", "smp4_folds", "smp6_stratified_split", "ml7_roc_points", "ml8_auc", "ml11_lda_class",
    "ml14_accuracy_by_k", "jn9_nearest_64_dimensions", "ml22_smote_rows", "eda1_kernel_density",
    "q6_glm_study", "q8_fold_auc", "q9_grid_table", "q10_scaled_glm_study",
]


def run(spark, name: str, sf: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    spark = local_session(cpus, "bench")
    run(spark, "agg1_row_count", sf)  # starts the JVM's first job outside the timing
    seconds = {name: run(spark, name, sf) for name in HEADLINES}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": cpus,
        "spark": spark.version, "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

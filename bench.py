"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a00_longitudinal_patients",
    "a01_encounters_per_patient",
    "a05_observation_pivot",
    "a08_summary_list",
    "w03_first_events",
    "j01_left_join_chain",
    "p16_token_jaccard",
    "p17_text_concept",
    "q02_duplicate_rows",
    "q05_describe_numeric",
    "w01_stratified_split",
    "w04_kfold",
    "i02_impute_whole_frame",
    "i06_robust_scale",
    "i08_ordinal",
    "i10_column_preprocess",
    "b03_smote",
    "e01_weighted_scores",
    "e04_roc_auc",
    "e08_calibration_curve",
    "f01_group_fairness",
    "x02_permutation_importance",
    "x03_exact_shap",
    "x05_global_importance",
    "n04_similar_patients",
    "j05_pair_join_topk",
    "n07_dbscan_cohorts",
    "m01_base_learners",
    "m12_batch_scoring",
    "n06_kmeans_cohorts",
    "t01_stream_scoring",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from cohortry.plans import QUERIES
    from cohortry.session import local_session

    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in HEADLINE if len(sys.argv) < 2 or any(n.startswith(p) for p in sys.argv[1:])]
    spark.read.parquet(f"{folder}/orders.parquet").count()  # start-up is not measured
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()

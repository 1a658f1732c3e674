"""Benchmark of the headline queries: prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose the data and the cores. Stage tables are
forgotten before every query, so each time includes everything the query needs.
"""
import json
import os
import time

from subsetlab.plans import catalogue, study
from subsetlab.session import checkpoint_dir, local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = ("trajectory_costs", "cost_profile", "openhands_steps", "trajectory_features", "masked_texts_multi_model", "vocabulary", "token_ranking",
             "outcome_keyness", "assigned_runs", "stratum_quotas", "baseline_metrics", "stability_control", "centroid_errors", "kennard_stone_by_label",
             "medoid_by_label", "facility_location_by_label", "population_members", "pairwise_jaccard", "instance_churn", "study_population_metrics",
             "per_seed_draws", "reference_comparison", "draw_comparison")


def main():
    spark = local_session(CPUS, int(CPUS), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    catalogue.QUERIES["pool_statistics"](spark, FOLDER).collect()   # starts the session's threads and code paths
    times = {}
    for name in HEADLINES:
        study.clear_stages()
        started = time.time()
        catalogue.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")}), flush=True)


if __name__ == "__main__":
    main()

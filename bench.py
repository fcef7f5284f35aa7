"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "plan_01_pathway_activities", "plan_02_vocabulary", "plan_04_evaluation_overall", "plan_05_qc_audit",
    "plan_06_run_comparison", "plan_07_gene_availability", "plan_08_sample_card", "agg_04_gene_moments", "agg_05_pathway_scores",
    "agg_08_morans_all_genes", "agg_14_expression_statistics", "agg_25_validation_pcc", "join_04_knn_edges", "win_04_moving_average",
    "fn_10_cosine_scores", "prep_01_patient_split_customers", "fil_11_spot_qc", "join_02_expression_gene_sets",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    from spotlake.catalog import load
    from spotlake.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=8, app="spotlake-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    only = sys.argv[1:]
    seconds: dict[str, float] = {}
    queries["fil_11_spot_qc"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    for name in only or HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        spark.catalog.clearCache()
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

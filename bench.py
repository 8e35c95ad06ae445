"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from larkspan.plans import registry
from larkspan.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
NAMES = ["nunique_topk", "deg_filter_sort", "threshold_grid", "dedup_keep_max", "cpm_log2", "entropy_by_group", "fdr_bh", "enrichment_score", "wtcs_ncs", "pathway_index", "hypergeom_sf", "welch_t", "mann_whitney", "chi2_cramers_v", "jaccard_pairs", "interval_overlap", "array_theta_join", "binary_pivot", "loglr_aggregate", "simple_paths"]


def main() -> None:
    spark = local_session()
    took = {}
    registry.QUERIES["nunique_topk"](spark, SF_DIR).collect()  # classes are loaded and code compiled before the clock runs
    for name in NAMES:
        began = time.perf_counter()
        registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

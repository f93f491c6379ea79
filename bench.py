"""Times the headline queries on local[BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from centrum.queries import registry  # noqa: E402
from centrum.session import local_session  # noqa: E402

HEADLINE = [
    "pooled_moments", "part_1_iid_centers", "part_2_dirichlet_centers", "part_9_train_val_test", "fit_2_median",
    "fit_8_imputed_moments", "fs_1_mutual_info", "fs_2_anova", "agg_6_pooled_std", "app_4_scale_globally",
    "app_5_scale_locally", "trn_1_logistic_step", "trn_9_boost_stump", "trn_15_tree_encoding", "scr_1_linear_score",
    "fed_1_fedavg", "fed_9_weighted_draw", "sel_1_alternate_by_cost", "met_4_auroc", "met_7_all_metrics",
    "met_8_best_threshold", "met_9_tuned_metrics", "fair_2_group_metrics", "res_4_weighted_summary", "res_6_center_pivot",
    "fed_19_linear_rounds", "fed_19_boosted_rounds",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    registry.load_all()
    spark = local_session(cpus, "centrum-bench", os.environ.get("BENCH_MEMORY", "8g"))
    registry.QUERIES["pooled_moments"](spark, folder).collect()
    times: dict[str, float] = {}
    wanted = sys.argv[1:] or HEADLINE
    for name in wanted:
        begin = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        print(name, times[name], file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()

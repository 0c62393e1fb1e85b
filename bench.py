"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from panelyard.catalog import QUERIES  # noqa: E402
from panelyard.plans.stage import release  # noqa: E402
from panelyard.session import build_session  # noqa: E402

HEADLINE = [
    "l1_forward_return", "a8_daily_ic", "a10_icir", "l6_label_chain", "w3_feature_stage", "w8_winsorize_by_date",
    "w9_zscore_by_date", "w10_robust_zscore", "m1_clean_fit", "j5_fold_assignment", "f7_refit_windows_days",
    "g8_factor_history", "g2_select_by_history_many", "w11_quantile_bucket", "a12_part_metrics",
    "a16_quantile_cumulative", "b1_evaluation_run", "b4_group_backtest", "c4_auc", "e1_mse_mae", "s3_load_chunks_label",
    "m6_pca", "m10_walk_forward", "m11_refit_history", "d1_stream_scoring",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores=cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["l1_forward_return"](spark, sf).write.format("noop").mode("overwrite").save()  # start the JVM paths
    only = sys.argv[1:]
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline panel queries, total wall time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": Path(sf).name.removeprefix("sf")}))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()

"""Benchmark: run the registered jobs on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is executed in full (``write.format('noop')``) and timed; prints
one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from partnerlens.plans.registry import load_all  # noqa: E402
from partnerlens.session import local_session  # noqa: E402

# headline jobs: the reference's four pipelines end to end plus evaluation
# and explanation (order = the order they run)
HEADLINE = [
    "optimal_discounts", "forecast_pipeline", "forecast_future", "actual_vs_predicted", "shap_linear",
    "rec_user_based", "rec_item_based", "rec_products_knn", "rec_products_knn_toggle", "rec_products_jaccard",
    "scheme_rank_simple", "scheme_rank_value", "final_mapping", "eval_schemes", "eval_products",
    "pfi_drop", "pfi_shuffle", "pfi_products", "token_weight_scorer", "sentiment_eval",
    "llm_batch_prompts", "llm_parse_replies", "score_text_batches",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus), app="partnerlens-bench",
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    reg = load_all()
    names = [q for q in (only or HEADLINE) if q in reg]
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        try:
            reg[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 - a failing query is reported, not fatal
            print(f"bench: {name} failed: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
            times[name] = None
    ok = [v for v in times.values() if v is not None]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(ok), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "failed": [k for k, v in times.items() if v is None]}))
    spark.stop()


if __name__ == "__main__":
    main()

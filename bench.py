"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of test tables, BENCH_CPUS the number of local cores. Every query runs over its whole
tables; `queries` holds the second (warm) run, `cold` the first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lectern.plans.queries import QUERIES  # noqa: E402
from lectern.session import get_session  # noqa: E402

HEADLINES = [
    "rec_outcome_by_action",
    "user_interaction_analysis",
    "fact_interaction_load",
    "catalogue_extract",
    "apply_diff_soft",
    "books_with_tags",
    "tags_with_books",
    "clean_html",
    "tokenize",
    "embed_default",
    "session_sequence",
    "training_steps",
    "last5_serving",
    "dense_top10",
    "bm25_scores",
    "hybrid_search",
    "mine_triplets",
    "evaluate_triplets",
    "recommend_top5",
    "last3_losses",
    "fit_adapter_losses",
    "fit_policy_losses",
    "stream_last5",
]


def timed(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINES
    spark = get_session("bench", f"local[{cpus}]", **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    cold = {name: timed(spark, name, folder) for name in names}
    warm = {name: timed(spark, name, folder) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline queries, total warm seconds",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

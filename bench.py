"""Headline queries, timed one by one; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from merchlens.plans import QUERIES, search_queries
from merchlens.session import get_session, release

# Made once and stored; timed apart, so that no query pays for them.
ARTIFACTS = {
    "build_lexical_index": search_queries.stored_index,
    "build_vector_index": search_queries.stored_vector_index,
    "build_hybrid_candidates": search_queries.frozen_candidates,
    "capture_runs": search_queries.frozen_runs,
}
HEADLINE = [
    "lexical_fit_vocab",
    "lexical_topk",
    "dense_topk_exact",
    "dense_topk_filtered",
    "dense_topk_ann",
    "hybrid_rrf",
    "rerank_multi_signal",
    "metrics_by_method",
    "bootstrap_ndcg",
    "rule_judges",
    "clean_catalog",
    "search_text",
    "profile_overview",
    "profile_prices",
    "category_evaluation",
    "clean_html",
    "query_audit",
    "audit_by_group",
    "extraction_summary",
    "eligible_counts",
    "near_duplicates",
    "components",
    "grouped_split",
    "evidence_rows",
    "grounding_check",
    "source_target_diff",
    "session_turns",
    "latency_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # session start-up is not a query
    times = {}
    for name in sys.argv[1:] or [*ARTIFACTS, *HEADLINE]:
        start = time.perf_counter()
        if name in ARTIFACTS:
            ARTIFACTS[name](spark, sf_dir)
        else:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from postmill import plans
from postmill.session import build

HEADLINE = [
    "filter_funnel", "pass_columns", "squash_text", "dedupe_key", "dedupe_canonical", "diff_upsert_ops", "pipeline_page", "latest_event_per_user", "knn_cap_per_group",
    "title_band", "country_bar", "coverage_score", "keyword_coverage", "claims_explode", "first_fault", "source_greenhouse", "threshold_sweep", "interval_union_months", "stream_foreachbatch_merge",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build(f"local[{os.environ.get('BENCH_CPUS', '8')}]", "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()  # start-up is not a query's
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

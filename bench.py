"""Time the headline queries on one data folder and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from ledgermesh.plans import catalog
from ledgermesh.session import clear_stages, get_spark

HEADLINE = [
    "strongest_company_pairs", "canonical_relationships", "derive_people", "company_projection",
    "company_distribution", "projection_concentration", "threshold_retention", "component_report",
    "market_snapshot", "upsert_prices", "prune_prices", "session_returns",
    "company_master", "cross_company_edges", "company_neighbourhood_2", "search_name",
    "answer_rows", "answer_status", "latest_filings", "signature_edges",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = get_spark("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_custkey").count().agg({"count": "max"}).collect()  # warm up a shuffle
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    clear_stages(spark)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of given tables, BENCH_CPUS the number of local cores,
BENCH_RUNS how often each query is timed (the median counts). All queries run once before
any is timed, so that none pays for the start of the JVM.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from retail_engine.plans.catalogue import queries
from retail_engine.session import local_session

HEADLINE = (
    "revenue_summary",
    "sales_by_product",
    "sales_by_city",
    "daily_sales",
    "top_products",
    "product_ranking",
    "city_ranking",
    "net_revenue",
    "fact_sales",
    "orders_list",
    "order_totals",
    "reconcile_totals",
    "fk_audit",
    "constraint_audit",
    "validate_customers",
    "validate_products",
    "validate_orders",
    "accepted_order_lines",
    "created_orders",
    "created_order_items",
)


def timed(spark, build, sf_dir: str) -> float:
    """Seconds to build and fully run the query, rows thrown away inside the tasks."""
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, "retail_engine bench")
    available = queries()
    for name in HEADLINE:
        timed(spark, available[name], sf_dir)
    seconds = {
        name: round(
            statistics.median(timed(spark, available[name], sf_dir) for _ in range(runs)), 3
        )
        for name in HEADLINE
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
                "cpus": cpus,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

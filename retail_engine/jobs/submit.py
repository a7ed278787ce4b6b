"""Command line for spark-submit.

    submit.py run    --root ROOT --run-id ID (--tables FOLDER | --jdbc-url URL [--jdbc-option K=V])
    submit.py report --root ROOT --name NAME --out PATH
    submit.py intake --root ROOT --batch-id ID --kind KIND --requests PATH [--as-of TIME]
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from retail_engine.jobs import intake as intake_jobs
from retail_engine.jobs import warehouse
from retail_engine.operators import display, reports
from retail_engine.schemas import OPERATIONAL, REQUESTS
from retail_engine.session import tune
from retail_engine.sources import jdbc, snapshots

Tables = dict[str, DataFrame]


def _by_product(star: Tables) -> DataFrame:
    return reports.sales_by_product(star["fact_sales"], star["dim_product"])


def _by_city(star: Tables) -> DataFrame:
    return reports.sales_by_city(star["fact_sales"], star["dim_customer"])


# Reports on the published warehouse.
REPORTS: dict[str, Callable[[Tables], DataFrame]] = {
    "revenue_summary": lambda star: reports.revenue_summary(star["fact_sales"]),
    "sales_by_product": lambda star: reports.by_revenue(
        _by_product(star), reports.PRODUCT_TIE_BREAK
    ),
    "sales_by_city": lambda star: reports.by_revenue(_by_city(star), reports.CITY_TIE_BREAK),
    "daily_sales": lambda star: reports.by_day(reports.daily_sales(star["fact_sales"])),
    "top_products": lambda star: reports.top_products(_by_product(star)),
    "product_ranking": lambda star: reports.product_ranking(_by_product(star)),
    "city_ranking": lambda star: reports.city_ranking(_by_city(star)),
}
# Lists of the newest landed tables.
LISTS: dict[str, Callable[[Tables], DataFrame]] = {
    "customers": lambda t: reports.customers_list(t["customers"]),
    "products": lambda t: reports.products_list(t["products"]),
    "orders": lambda t: reports.orders_list(t["orders"], t["customers"], t["order_items"]),
}


def _arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="land the tables, build and publish the warehouse")
    run.add_argument("--root", required=True)
    run.add_argument("--run-id", required=True)
    source = run.add_mutually_exclusive_group(required=True)
    source.add_argument("--tables", help="folder with one Parquet folder per table")
    source.add_argument("--jdbc-url")
    run.add_argument("--jdbc-option", action="append", default=[], metavar="KEY=VALUE")
    run.add_argument("--jdbc-partitions", type=int, default=64)
    report = commands.add_parser("report", help="write one report or list as JSON lines")
    report.add_argument("--root", required=True)
    report.add_argument("--name", required=True, choices=sorted({**REPORTS, **LISTS}))
    report.add_argument("--out", required=True)
    intake = commands.add_parser("intake", help="take in a batch of requests (JSON lines)")
    intake.add_argument("--root", required=True)
    intake.add_argument("--batch-id", required=True)
    intake.add_argument("--kind", required=True, choices=sorted(REQUESTS))
    intake.add_argument("--requests", required=True)
    intake.add_argument("--as-of", type=datetime.fromisoformat, help="default: now, UTC")
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> None:
    args = _arguments(argv)
    spark = tune(SparkSession.builder.getOrCreate())
    if args.command == "report":
        if args.name in REPORTS:
            rows = REPORTS[args.name](snapshots.current_star(spark, args.root))
        else:
            rows = LISTS[args.name](snapshots.latest_tables(spark, args.root))
        display.write_json(rows, args.out)
        return

    if args.command == "intake":
        asked = spark.read.schema(REQUESTS[args.kind]).json(args.requests)
        at = args.as_of or datetime.now(UTC)
        row = intake_jobs.run(spark, args.root, args.kind, asked, args.batch_id, at)
        for table, rows in row.row_counts.items():
            print(f"{table}: {rows} rows")
        return

    def read(table: str) -> DataFrame:
        if args.tables:
            return spark.read.schema(OPERATIONAL[table]).parquet(f"{args.tables}/{table}")
        options = dict(option.split("=", 1) for option in args.jdbc_option)
        return jdbc.read_table(
            spark, {"url": args.jdbc_url, **options}, table, args.jdbc_partitions
        )

    counts = warehouse.run(spark, read, args.root, args.run_id)
    for table, rows in counts.items():
        print(f"{table}: {rows} rows")


if __name__ == "__main__":
    main()

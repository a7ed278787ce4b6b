"""Every report, list, intake job and audit as a named query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_engine.jobs import intake as intake_jobs
from retail_engine.jobs import standing, storage
from retail_engine.operators import audit, changes, display, increments, intake, reports, runs, star
from retail_engine.schemas import KEY_BUCKETS, OPERATIONAL, conform
from retail_engine.session import checkpointed, shared_folder, tune
from retail_engine.sources import buckets, commits, run_logs, snapshots
from retail_engine.sources import driver_requests as requests
from retail_engine.sources import driver_tables as tables
from retail_engine.sources.commits import Commit

Query = Callable[[SparkSession, str], DataFrame]

# Stand-in for the current time, so that reruns agree.
AS_OF = "2001-09-01 00:00:00"
_AT = datetime.fromisoformat(AS_OF)
# Orders placed from this day on are in the later of the two compared snapshots only.
SNAPSHOT_DAY = "2001-07-01"

_QUERIES: dict[str, Query] = {}


def _query(build: Query) -> Query:
    """Register under the function's name; the session gets its settings first."""
    _QUERIES[build.__name__] = lambda spark, sf_dir: build(tune(spark), sf_dir)
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact without item ids, which no report looks at."""
    return star.fact_sales(tables.order_lines(spark, sf_dir), tables.orders(spark, sf_dir))


def _no_zone(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _joined_reasons(df: DataFrame) -> DataFrame:
    return df.withColumn("reasons", F.array_join("reasons", ","))


# Star schema


@_query
def dim_customer(spark, sf_dir):
    return star.dim_customer(tables.customers(spark, sf_dir))


@_query
def dim_product(spark, sf_dir):
    return star.dim_product(tables.products(spark, sf_dir))


@_query
def fact_sales(spark, sf_dir):
    return star.fact_sales(tables.order_items(spark, sf_dir), tables.orders(spark, sf_dir))


def _bucketed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders and items written in buckets of the order, and read back."""
    root, found = _store(spark), {}
    given = {"orders": tables.orders(spark, sf_dir), "order_items": tables.order_items(spark, sf_dir)}
    for name, rows in given.items():
        buckets.write(rows, f"{root}/{name}", "order_id")
        found[name] = buckets.read(spark, f"{root}/{name}", rows.schema, "order_id")
    return found


@_query
def fact_sales_bucketed(spark, sf_dir):
    stored = _bucketed(spark, sf_dir)
    return star.fact_sales(stored["order_items"], stored["orders"])


@_query
def order_totals_bucketed(spark, sf_dir):
    stored = _bucketed(spark, sf_dir)
    return reports.order_totals(stored["orders"], stored["order_items"])


# Reports


@_query
def revenue_summary(spark, sf_dir):
    return reports.revenue_summary(_fact(spark, sf_dir))


@_query
def net_revenue(spark, sf_dir):
    """Pending orders are excluded too: the given tables know no cancelled or refunded ones."""
    return reports.net_revenue(
        _fact(spark, sf_dir), tables.orders(spark, sf_dir), (*reports.NOT_NET, "Pending")
    )


def _by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sales_by_product(
        _fact(spark, sf_dir), star.dim_product(tables.products(spark, sf_dir))
    )


def _by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sales_by_city(
        _fact(spark, sf_dir), star.dim_customer(tables.customers(spark, sf_dir))
    )


def _by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_sales(_fact(spark, sf_dir))


@_query
def sales_by_product(spark, sf_dir):
    return reports.by_revenue(_by_product(spark, sf_dir), reports.PRODUCT_TIE_BREAK)


@_query
def sales_by_city(spark, sf_dir):
    return reports.by_revenue(_by_city(spark, sf_dir), reports.CITY_TIE_BREAK)


@_query
def daily_sales(spark, sf_dir):
    return reports.by_day(_by_day(spark, sf_dir))


@_query
def top_products(spark, sf_dir):
    return reports.top_products(_by_product(spark, sf_dir))


@_query
def product_ranking(spark, sf_dir):
    return reports.product_ranking(_by_product(spark, sf_dir))


@_query
def city_ranking(spark, sf_dir):
    return reports.city_ranking(_by_city(spark, sf_dir))


@_query
def report_json(spark, sf_dir):
    return display.as_json(_by_product(spark, sf_dir))


@_query
def city_report_json(spark, sf_dir):
    return display.as_json(_by_city(spark, sf_dir))


@_query
def daily_report_json(spark, sf_dir):
    return display.as_json(_by_day(spark, sf_dir))


@_query
def summary_json(spark, sf_dir):
    return display.as_json(reports.revenue_summary(_fact(spark, sf_dir)))


@_query
def axis_labels(spark, sf_dir):
    return display.axis_labels(_by_day(spark, sf_dir))


def _standing(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """States of all sales, which come in three batches: most orders have lines in each."""
    root, fact = _store(spark), checkpointed(_fact(spark, sf_dir))
    buyers = star.dim_customer(tables.customers(spark, sf_dir))
    for n in range(3):
        sales = fact.filter(F.pmod("product_id", F.lit(3)) == n)
        standing.add_sales(spark, root, f"batch {n}", sales, buyers, _AT)
    return standing.states(spark, root)


@_query
def standing_summary(spark, sf_dir):
    return increments.revenue_summary(_standing(spark, sf_dir))


@_query
def standing_by_product(spark, sf_dir):
    products = star.dim_product(tables.products(spark, sf_dir))
    found = increments.sales_by_product(_standing(spark, sf_dir), products)
    return reports.by_revenue(found, reports.PRODUCT_TIE_BREAK)


@_query
def standing_by_city(spark, sf_dir):
    found = increments.sales_by_city(_standing(spark, sf_dir))
    return reports.by_revenue(found, reports.CITY_TIE_BREAK)


@_query
def standing_by_day(spark, sf_dir):
    return reports.by_day(increments.daily_sales(_standing(spark, sf_dir)))


# Lists


@_query
def customers_list(spark, sf_dir):
    return reports.customers_list(tables.customers(spark, sf_dir))


@_query
def products_list(spark, sf_dir):
    return reports.products_list(tables.products(spark, sf_dir))


def _orders_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.orders_list(
        tables.orders(spark, sf_dir),
        tables.customers(spark, sf_dir),
        tables.order_lines(spark, sf_dir),
    )


@_query
def orders_list(spark, sf_dir):
    return _orders_list(spark, sf_dir)


@_query
def orders_display(spark, sf_dir):
    return display.orders_display(_orders_list(spark, sf_dir))


@_query
def order_totals(spark, sf_dir):
    return reports.order_totals(
        tables.orders(spark, sf_dir), tables.order_lines(spark, sf_dir)
    )


@_query
def entity_counts(spark, sf_dir):
    return reports.entity_counts(tables.operational(spark, sf_dir))


# Intake


def _judged_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.validate_customers(*requests.customer_requests(spark, sf_dir))


def _priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.priced_lines(
        requests.order_request_lines(spark, sf_dir), requests.known_products(spark, sf_dir)
    )


def _judged_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    priced = checkpointed(_priced_lines(spark, sf_dir))
    judged = intake.validate_orders(
        requests.order_headers(spark, sf_dir), priced, requests.known_customers(spark, sf_dir)
    )
    return judged, priced


@_query
def validate_customers(spark, sf_dir):
    return _joined_reasons(_judged_customers(spark, sf_dir))


@_query
def clean_customers(spark, sf_dir):
    return intake.clean_customers(intake.accepted(_judged_customers(spark, sf_dir)))


@_query
def validate_products(spark, sf_dir):
    asked, existing = requests.product_requests(spark, sf_dir)
    return _joined_reasons(intake.validate_products(asked, existing))


@_query
def validate_products_indexed(spark, sf_dir):
    """The same ruling with the catalogue's SKUs in hash buckets, of which the batch reads its
    own."""
    asked, existing = requests.product_requests(spark, sf_dir)
    root, index = _store(spark), "product_skus"
    keys = snapshots.key_rows(existing, index)
    files = storage.write_clustered(spark, root, index, keys, KEY_BUCKETS)
    first = Commit(kind="adopt", at=_AT, files=files, adopted=(index,))
    state = commits.commit(spark, root, commits.read(spark, root), first)
    near = snapshots.keys_near(spark, root, index, state, asked)
    return _joined_reasons(intake.validate_products(asked, near))


@_query
def clean_products(spark, sf_dir):
    asked, existing = requests.product_requests(spark, sf_dir)
    return intake.clean_products(intake.accepted(intake.validate_products(asked, existing)))


@_query
def validate_orders(spark, sf_dir):
    judged, _ = _judged_orders(spark, sf_dir)
    return _no_zone(_joined_reasons(judged), "order_date")


@_query
def accepted_orders(spark, sf_dir):
    judged, _ = _judged_orders(spark, sf_dir)
    return _no_zone(intake.accepted_orders(judged, AS_OF), "order_date")


@_query
def accepted_order_lines(spark, sf_dir):
    judged, priced = _judged_orders(spark, sf_dir)
    return intake.accepted_lines(judged, priced)


def _created_orders(spark: SparkSession, sf_dir: str) -> intake_jobs.Outcome:
    """The request batch taken in on top of the given orders."""
    lines = requests.order_request_lines(spark, sf_dir)
    existing = {
        "customers": requests.known_customers(spark, sf_dir),
        "products": requests.known_products(spark, sf_dir),
        "orders": tables.orders(spark, sf_dir),
        "order_items": lines.withColumnRenamed("pos", "order_item_id"),
    }
    return intake_jobs.take_orders(
        requests.order_headers(spark, sf_dir), lines, existing, AS_OF
    )


@_query
def created_orders(spark, sf_dir):
    return _no_zone(
        _created_orders(spark, sf_dir).rows["orders"], "order_date", "created_at", "updated_at"
    )


@_query
def created_order_items(spark, sf_dir):
    return _created_orders(spark, sf_dir).rows["order_items"]


@_query
def created_customers(spark, sf_dir):
    asked, existing = requests.customer_requests(spark, sf_dir)
    created = intake_jobs.take_customers(asked, existing, AS_OF).rows["customers"]
    return _no_zone(created, "created_at", "updated_at")


@_query
def created_products(spark, sf_dir):
    asked, existing = requests.product_requests(spark, sf_dir)
    created = intake_jobs.take_products(asked, existing, AS_OF).rows["products"]
    return _no_zone(created, "created_at", "updated_at")


@_query
def duplicate_lines(spark, sf_dir):
    lines = requests.order_request_lines(spark, sf_dir)
    return intake.duplicate_lines(lines).select("request_seq", "pos", "product_id", "first_pos")


@_query
def priced_order_lines(spark, sf_dir):
    return _priced_lines(spark, sf_dir)


@_query
def order_quote(spark, sf_dir):
    drafts = tables.order_lines(spark, sf_dir).withColumnRenamed("order_id", "request_seq")
    return intake.order_quote(drafts, requests.known_products(spark, sf_dir))


# Changes


@_query
def upsert_products(spark, sf_dir):
    """Brand#1 is not in the catalogue yet; it and sizes from 40 on come at a new price."""
    parts = tables.products(spark, sf_dir)
    old = parts.filter(F.col("p_brand") != "Brand#1").drop("p_brand", "p_size")
    sent = (F.col("p_brand") == "Brand#1") | (F.col("p_size") >= 40)
    new = parts.filter(sent).withColumn(
        "price", (F.col("price") + 10).cast("decimal(10,2)")
    )
    return changes.upsert(old, new, "product_id", AS_OF)


def _store(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/retail/store-{uuid.uuid4().hex}"


@_query
def merged_products(spark, sf_dir):
    """The upsert above on files by key, of which only those with a sent key are rewritten."""
    parts, root = tables.products(spark, sf_dir), _store(spark)
    key_columns = OPERATIONAL["products"].names
    catalogue = conform(parts.filter("p_brand <> 'Brand#1'"), OPERATIONAL["products"])
    files = storage.write_clustered(spark, root, "products", catalogue, 100)
    state = commits.read(spark, root)
    first = Commit(kind="adopt", at=_AT, files=files, adopted=("products",))
    commits.commit(spark, root, state, first)
    sent = parts.filter("p_brand = 'Brand#1' OR p_size >= 40").withColumn(
        "price", (F.col("price") + 10).cast("decimal(10,2)")
    )
    storage.upsert_rows(spark, root, "products", sent.select(*key_columns), _AT)
    found = snapshots.taken(spark, root, "products")
    return _no_zone(found, "created_at", "updated_at")


def _committed_orders(spark: SparkSession, sf_dir: str) -> str:
    """A store into which the given orders came in 40 batches, by date; then compacted."""
    root, path = _store(spark), "intake/orders"
    orders = conform(tables.orders(spark, sf_dir), OPERATIONAL["orders"])
    orders.repartitionByRange(40, "order_date").write.parquet(f"{root}/{path}")
    state = commits.read(spark, root)
    for file in storage.described(spark, root, "orders", path):
        batch = Commit(kind="batch", at=_AT, files=(file,), batch_id=file.path)
        state = commits.commit(spark, root, state, batch)
    storage.compact(spark, root, "orders", _AT)
    return root


@_query
def committed_orders(spark, sf_dir):
    """All orders out of many committed batches, packed into few files."""
    found = snapshots.taken(spark, _committed_orders(spark, sf_dir), "orders")
    return _no_zone(found, "order_date").drop("created_at", "updated_at")


@_query
def undeleted_orders(spark, sf_dir):
    """What stays of the committed orders when pending ones are deleted in place."""
    root = _committed_orders(spark, sf_dir)
    state = commits.read(spark, root)
    commits.commit(spark, root, state, Commit(kind="adopt", at=_AT, adopted=("orders",)))
    gone = tables.orders(spark, sf_dir).filter("status = 'Pending'").select("order_id")
    storage.delete_rows(spark, root, "orders", gone, _AT)
    found = snapshots.taken(spark, root, "orders")
    return _no_zone(found, "order_date").drop("created_at", "updated_at")


@_query
def cascade_delete(spark, sf_dir):
    """What stays when pending orders go: each order, and its number of items."""
    orders = tables.orders(spark, sf_dir)
    gone = orders.filter(F.col("status") == "Pending").select("order_id")
    kept, items = changes.cascade_delete(orders, tables.order_lines(spark, sf_dir), gone)
    left = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("items"))
    return kept.select("order_id").join(left, "order_id", "left").select(
        "order_id", F.coalesce("items", F.lit(0)).alias("items")
    )


@_query
def restrict_delete(spark, sf_dir):
    """Customers in debt and products of size 1 that cannot be deleted."""
    customers = tables.customers(spark, sf_dir).filter(F.col("c_acctbal") < 0)
    products = tables.products(spark, sf_dir).filter(F.col("p_size") == 1)
    blocked_customers = changes.restrict_delete(
        customers.select("customer_id"), tables.orders(spark, sf_dir), "customer_id"
    )
    blocked_products = changes.restrict_delete(
        products.select("product_id"), tables.order_lines(spark, sf_dir), "product_id"
    )
    return blocked_customers.select(
        F.lit("customers").alias("table_name"), F.col("customer_id").alias("id")
    ).unionAll(
        blocked_products.select(
            F.lit("products").alias("table_name"), F.col("product_id").alias("id")
        )
    )


# Audits


@_query
def row_counts(spark, sf_dir):
    t = tables.operational(spark, sf_dir)
    return audit.row_counts({**t, **star.build(t)})


@_query
def schema_report(spark, sf_dir):
    return audit.schema_report(star.build(tables.operational(spark, sf_dir)))


@_query
def landed_types(spark, sf_dir):
    """Every operational table as it lands: types of its columns and totals of its values."""
    landed = {
        name: conform(table, OPERATIONAL[name])
        for name, table in tables.operational(spark, sf_dir).items()
    }
    return audit.type_report(landed)


@_query
def status_audit(spark, sf_dir):
    return audit.status_audit(requests.order_headers(spark, sf_dir))


@_query
def fk_audit(spark, sf_dir):
    return audit.fk_audit(tables.operational(spark, sf_dir))


@_query
def fk_audit_known(spark, sf_dir):
    """The same audit against the customers and products that requests may name."""
    known = {
        "customers": requests.known_customers(spark, sf_dir),
        "products": requests.known_products(spark, sf_dir),
    }
    return audit.fk_audit({**tables.operational(spark, sf_dir), **known})


@_query
def constraint_audit(spark, sf_dir):
    return audit.constraint_audit(tables.operational(spark, sf_dir, item_ids=True))


@_query
def total_audit(spark, sf_dir):
    return audit.total_audit(tables.orders(spark, sf_dir), tables.order_lines(spark, sf_dir))


@_query
def reconcile_totals(spark, sf_dir):
    return audit.reconcile_totals(tables.order_lines(spark, sf_dir), _fact(spark, sf_dir))


@_query
def count_drift(spark, sf_dir):
    after = tables.operational(spark, sf_dir)
    earlier = after["orders"].filter(f"order_date < TIMESTAMP_NTZ '{SNAPSHOT_DAY} 00:00:00'")
    items = after["order_items"].join(earlier.select("order_id"), "order_id", "left_semi")
    before = {**after, "orders": earlier, "order_items": items}
    before["fact_sales"] = star.fact_sales(items, earlier)
    after["fact_sales"] = star.fact_sales(after["order_items"], after["orders"])
    return audit.count_drift(before, after)


# Snapshots and runs


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_history(requests.run_steps(spark, sf_dir))


@_query
def latest_snapshot(spark, sf_dir):
    return runs.latest_snapshot(requests.manifest(spark, sf_dir))


@_query
def missing_snapshots(spark, sf_dir):
    return runs.missing_snapshots(
        requests.manifest(spark, sf_dir), requests.run_steps(spark, sf_dir)
    )


@_query
def latest_complete_run(spark, sf_dir):
    return runs.latest_complete_run(requests.manifest(spark, sf_dir))


@_query
def run_history(spark, sf_dir):
    total = F.aggregate(F.map_values("row_counts"), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return _history(spark, sf_dir).select(
        "run_id",
        "status",
        "started_at",
        "completed_at",
        F.col("error.step").alias("error_step"),
        total.alias("landed_rows"),
    )


@_query
def last_successful_run(spark, sf_dir):
    return runs.last_successful_run(_history(spark, sf_dir))


@_query
def log_counts(spark, sf_dir):
    return runs.log_counts(requests.run_log(spark, sf_dir), "event_id")


@_query
def logged_counts(spark, sf_dir):
    """The same counts out of log files: one folder per run, lines in their order."""
    path = f"{_store(spark)}/logs"
    log = requests.run_log(spark, sf_dir).sort("run_id", "event_id")
    log.select("run_id", F.col("line").alias("value")).write.partitionBy("run_id").text(path)
    return runs.log_counts(run_logs.read_logs(spark, path), "at")

from __future__ import annotations

import json
from datetime import UTC, date, datetime, timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from test_star_and_reports import table

from retail_engine.jobs import intake as intake_jobs
from retail_engine.jobs import submit, warehouse
from retail_engine import session
from retail_engine.operators import audit, display, intake, reports, runs
from retail_engine.schemas import MANIFEST, OPERATIONAL, REQUESTS, STEPS, WAREHOUSE
from retail_engine.sources import jdbc, snapshots

D = Decimal
DAY = date(2024, 2, 25)
NOON = datetime(2024, 2, 25, 12, tzinfo=UTC)


def entries(spark, *rows):
    return spark.createDataFrame(
        [(t, run, DAY, at, path, 1, 1) for t, run, at, path in rows], MANIFEST
    )


def test_latest_snapshot_per_table(spark):
    later = NOON + timedelta(hours=1)
    manifest = entries(
        spark,
        ("customers", "r1", NOON, "c1"),
        ("customers", "r2", later, "c2"),
        ("orders", "r1", NOON, "o1"),
        ("orders", "r2", NOON, "o2"),
        ("products", "r1", NOON, "p1"),
        ("products", "r2", later, "p2/"),
    )
    found = {r.table_name: r.path for r in runs.latest_snapshot(manifest).collect()}
    assert found == {"customers": "c2", "orders": "o2", "products": "p1"}


def test_only_complete_runs_count(spark):
    rows = [(t, "r1", NOON, t) for t in OPERATIONAL]
    rows += [(t, "r2", NOON + timedelta(hours=1), t) for t in list(OPERATIONAL)[:3]]
    manifest = entries(spark, *rows)
    assert runs.latest_complete_run(manifest).first().run_id == "r1"
    both = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "run_id string")
    missing = {tuple(r) for r in runs.missing_snapshots(manifest, both).collect()}
    assert missing == {("r2", "order_items")} | {("r3", t) for t in OPERATIONAL}


def test_log_counts(spark):
    lines = [
        "Extracted  150 rows from 'customers' -> uploaded",
        "  extracted 30 rows from 'products' -> uploaded",
        "Extracted 5 rows from 'staff' -> uploaded",
        "Table 'fact_sales': 2041 records loaded.",
        "Connection closed.",
        "Extracted  151 rows from 'customers' -> uploaded",
        "Table 'other': 3 records loaded.",
    ]
    log = spark.createDataFrame([("r", i, l) for i, l in enumerate(lines)], "run_id string, n int, line string")
    assert {tuple(r) for r in runs.log_counts(log, "n").collect()} == {
        ("r", "customers", 151), ("r", "products", 30), ("r", "fact_sales", 2041),
    }


def shop(spark, orders=2):
    return {
        "customers": table(
            spark, "customers",
            [dict(customer_id=1, first_name="A", last_name="B", email="a@b.c", city="Pune")],
        ),
        "products": table(
            spark, "products",
            [dict(product_id=1, name="Kettle", sku="k", category="Home", price=D("2.50"))],
        ),
        "orders": table(
            spark, "orders",
            [dict(order_id=i, customer_id=1, status="Pending", total_amount=D("5.00"),
                  order_date=datetime(2024, 1, i)) for i in range(1, orders + 1)],
        ),
        "order_items": table(
            spark, "order_items",
            [dict(order_item_id=i, order_id=i, product_id=1, quantity=2, unit_price=D("2.50"),
                  subtotal=D("5.00")) for i in range(1, orders + 1)],
        ),
    }


class Clock:
    def __init__(self):
        self.time = NOON

    def __call__(self):
        self.time += timedelta(seconds=1)
        return self.time


def test_two_runs_give_two_snapshots_and_the_later_star(spark, tmp_path):
    root, clock = str(tmp_path), Clock()
    first = warehouse.run(spark, shop(spark).__getitem__, root, "r1", clock)
    assert first == {
        "customers": 1, "products": 1, "orders": 2, "order_items": 2,
        "dim_customer": 1, "dim_product": 1, "fact_sales": 2,
    }
    warehouse.run(spark, shop(spark, 3).__getitem__, root, "r2", clock)
    star = snapshots.current_star(spark, root)
    assert reports.revenue_summary(star["fact_sales"]).first().totalRevenue == 15.0
    assert {n: t.schema for n, t in star.items()} == WAREHOUSE
    assert snapshots.manifest(spark, root).count() == 8
    assert snapshots.run_tables(spark, root, "r1")["orders"].count() == 2
    assert snapshots.latest_tables(spark, root)["orders"].count() == 3
    history = snapshots.run_history(spark, root).orderBy("run_id").collect()
    assert [(r.status, r.error) for r in history] == [("success", None)] * 2
    assert runs.last_successful_run(snapshots.run_history(spark, root)).first()[0] is not None
    drift = audit.count_drift(
        snapshots.run_tables(spark, root, "r1"), snapshots.run_tables(spark, root, "r2")
    )
    assert {r.table_name: r.drift for r in drift.collect()} == {
        "customers": 0, "products": 0, "orders": 1, "order_items": 1,
    }


def test_failed_run_names_its_step_and_keeps_the_star(spark, tmp_path):
    root, clock = str(tmp_path), Clock()
    warehouse.run(spark, shop(spark).__getitem__, root, "r1", clock)

    def broken(name):
        if name == "products":
            raise ValueError("no connection")
        return shop(spark, 5)[name]

    with pytest.raises(warehouse.RunFailed) as failure:
        warehouse.run(spark, broken, root, "r2", clock)
    assert failure.value.step == "land products"
    last = snapshots.run_history(spark, root).filter("run_id = 'r2'").first()
    assert (last.status, last.error.step, last.error.message) == (
        "failed", "land products", "no connection",
    )
    assert snapshots.current_star(spark, root)["fact_sales"].count() == 2
    history = snapshots.run_history(spark, root)
    good = history.filter("run_id = 'r1'").first().completed_at
    assert runs.last_successful_run(history).first()[0] == good


def test_all_failed_steps_are_named_and_other_counts_kept(spark, tmp_path):
    def broken(name):
        if name in ("products", "orders"):
            raise ValueError(f"no {name}")
        return shop(spark)[name]

    with pytest.raises(warehouse.RunFailed):
        warehouse.run(spark, broken, str(tmp_path), "r1", Clock())
    row = snapshots.run_history(spark, str(tmp_path)).first()
    assert row.error.asDict() == {
        "step": "land products, land orders", "message": "no products; no orders",
    }
    assert row.row_counts == {"customers": 1, "order_items": 2}


def test_run_history_out_of_steps(spark):
    rows = [
        ("r1", 1, "land", NOON, None, "orders", 5),
        ("r1", 2, "land", NOON + timedelta(hours=1), "lost", None, None),
        ("r1", 3, "land", NOON + timedelta(hours=2), None, "orders", 2),
        ("r2", 1, "land", NOON, None, "orders", 1),
        ("r2", 2, "publish", NOON, "full", None, None),
        ("r3", 1, "start", NOON, "no", None, None),
    ]
    found = {r.run_id: r for r in runs.run_history(spark.createDataFrame(rows, STEPS)).collect()}
    assert [found[r].status for r in ("r1", "r2", "r3")] == ["success", "failed", "failed"]
    assert found["r1"].row_counts == {"orders": 7} and found["r3"].row_counts == {}
    assert tuple(found["r2"].error) == ("publish", "full") and found["r1"].error is None
    assert found["r1"].completed_at - found["r1"].started_at == timedelta(hours=2)


def test_a_run_id_is_used_once(spark, tmp_path):
    root = str(tmp_path)
    warehouse.run(spark, shop(spark).__getitem__, root, "r1", Clock())
    with pytest.raises(warehouse.RunFailed) as failure:
        warehouse.run(spark, shop(spark, 9).__getitem__, root, "r1", Clock())
    assert isinstance(failure.value.__cause__, AnalysisException)
    assert snapshots.current_star(spark, root)["fact_sales"].count() == 2


def test_nothing_landed(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(snapshots.MissingSnapshots, match="customers, products, orders, order_items"):
        snapshots.latest_tables(spark, root)
    with pytest.raises(snapshots.MissingSnapshots):
        snapshots.run_tables(spark, root)
    with pytest.raises(snapshots.MissingSnapshots):
        snapshots.current_star(spark, root)


def test_empty_tables_run_through(spark, tmp_path):
    empty = {name: spark.createDataFrame([], schema) for name, schema in OPERATIONAL.items()}
    counts = warehouse.run(spark, empty.__getitem__, str(tmp_path), "r1", Clock())
    assert set(counts.values()) == {0}
    star = snapshots.current_star(spark, str(tmp_path))
    assert reports.revenue_summary(star["fact_sales"]).first().totalOrders == 0


ORDER = [(1, 1, "2024-02-25", None, [(1, "2")]), (2, 1, None, "Shipped", [(1, "1")])]


def take_order(spark, root, batch_id):
    asked = spark.createDataFrame(ORDER, REQUESTS["orders"])
    return intake_jobs.run(spark, root, "orders", asked, batch_id, NOON)


def test_a_batch_is_committed_as_a_whole(spark, tmp_path):
    root = str(tmp_path)
    warehouse.run(spark, shop(spark).__getitem__, root, "r1", Clock())
    before = snapshots.last_ids(spark, root)
    row = take_order(spark, root, "b1")
    assert row.row_counts == {"orders": 1, "order_items": 1, "rejected": 1}
    (order,) = snapshots.taken(spark, root, "orders").collect()
    (item,) = snapshots.taken(spark, root, "order_items").collect()
    assert order.order_id == item.order_id == before["orders"] + 1
    assert item.order_item_id == before["order_items"] + 1
    assert snapshots.current_tables(spark, root)["orders"].count() == 3
    rejected = spark.read.parquet(f"{root}/{row.paths['rejected']}").collect()
    assert [(r.request_seq, r.reason) for r in rejected] == [(2, "status_invalid")]
    # The next batch goes on from the ids that the manifest names.
    take_order(spark, root, "b2")
    ids = {r.order_id for r in snapshots.taken(spark, root, "orders").collect()}
    assert ids == {before["orders"] + 1, before["orders"] + 2}


def test_a_failure_between_two_writes_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    warehouse.run(spark, shop(spark).__getitem__, root, "r1", Clock())
    write, seen = snapshots._write_seen, []

    def fail_second(df, path, key):
        seen.append(path)
        if len(seen) == 2:
            raise OSError("disk full")
        return write(df, path, key)

    monkeypatch.setattr(snapshots, "_write_seen", fail_second)
    with pytest.raises(OSError):
        take_order(spark, root, "b1")
    monkeypatch.undo()
    assert len(seen) == 2 and snapshots.batches(spark, root).count() == 0
    for name, rows in (("orders", 2), ("order_items", 2)):
        assert snapshots.current_tables(spark, root)[name].count() == rows
    assert take_order(spark, root, "b2").row_counts["orders"] == 1


def test_nothing_of_a_batch_is_left_in_the_shared_folder(spark, tmp_path):
    root, shared = str(tmp_path), Path(session.shared_folder(spark).removeprefix("file:"))
    warehouse.run(spark, shop(spark).__getitem__, root, "r1", Clock())
    folders = lambda: {p.name for p in (shared / "retail").glob("*")}
    before = folders()
    asked = spark.createDataFrame(ORDER, REQUESTS["orders"])
    headers, lines = intake.split_requests(asked)
    outcome = intake_jobs.take_orders(
        headers, lines, snapshots.current_tables(spark, root), "2024-01-01 00:00:00"
    )
    assert len(folders() - before) == len(outcome.working) == 4
    outcome.discard()
    assert folders() == before
    take_order(spark, root, "b1")
    assert folders() == before


def test_intake_from_the_command_line(spark, tmp_path):
    root, asked = str(tmp_path / "lake"), tmp_path / "requests.json"
    warehouse.run(spark, shop(spark).__getitem__, root, "r1", Clock())
    asked.write_text(
        '{"request_seq": 1, "first_name": "A", "last_name": "B", "email": "new@b.c", "city": "X"}\n'
        '{"request_seq": 2, "first_name": "A", "last_name": "B", "email": "bad", "city": "X"}\n'
    )
    submit.main(
        ["intake", "--root", root, "--batch-id", "b1", "--kind", "customers",
         "--requests", str(asked), "--as-of", "2024-02-25T12:00:00"]
    )
    (row,) = snapshots.taken(spark, root, "customers").collect()
    assert (row.email, row.created_at) == ("new@b.c", datetime(2024, 2, 25, 12))


def test_json_reports(spark, tmp_path):
    report = spark.createDataFrame(
        [("Kettle", None, 3, 123456789.5)],
        "productName string, category string, totalUnits bigint, totalRevenue double",
    )
    expected = {
        "productName": "Kettle", "category": None, "totalUnits": 3, "totalRevenue": 123456789.5,
    }
    text = display.as_json(report).first().json
    assert json.loads(text) == expected
    assert '"totalRevenue":123456789.50' in text
    display.write_json(report, str(tmp_path / "out"))
    (line,) = spark.read.text(str(tmp_path / "out")).collect()
    assert json.loads(line.value) == expected


def test_key_ranges_cover_the_table():
    assert jdbc.key_range_options("orders", 1, 1000, 16) == {
        "partitionColumn": "order_id", "lowerBound": "1", "upperBound": "1000",
        "numPartitions": "16",
    }
    assert jdbc.key_range_options("orders", 5, 5, 2)["upperBound"] == "6"


def test_command_line(spark, tmp_path):
    for name, rows in shop(spark).items():
        rows.write.parquet(str(tmp_path / "in" / name))
    root, out = str(tmp_path / "lake"), tmp_path / "out"
    submit.main(["run", "--root", root, "--run-id", "r1", "--tables", str(tmp_path / "in")])
    submit.main(["report", "--root", root, "--name", "sales_by_product", "--out", str(out)])
    (line,) = spark.read.text(str(out)).collect()
    assert json.loads(line.value) == {
        "productName": "Kettle", "category": "Home", "totalUnits": 4, "totalRevenue": 10.0,
    }
    listed = tmp_path / "listed"
    submit.main(["report", "--root", root, "--name", "orders", "--out", str(listed)])
    lines = [json.loads(r.value) for r in spark.read.text(str(listed)).collect()]
    assert sorted((r["order_id"], r["item_count"]) for r in lines) == [(1, 1), (2, 1)]


def test_taking_in_moves_the_next_run(spark, tmp_path):
    """One more customer, product and order: each table grows by one."""
    tables, as_of = shop(spark), "2024-05-05 00:00:00"
    people = spark.createDataFrame(
        [(1, "New", "One", "new@b.c", None, "Pune"), (2, "Old", "One", "a@b.c", None, "Pune")],
        "request_seq bigint, first_name string, last_name string, email string, phone string, "
        "city string",
    )
    taken = intake_jobs.take_customers(people, tables["customers"], as_of)
    assert [(r.request_seq, r.reason) for r in taken.rejected.collect()] == [(2, "email_taken")]
    tables["customers"] = tables["customers"].unionByName(taken.rows["customers"])
    goods = spark.createDataFrame(
        [(1, "Cup", "cup", "Home", "3.10")],
        "request_seq bigint, name string, sku string, category string, price string",
    )
    offered = intake_jobs.take_products(goods, tables["products"], as_of)
    tables["products"] = tables["products"].unionByName(offered.rows["products"])
    headers = spark.createDataFrame(
        [(1, 2, None, None), (2, 2, None, None)],
        "request_seq bigint, customer_id bigint, order_date string, status string",
    )
    lines = spark.createDataFrame(
        [(1, 0, 2, "2"), (2, 0, 9, "1")],
        "request_seq bigint, pos bigint, product_id bigint, quantity string",
    )
    ordered = intake_jobs.take_orders(headers, lines, tables, as_of)
    (order,) = ordered.rows["orders"].collect()
    assert (order.order_id, order.customer_id, order.status, order.total_amount) == (
        3, 2, "Pending", D("6.20"),
    )
    (item,) = ordered.rows["order_items"].collect()
    assert tuple(item) == (3, 3, 2, 2, D("3.10"), D("6.20"))
    assert [r.reason for r in ordered.rejected.collect()] == ["product_unknown"]
    before = warehouse.run(spark, shop(spark).__getitem__, str(tmp_path), "r1", Clock())
    for name, rows in ordered.rows.items():
        tables[name] = tables[name].unionByName(rows)
    after = warehouse.run(spark, tables.__getitem__, str(tmp_path), "r2", Clock())
    assert {t: after[t] - before[t] for t in after} == dict.fromkeys(after, 1)

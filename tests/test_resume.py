"""Runs that fail are resumed; what they and others leave is swept."""

from __future__ import annotations

import os
from datetime import UTC, datetime, timedelta

import pytest
from test_commits import AT, products
from test_snapshots_and_runs import ORDER, Clock, shop

from retail_engine.jobs import intake as intake_jobs
from retail_engine.jobs import storage, warehouse
from retail_engine.schemas import OPERATIONAL, REQUESTS
from retail_engine.sources import commits, snapshots


@pytest.mark.parametrize("broken", ["land", "record", "run_tables", "write_version", "publish"])
def test_a_run_goes_on_after_the_step_that_failed(spark, tmp_path, monkeypatch, broken):
    root, asked, real = str(tmp_path), [], getattr(snapshots, broken)

    def read(table):
        asked.append(table)
        return shop(spark)[table]

    def fail(*args):
        # Of the tables one fails to land, after its files are written.
        found = real(*args) if broken in ("land", "write_version") else None
        if broken == "land" and args[2] != "products":
            return found
        raise OSError(f"no {broken}")

    monkeypatch.setattr(snapshots, broken, fail)
    with pytest.raises(warehouse.RunFailed):
        warehouse.run(spark, read, root, "r1", Clock())
    monkeypatch.undo()
    with pytest.raises(snapshots.MissingSnapshots):
        snapshots.current_star(spark, root)
    counts = warehouse.run(spark, read, root, "r1", Clock())
    again = ["products"] if broken == "land" else []
    assert sorted(asked) == sorted([*OPERATIONAL, *again])
    assert counts["products"] == 1 and counts["fact_sales"] == 2
    assert snapshots.manifest(spark, root).count() == 4
    assert snapshots.published(spark, root).count() == 1
    assert snapshots.current_star(spark, root)["fact_sales"].count() == 2
    assert {r.status for r in snapshots.run_history(spark, root).collect()} == {"failed", "success"}


def test_a_run_that_died_unseen_goes_on(spark, tmp_path, monkeypatch):
    root = str(tmp_path)

    def die(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(snapshots, "publish", die)
    with pytest.raises(KeyboardInterrupt):
        warehouse.run(spark, shop(spark).__getitem__, root, "r1", Clock())
    monkeypatch.undo()
    # Nothing is landed again, so nothing is read.
    warehouse.run(spark, lambda table: 1 / 0, root, "r1", Clock())
    assert snapshots.current_star(spark, root)["fact_sales"].count() == 2


def test_a_sweep_takes_what_nothing_names(spark, tmp_path):
    # Folders above the root may be called like those below it.
    root = str(tmp_path / "data" / "raw" / "x")
    warehouse.run(spark, shop(spark).__getitem__, root, "r1", Clock())
    asked = spark.createDataFrame(ORDER, REQUESTS["orders"])
    row = intake_jobs.run(spark, root, "orders", asked, "b1", AT)
    written = storage.write_clustered(spark, root, "products", products(spark, [7, 8]), 2)
    left = written[0].path.rsplit("/", 1)[0]
    products(spark, [1]).write.parquet(f"{root}/raw/products/2020-01-01/r0")
    products(spark, [1]).write.parquet(f"{root}/warehouse/r0/dim_product")
    products(spark, [1]).write.parquet(f"{root}/intake/b0/try/products")
    new = products(spark, [1], 9.0)
    first = storage.upsert_rows(spark, root, "products", new, AT)
    second = storage.upsert_rows(spark, root, "products", new, AT + timedelta(hours=2))
    names = {"products": 1, "orders": 3, "order_items": 3, "customers": 1}
    tables = lambda: {
        n: t.count() for n, t in snapshots.current_tables(spark, root).items()
    }
    before = tables()
    assert before["products"] == names["products"] and before["orders"] == names["orders"]
    # Young folders stay.
    assert storage.sweep(spark, root, AT - timedelta(days=1)) == []
    for folder, _, files in os.walk(tmp_path):
        for name in files:
            if name.endswith(".parquet"):
                old = (AT - timedelta(days=9)).replace(tzinfo=UTC).timestamp()
                os.utime(f"{folder}/{name}", (old, old))
    swept = storage.sweep(spark, root, AT + timedelta(hours=1))
    gone = {p for p in first.gone if "/" in p}
    assert set(swept) == gone | {
        left, "raw/products/2020-01-01/r0", "warehouse/r0", "intake/b0/try",
    }
    # What the second change replaced is too young to go; all named tables are whole.
    assert all(commits.exists(spark, f"{root}/{p}") for p in second.gone)
    assert tables() == before
    assert snapshots.current_star(spark, root)["fact_sales"].count() == 2
    assert spark.read.parquet(f"{root}/{row.paths['rejected']}").count() == 1
    assert storage.sweep(spark, root, AT + timedelta(hours=1)) == []

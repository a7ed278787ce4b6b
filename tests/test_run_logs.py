from __future__ import annotations

import os

from test_snapshots_and_runs import Clock, shop

from retail_engine.jobs import warehouse
from retail_engine.operators import runs
from retail_engine.sources import run_logs, snapshots


def test_the_last_count_over_blocks_and_files(spark, tmp_path):
    root = tmp_path / "logs"
    for run, parts in (("r1", 2), ("r 2", 1)):
        (root / run).mkdir(parents=True)
        for part in range(parts):
            lines = [
                f"Extracted {part * 100_000 + i:7d} rows from 'orders' {'.' * 60}"
                for i in range(5000)
            ]
            (root / run / f"{part:03d}.log").write_text("\n".join([*lines, "noise", ""]))
    # Several blocks a file, several files a task, and more.
    for size in ("64k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            log = run_logs.read_logs(spark, str(root))
            found = runs.log_counts(log, "at").collect()
            tasks = log.rdd.getNumPartitions()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert size != "64k" or tasks > 10
        assert sorted(map(tuple, found)) == [("r 2", "orders", 4999), ("r1", "orders", 104_999)]


def test_snapshots_found_by_listing_are_those_of_the_manifest(spark, tmp_path):
    root = str(tmp_path)
    assert run_logs.landed_folders(spark, root).count() == 0
    clock = Clock()
    for run in ("r1", "r2"):
        warehouse.run(spark, shop(spark).__getitem__, root, run, clock)
    # A marker, a folder of another form, and a file that is being written do not count.
    (tmp_path / "raw/orders/2030-01-01/r9/_temporary").mkdir(parents=True)
    (tmp_path / "raw/orders/2030-01-01/r9/_temporary/part-0.parquet").write_text("x")
    (tmp_path / "raw/orders/stray.parquet").write_text("x")
    found = run_logs.landed_folders(spark, root)
    assert "content" not in found.columns and found.count() == 8
    by_listing = {r.table_name: r.path for r in runs.latest_snapshot(found).collect()}
    newest = runs.latest_snapshot(snapshots.manifest(spark, root)).collect()
    assert by_listing == {r.table_name: r.path for r in newest}
    # Of snapshots of one time the larger run id is the newest.
    for folder, _, names in os.walk(tmp_path / "raw/orders"):
        for name in names:
            os.utime(f"{folder}/{name}", (1_700_000_000, 1_700_000_000))
    newest = runs.latest_snapshot(run_logs.landed_folders(spark, root)).collect()
    assert {r.run_id for r in newest if r.table_name == "orders"} == {"r2"}

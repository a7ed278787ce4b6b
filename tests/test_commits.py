"""The commit log: several writers, compaction, changes of the files they touch."""

from __future__ import annotations

import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_snapshots_and_runs import ORDER, Clock, shop

from retail_engine.jobs import intake as intake_jobs
from retail_engine.jobs import storage, warehouse
from retail_engine.operators import changes
from retail_engine.schemas import OPERATIONAL, REQUESTS, conform
from retail_engine.sources import commits, snapshots
from retail_engine.sources.commits import Commit, Conflict, File

AT = datetime(2024, 2, 25, 12)


def at_once(*work):
    """Run functions in threads; their results, or what they raised."""
    found = [None] * len(work)

    def call(i):
        try:
            found[i] = work[i]()
        except Exception as error:  # noqa: BLE001
            found[i] = error

    threads = [threading.Thread(target=call, args=(i,)) for i in range(len(work))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return found


def products(spark, ids, price=1.0, tag=""):
    rows = spark.createDataFrame([(i,) for i in ids], "product_id bigint")
    return conform(
        rows.selectExpr(
            "product_id", f"concat('n{tag}', product_id) AS name", "concat('S', product_id) AS sku",
            "'c' AS category", f"{price} AS price", "TIMESTAMP '2020-01-01' AS created_at",
            "TIMESTAMP '2020-01-01' AS updated_at",
        ),
        OPERATIONAL["products"],
    )


def test_one_of_many_writers_gets_a_number(spark, tmp_path):
    path = f"{tmp_path}/log/000001.json"
    won = at_once(*[lambda i=i: commits.put_if_absent(spark, path, f"{i}" * 5000) for i in range(16)])
    assert sorted(won) == [False] * 15 + [True]
    assert commits.text_of(spark, path) == f"{won.index(True)}" * 5000
    assert commits.listed(spark, f"{tmp_path}/log").keys() == {"000001.json"}


@pytest.mark.parametrize("staged", [True, False])
def test_other_file_systems_keep_the_first(spark, tmp_path, staged):
    name, fs = commits._path(spark, f"{tmp_path}/log/1.json")
    assert commits._put_by_file_system(spark, name, fs, "first", staged)
    assert not commits._put_by_file_system(spark, name, fs, "second", staged)
    assert commits.text_of(spark, f"{tmp_path}/log/1.json") == "first"


def test_reserved_ids_never_overlap(spark, tmp_path):
    root = str(tmp_path)
    before = at_once(*[lambda: commits.reserve(spark, root, "orders", 10, 500) for _ in range(12)])
    assert sorted(before) == [500 + 10 * i for i in range(12)]
    # The table got larger ids from elsewhere.
    assert commits.reserve(spark, root, "orders", 1, 9000) == 9000


def test_commits_of_unrelated_changes_follow_each_other(spark, tmp_path):
    root = str(tmp_path)
    state = commits.read(spark, root)
    change = lambda i: Commit(
        "batch", AT, files=(File("orders", f"o{i}", 1),), reads=("customers",), batch_id=f"b{i}"
    )
    ended = at_once(*[lambda i=i: commits.commit(spark, root, state, change(i)) for i in range(8)])
    assert sorted(s.number for s in ended) == list(range(1, 9))
    assert set(commits.read(spark, root).files) == {f"o{i}" for i in range(8)}
    with pytest.raises(ValueError, match="already"):
        commits.commit(spark, root, state, change(3))
    customers = Commit("batch", AT, files=(File("customers", "c", 1),), reads=("customers",), batch_id="c")
    commits.commit(spark, root, state, customers)
    with pytest.raises(Conflict):
        commits.commit(spark, root, state, change(9))


PEOPLE = [
    (1, "A", "B", "same@b.c", None, "X"),
    (2, "A", "B", "{}@b.c", None, "X"),
]


def people(spark, name):
    rows = [tuple(v.format(name) if isinstance(v, str) else v for v in r) for r in PEOPLE]
    return spark.createDataFrame(rows, REQUESTS["customers"])


def test_two_batches_from_the_same_state(spark, tmp_path, monkeypatch):
    root, states = str(tmp_path), []
    warehouse.run(spark, shop(spark).__getitem__, root, "r1", Clock())
    both, commit = threading.Barrier(2), commits.commit

    def together(spark, root, state, change):
        if state.number == 0:
            both.wait(timeout=120)
        states.append(state.number)
        return commit(spark, root, state, change)

    monkeypatch.setattr(commits, "commit", together)
    take = lambda name: intake_jobs.run(
        spark, root, "customers", people(spark, name), name, AT
    )
    rows = at_once(lambda: take("x"), lambda: take("y"))
    monkeypatch.undo()
    # Both began on the empty log; the one that lost was judged again on the other's rows.
    assert sorted(states) == [0, 0, 1]
    assert sorted(r.row_counts["customers"] for r in rows) == [1, 2]
    added = snapshots.taken(spark, root, "customers").collect()
    assert sorted(r.email for r in added) == ["same@b.c", "x@b.c", "y@b.c"]
    assert len({r.customer_id for r in added}) == 3
    loser = min(rows, key=lambda r: r.row_counts["customers"])
    (rejected,) = spark.read.parquet(f"{root}/{loser.paths['rejected']}").collect()
    assert rejected.reason == "email_taken"
    # What the first try had written is gone.
    assert len(commits.listed(spark, f"{root}/intake/{loser.batch_id}")) == 1


def test_orders_are_taken_in_at_once_without_a_second_try(spark, tmp_path):
    root = str(tmp_path)
    warehouse.run(spark, shop(spark).__getitem__, root, "r1", Clock())
    last = snapshots.last_ids(spark, root)
    asked = spark.createDataFrame(ORDER, REQUESTS["orders"])
    rows = at_once(
        *[lambda b=b: intake_jobs.run(spark, root, "orders", asked, b, AT, attempts=1) for b in "pqr"]
    )
    assert [r.row_counts["orders"] for r in rows] == [1, 1, 1]
    ids = sorted(r.order_id for r in snapshots.taken(spark, root, "orders").collect())
    assert ids == [last["orders"] + i for i in (1, 2, 3)]
    items = snapshots.taken(spark, root, "order_items").collect()
    assert sorted(r.order_id for r in items) == ids
    assert snapshots.last_ids(spark, root)["orders"] == ids[-1]


def many_batches(spark, root, number=1000):
    """A log of small batches of products, each in a file of its own."""
    rows = products(spark, range(1, number + 1))
    rows.repartitionByRange(number, "product_id").write.parquet(f"{root}/intake/all")
    state = commits.read(spark, root)
    for file in storage.described(spark, root, "products", "intake/all"):
        batch = Commit("batch", AT, files=(file,), batch_id=file.path, row_counts={"products": file.rows})
        state = commits.commit(spark, root, state, batch)
    return state


def test_many_batches_are_packed_into_few_files(spark, tmp_path, monkeypatch):
    root, opened = str(tmp_path), []
    before = many_batches(spark, root)
    assert before.number == len(before.of("products")) > 900
    old = snapshots.taken(spark, root, "products", before)
    storage.compact(spark, root, "products", AT)
    text = commits.text_of
    monkeypatch.setattr(commits, "text_of", lambda s, path: opened.append(path) or text(s, path))
    after = commits.read(spark, root)
    assert opened == [] and len(after.of("products")) == 1
    assert len(commits.listed(spark, f"{root}/checkpoints")) <= commits._CHECKPOINTS_KEPT
    new = snapshots.taken(spark, root, "products")
    assert len(new.inputFiles()) == 1
    assert sorted(new.collect()) == sorted(old.collect()) and new.count() == 1000
    assert snapshots.batches(spark, root).count() == before.number
    # A batch committed on the state before joins the packed file.
    late = Commit("batch", AT, files=(File("products", "intake/late", 1),), batch_id="late")
    assert len(commits.commit(spark, root, before, late).of("products")) == 2
    assert storage.compact(spark, root, "orders", AT) is None


def test_packing_leaves_large_files_alone(spark, tmp_path):
    root = str(tmp_path)
    state = many_batches(spark, root, 6)
    size = max(f.bytes for f in state.of("products"))
    assert storage.compact(spark, root, "products", AT, target=size) is None
    storage.compact(spark, root, "products", AT, target=6 * size)
    assert len(commits.read(spark, root).of("products")) == 1


def adopted(spark, root, rows, files):
    written = storage.write_clustered(spark, root, "products", rows, files)
    state = commits.read(spark, root)
    return commits.commit(spark, root, state, Commit("adopt", AT, files=written, adopted=("products",)))


def test_an_upsert_rewrites_the_files_it_touches(spark, tmp_path):
    root, old = str(tmp_path), products(spark, range(0, 20_000, 2))
    state = adopted(spark, root, old, 100)
    assert len(state.of("products")) > 90
    # Nine old keys, of which three lie side by side, and a new one amid them.
    new = products(spark, [10, 12, 14, 15, 4000, 8000, 12000, 16000, 19000, 19998], 5.0, "new")
    change = storage.upsert_rows(spark, root, "products", new, AT)
    assert 7 <= len(change.gone) <= 10 and len(change.files) <= 10
    found = snapshots.taken(spark, root, "products")
    want = changes.upsert(old, new, "product_id", "2024-02-25 12:00:00")
    assert sorted(found.collect()) == sorted(want.collect())
    kept = {f.path for f in state.of("products")} - set(change.gone)
    assert kept <= set(commits.read(spark, root).files)
    # Readers of the version before see it unchanged.
    assert sorted(snapshots.taken(spark, root, "products", state).collect()) == sorted(old.collect())


def test_more_keys_than_the_driver_looks_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "_KEYS_LOOKED_UP", 3)
    root, old = str(tmp_path), products(spark, range(1000))
    adopted(spark, root, old, 10)
    change = storage.delete_rows(spark, root, "products", products(spark, [1, 2, 3, 998, 5000]), AT)
    assert len(change.gone) == 2
    left = {r.product_id for r in snapshots.taken(spark, root, "products").collect()}
    assert left == set(range(1000)) - {1, 2, 3, 998}


def test_upserts_of_nothing_and_into_nothing(spark, tmp_path):
    root = str(tmp_path)
    adopted(spark, root, products(spark, []), 1)
    assert storage.upsert_rows(spark, root, "products", products(spark, []), AT) is None
    storage.upsert_rows(spark, root, "products", products(spark, [5]), AT)
    assert snapshots.taken(spark, root, "products").count() == 1


def test_a_change_of_files_that_were_packed_meanwhile_is_done_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    adopted(spark, root, products(spark, range(100)), 4)
    commit, done = commits.commit, []

    def packed_first(spark, root, state, change):
        if change.kind == "delete" and not done:
            done.append(storage.compact(spark, root, "products", AT))
        return commit(spark, root, state, change)

    monkeypatch.setattr(commits, "commit", packed_first)
    storage.delete_rows(spark, root, "products", products(spark, [7]), AT)
    assert len(done[0].gone) == 4
    assert snapshots.taken(spark, root, "products").count() == 99


def test_a_snapshot_is_taken_over_with_what_was_added(spark, tmp_path):
    root = str(tmp_path)
    warehouse.run(spark, shop(spark).__getitem__, root, "r1", Clock())
    asked = spark.createDataFrame(ORDER, REQUESTS["orders"])
    intake_jobs.run(spark, root, "orders", asked, "b1", AT)
    gone = spark.createDataFrame([(1,)], "order_id bigint")
    storage.delete_rows(spark, root, "orders", gone, AT)
    assert [r.order_id for r in snapshots.current_tables(spark, root)["orders"].collect()] == [2, 3]
    # A later snapshot does not bring the row back; a later batch adds to the table.
    warehouse.run(spark, shop(spark).__getitem__, root, "r2", Clock())
    intake_jobs.run(spark, root, "orders", asked, "b2", AT)
    left = snapshots.current_tables(spark, root)["orders"].select(F.collect_set("order_id")).first()[0]
    assert sorted(left) == [2, 3, 4]


def offers(spark, skus):
    rows = [(i, f"n{s}", s, "c", "2.50") for i, s in enumerate(skus)]
    return spark.createDataFrame(rows, REQUESTS["products"])


def skus_read(spark, root, state, asked):
    return {
        f.rsplit("/", 1)[1]
        for f in snapshots.keys_near(spark, root, "product_skus", state, asked).inputFiles()
    }


def test_a_batch_reads_the_buckets_of_its_keys(spark, tmp_path):
    root = str(tmp_path)
    tables = shop(spark) | {"products": products(spark, range(1, 5001))}
    warehouse.run(spark, tables.__getitem__, root, "r1", Clock())
    storage.adopt(spark, root, "products", AT)
    state = commits.read(spark, root)
    index = state.of("product_skus")
    assert len(index) > 150 and sum(f.rows for f in index) == 5000
    asked = offers(spark, ["S17", " S4000 ", "S5001", "new", "S5001"])
    assert 1 <= len(skus_read(spark, root, state, asked)) <= 4
    take = lambda batch, asked: intake_jobs.run(spark, root, "products", asked, batch, AT)
    row = take("b1", asked)
    rejected = spark.read.parquet(f"{root}/{row.paths['rejected']}").collect()
    assert sorted((r.request_seq, r.reason) for r in rejected) == [
        (0, "sku_taken"), (1, "sku_taken"), (4, "sku_taken"),
    ]
    # Keys of the batch are in the index; those of changed and deleted rows follow.
    assert take("b2", offers(spark, ["new", "S5001"])).row_counts["products"] == 0
    moved = products(spark, [17]).withColumn("sku", F.lit("moved"))
    storage.upsert_rows(spark, root, "products", moved, AT)
    storage.delete_rows(spark, root, "products", products(spark, [4000]), AT)
    row = take("b3", offers(spark, ["S17", "S4000", "moved", "S18"]))
    rejected = spark.read.parquet(f"{root}/{row.paths['rejected']}").collect()
    assert sorted(r.request_seq for r in rejected) == [2, 3]
    keys = snapshots.taken(spark, root, "product_skus").select("key").collect()
    current = snapshots.current_tables(spark, root)["products"].select("sku").collect()
    assert sorted(keys) == sorted(current)

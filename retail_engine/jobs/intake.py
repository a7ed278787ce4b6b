"""Intake as jobs: requests in, rows of the operational tables and rejections out.

Ids go on from the last one of the table, in the order of the requests. A judged batch is
checkpointed, since its ids, rows and rejections have to agree on what was accepted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from retail_engine.operators import intake, ranking
from retail_engine.schemas import KEY_INDEX, OPERATIONAL, PRIMARY_KEY, conform
from retail_engine.session import checkpointed, remove, working_tables
from retail_engine.sources import commits, snapshots

Tables = dict[str, DataFrame]
#: The last id of each table, or a function that reserves so many ids of a table and returns
#: the one before the first.
LastIds = dict[str, int] | Callable[[str, int], int]

#: What the acceptance of each kind of request depends on.
READS = {
    "customers": ("customers",),
    "products": ("products",),
    "orders": ("customers", "products"),
}


@dataclass(frozen=True)
class Outcome:
    """New rows by operational table, and the rejected requests with their reasons.

    `working` names the folders of the tables that both are read from, until discard().
    """

    rows: Tables
    rejected: DataFrame
    working: list[str] = field(default_factory=list)

    def discard(self) -> None:
        """Remove the working tables; the rows and rejections cannot be read any more."""
        remove(self.rejected.sparkSession, self.working)


def _outcome(take: Callable[..., Outcome]) -> Callable[..., Outcome]:
    def taken(*args, **kwargs) -> Outcome:
        with working_tables() as folders:
            found = take(*args, **kwargs)
        return Outcome(found.rows, found.rejected, folders)

    taken.__doc__ = take.__doc__
    return taken


def _created(new: DataFrame, table: str, as_of: str) -> DataFrame:
    """Rows as the table keeps them, created and last changed at `as_of`."""
    stamp = F.lit(as_of).cast("timestamp")
    return conform(new.withColumns({"created_at": stamp, "updated_at": stamp}), OPERATIONAL[table])


def _numbered(
    new: DataFrame, table: str, tables: Tables, last: LastIds | None, *order: str
) -> DataFrame:
    """`new` with ids after the last one, which is looked up in the table unless given."""
    key = PRIMARY_KEY[table]
    if last is None:
        known = ranking.largest_id(tables[table], key)
    else:
        known = last(table, new.count()) if callable(last) else last[table]
    return ranking.next_ids(new, known, key, [F.asc(c) for c in order])


@_outcome
def take_customers(
    requests: DataFrame, existing: DataFrame, as_of: str, last: LastIds | None = None
) -> Outcome:
    """New customers; `last` has the last id given in each table, if that is known."""
    judged = checkpointed(intake.validate_customers(requests, existing))
    new = intake.clean_customers(intake.accepted(judged))
    new = _numbered(new, "customers", {"customers": existing}, last, "request_seq")
    return Outcome({"customers": _created(new, "customers", as_of)}, intake.rejected(judged))


@_outcome
def take_products(
    requests: DataFrame, existing: DataFrame, as_of: str, last: LastIds | None = None
) -> Outcome:
    """New products; `last` as for customers."""
    judged = checkpointed(intake.validate_products(requests, existing))
    new = intake.clean_products(intake.accepted(judged))
    new = _numbered(new, "products", {"products": existing}, last, "request_seq")
    return Outcome({"products": _created(new, "products", as_of)}, intake.rejected(judged))


@_outcome
def take_orders(
    headers: DataFrame,
    lines: DataFrame,
    tables: Tables,
    as_of: str,
    last: LastIds | None = None,
) -> Outcome:
    """Orders and their items, priced once from the catalogue in `tables`."""
    priced = checkpointed(intake.priced_lines(lines, tables["products"]))
    judged = checkpointed(intake.validate_orders(headers, priced, tables["customers"]))
    new = intake.accepted_orders(judged, as_of)
    new_orders = _numbered(new, "orders", tables, last, "request_seq")
    new_lines = intake.accepted_lines(judged, priced).join(
        new_orders.select("request_seq", "order_id"), "request_seq"
    )
    new_items = _numbered(new_lines, "order_items", tables, last, "order_id", "pos")
    return Outcome(
        {
            "orders": _created(new_orders, "orders", as_of),
            "order_items": conform(new_items, OPERATIONAL["order_items"]),
        },
        intake.rejected(judged),
    )


def run(
    spark: SparkSession,
    root: str,
    kind: str,
    requests: DataFrame,
    batch_id: str,
    at: datetime,
    attempts: int = 20,
) -> Row:
    """Take in a batch of `kind` on top of the tables under `root` and commit it as a whole.

    Other batches may be taken in at the same time: ids are reserved, and when one of them
    commits what this one's ruling depends on, this one is judged again on the new tables.
    """
    as_of = f"{at:%Y-%m-%d %H:%M:%S}"
    landed = snapshots.last_ids(spark, root)

    def reserve(table: str, count: int) -> int:
        return commits.reserve(spark, root, table, count, landed[table])

    for attempt in range(attempts):
        state = commits.read(spark, root)
        tables = snapshots.current_tables(spark, root, state)

        if kind == "orders":
            headers, lines = intake.split_requests(requests)
            outcome = take_orders(headers, lines, tables, as_of, reserve)
        else:
            take = {"customers": take_customers, "products": take_products}[kind]
            index = next(i for i, (of, _) in KEY_INDEX.items() if of == kind)
            existing = tables[kind]
            if index in state.adopted:
                existing = snapshots.keys_near(spark, root, index, state, requests)
            outcome = take(requests, existing, as_of, reserve)
        try:
            return snapshots.commit_batch(
                spark, root, batch_id, at, outcome.rows, outcome.rejected, state, READS[kind]
            )
        except commits.Conflict:
            if attempt + 1 == attempts:
                raise
        finally:
            outcome.discard()
    raise ValueError("attempts must be positive")

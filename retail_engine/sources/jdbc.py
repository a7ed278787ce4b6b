"""Operational tables over a database connection, read in parallel ranges of the key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retail_engine.schemas import OPERATIONAL, PRIMARY_KEY, conform


def key_range_options(table: str, lowest: int, highest: int, partitions: int) -> dict[str, str]:
    """Reader options that cut the table into `partitions` ranges of its key."""
    return {
        "partitionColumn": PRIMARY_KEY[table],
        "lowerBound": str(lowest),
        "upperBound": str(max(highest, lowest + 1)),
        "numPartitions": str(partitions),
    }


def pieces_sql(table: str, key: str, low: int, high: int, width: int) -> str:
    """Rows of each piece of `width` keys from `low` to below `high`; empty pieces are left out."""
    start = f"{key} - MOD({key} - {low}, {width})"
    where = f"{key} >= {low} AND {key} < {high}"
    return f"SELECT {start} AS start, COUNT(*) AS n FROM {table} WHERE {where} GROUP BY {start}"


def balanced_starts(
    count: Callable[[int, int, int], dict[int, int]], lowest: int, highest: int, partitions: int
) -> list[int]:
    """First keys of ranges of a unique key, none with more rows than an even share.

    `count(low, high, width)` gives the rows by first key of a piece, as pieces_sql() does.
    The keys are counted in pieces of one width, and a piece with more than a share is counted
    again in finer ones, so gaps and dense stretches cost a few counts and no empty or full
    task. There are at most twice as many ranges as `partitions`.
    """
    pieces_a_count = 8 * partitions

    def counted(low: int, high: int, share: int | None) -> tuple[list[tuple[int, int]], int]:
        width = -(-(high - low) // pieces_a_count)
        found = sorted(count(low, high, width).items())
        share = share or max(1, -(-sum(n for _, n in found) // partitions))
        fine: list[tuple[int, int]] = []
        for start, rows in found:
            if rows > share and width > 1:
                fine += counted(start, min(start + width, high), share)[0]
            else:
                fine.append((start, rows))
        return fine, share

    fine, share = counted(lowest, highest + 1, None)
    starts: list[int] = []
    held = 0
    for start, rows in fine:
        if not starts or held + rows > share:
            starts.append(start)
            held = 0
        held += rows
    return starts


def range_predicates(key: str, starts: list[int]) -> list[str]:
    """One condition a range; the first and the last are open, so every key is in one."""
    lows = [None, *starts[1:]]
    highs = [*starts[1:], None]
    found = []
    for low, high in zip(lows, highs, strict=True):
        ends = [f"{key} >= {low}"] if low is not None else []
        ends += [f"{key} < {high}"] if high is not None else []
        found.append(" AND ".join(ends) or "1 = 1")
    return found


def changed_condition(since: str, until: str) -> str:
    """Rows last changed from `since` to before `until`, the mark that the next read begins at."""
    return f"updated_at >= TIMESTAMP '{since}' AND updated_at < TIMESTAMP '{until}'"


def read_table(
    spark: SparkSession,
    connection: dict[str, str],
    table: str,
    partitions: int,
    fetch_size: int = 10_000,
    balanced: bool = True,
    changed: tuple[str, str] | None = None,
) -> DataFrame:
    """All rows of `table`; `connection` holds url, user, password and driver.

    One row with the key range comes first; the ranges then load side by side, and no task
    holds more than one fetch of rows. Filters and columns asked for later are pushed into
    the database query. Ranges are of equal row counts if `balanced`, which counts the key's
    index once, else of equal width. With `changed`, a pair of times, only rows changed from
    the first to before the second are read, in ranges of all rows' keys.
    """
    reader = spark.read.format("jdbc").options(**connection).option("fetchsize", fetch_size)
    key = PRIMARY_KEY[table]
    bounds = (
        reader.option("query", f"SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}")
        .load()
        .first()
    )
    reader = spark.read.format("jdbc").options(**connection).option("fetchsize", fetch_size)
    wanted = changed_condition(*changed) if changed else None
    if bounds[0] is not None and balanced:

        def count(low: int, high: int, width: int) -> dict[int, int]:
            query = pieces_sql(table, key, low, high, width)
            return {int(r[0]): int(r[1]) for r in reader.option("query", query).load().collect()}

        starts = balanced_starts(count, int(bounds[0]), int(bounds[1]), partitions)
        ranges = range_predicates(key, starts)
        if wanted:
            ranges = [f"({r}) AND {wanted}" for r in ranges]
        properties = {k: v for k, v in connection.items() if k != "url"}
        rows = spark.read.jdbc(
            connection["url"],
            table,
            predicates=ranges,
            properties={**properties, "fetchsize": str(fetch_size)},
        )
        return conform(rows, OPERATIONAL[table])
    reader = spark.read.format("jdbc").options(**connection).option("fetchsize", fetch_size)
    source = f"(SELECT * FROM {table} WHERE {wanted}) t" if wanted else table
    reader = reader.option("dbtable", source)
    if bounds[0] is not None:
        lowest, highest = int(bounds[0]), int(bounds[1])
        reader = reader.options(**key_range_options(table, lowest, highest, partitions))
    return conform(reader.load(), OPERATIONAL[table])

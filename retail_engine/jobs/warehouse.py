"""The whole run: land the operational tables, build the star schema, publish it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from retail_engine import session
from retail_engine.operators import runs, star
from retail_engine.schemas import OPERATIONAL, RUNS, STEPS
from retail_engine.sources import commits, snapshots


class RunFailed(Exception):
    """A run ended early; `step` names the step that failed, or all that did."""

    def __init__(self, failures: list[tuple[str, Exception]]) -> None:
        super().__init__("; ".join(f"{step}: {cause}" for step, cause in failures))
        self.step = ", ".join(step for step, _ in failures)
        self.message = "; ".join(str(cause) for _, cause in failures)


def _now() -> datetime:
    return datetime.now(UTC)


def run(
    spark: SparkSession,
    read: Callable[[str], DataFrame],
    root: str,
    run_id: str,
    now: Callable[[], datetime] = _now,
) -> dict[str, int]:
    """Run once and return the row count of each table.

    `read(table)` gives an operational table. Failed steps are recorded with their names and
    raised, and the counts of what went well beside them; the version published before stays
    the one readers get.

    A run that failed, or died, goes on when it is called again with its id: tables that it has
    landed are not landed again. Only one call at a time may use an id, and none after success.
    """
    started = now()
    ledger = Ledger(spark, root, run_id)
    steps = [Row(step="start", at=started, message=None, table_name=None, row_count=None)]

    def land(table: str) -> Row | Exception:
        try:
            if (earlier := ledger.landed(table)) is not None:
                return earlier
            ledger.clear(f"raw/{table}/{started.date():%Y-%m-%d}/{run_id}")
            row = snapshots.land(read(table), root, table, run_id, started.date(), now())
            ledger.add(f"land {table}", row.asDict())
            return row
        except Exception as error:  # noqa: BLE001  kept until all tables have ended
            return error

    def done(step: str, table: str | None = None, rows: int | None = None) -> None:
        steps.append(Row(step=step, at=now(), message=None, table_name=table, row_count=rows))

    try:
        # Independent writes, submitted together so that small tables fill idle cores.
        with ThreadPoolExecutor(len(OPERATIONAL)) as pool:
            landed = dict(zip(OPERATIONAL, pool.map(land, OPERATIONAL), strict=True))
        failures = []
        for table, outcome in landed.items():
            if isinstance(outcome, Exception):
                failures.append((f"land {table}", outcome))
            else:
                done(f"land {table}", table, outcome.row_count)
        if failures:
            raise RunFailed(failures) from failures[0][1]
        with _step("record snapshots"):
            if not (ledger.resumed and ledger.recorded()):
                snapshots.record(spark, root, list(landed.values()))
        with _step("build warehouse"):
            built = ledger.done("build warehouse")
            if built is None:
                ledger.clear(f"warehouse/{run_id}")
                tables = snapshots.run_tables(spark, root, run_id)
                built = snapshots.write_version(star.build(tables), root, run_id)
                ledger.add("build warehouse", built)
        for table, rows in built.items():
            done("build warehouse", table, rows)
        with _step("publish"):
            if not (ledger.resumed and ledger.published()):
                snapshots.publish(spark, root, run_id, now(), built)
        done("publish")
    except RunFailed as failure:
        failed = Row(
            step=failure.step, at=now(), message=failure.message, table_name=None, row_count=None
        )
        steps.append(failed)
        _finish(spark, root, run_id, steps)
        raise
    _finish(spark, root, run_id, steps)
    return {s.table_name: s.row_count for s in steps if s.table_name}


class Ledger:
    """The finished steps of a run, one file each below <root>/ledger/<run id>/.

    A step is entered when what it has written is whole. A run that ended well is not resumed:
    its steps do not count for another call.
    """

    def __init__(self, spark: SparkSession, root: str, run_id: str) -> None:
        self.spark, self.root, self.run_id = spark, root, run_id
        self.folder = f"{root}/ledger/{run_id}"
        self.steps = set(commits.listed(spark, self.folder))
        ended = snapshots.run_history(spark, root).filter(F.col("run_id") == run_id)
        #: Whether an earlier call has begun this run and did not end it well.
        self.resumed = "begun.json" in self.steps and ended.filter("status = 'success'").isEmpty()
        if not self.steps:
            commits.put_if_absent(spark, f"{self.folder}/begun.json", "{}")

    def add(self, step: str, values: dict) -> None:
        text = json.dumps(values, default=lambda v: v.isoformat())
        commits.put_if_absent(self.spark, f"{self.folder}/{step}.json", text)

    def done(self, step: str) -> dict | None:
        if not self.resumed or f"{step}.json" not in self.steps:
            return None
        return json.loads(commits.text_of(self.spark, f"{self.folder}/{step}.json"))

    def landed(self, table: str) -> Row | None:
        values = self.done(f"land {table}")
        if values is None:
            return None
        at = datetime.fromisoformat(values["committed_at"])
        day = date.fromisoformat(values["load_date"])
        return Row(**values | {"committed_at": at, "load_date": day})

    def clear(self, path: str) -> None:
        """Remove what an earlier try has left of a step that it did not finish."""
        if self.resumed:
            session.remove(self.spark, [f"{self.root}/{path}"])

    def recorded(self) -> bool:
        rows = snapshots.manifest(self.spark, self.root)
        return not rows.filter(F.col("run_id") == self.run_id).isEmpty()

    def published(self) -> bool:
        rows = snapshots.published(self.spark, self.root)
        return not rows.filter(F.col("run_id") == self.run_id).isEmpty()


@contextmanager
def _step(name: str) -> Iterator[None]:
    try:
        yield
    except Exception as error:
        raise RunFailed([(name, error)]) from error


def _finish(spark: SparkSession, root: str, run_id: str, steps: list[Row]) -> None:
    rows = [Row(run_id=run_id, step_no=i, **s.asDict()) for i, s in enumerate(steps)]
    history = runs.run_history(spark.createDataFrame(rows, STEPS))
    snapshots.add_run(spark, root, history.select(*RUNS.names).first())

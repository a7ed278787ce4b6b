"""Standing reports: each batch of sales is added to states that the reports are read from.

    <root>/reports/   a log of commits (`sources/commits.py`), its files are states of batches
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_engine import session
from retail_engine.operators import increments
from retail_engine.schemas import REPORT_STATES
from retail_engine.sources import commits
from retail_engine.sources.commits import Commit, Conflict, File, State

#: States of so many batches are folded into one.
FOLD_EVERY = 50


def _root(root: str) -> str:
    return f"{root}/reports"


def _written(
    spark: SparkSession, root: str, name: str, state: DataFrame, base: str
) -> list[File]:
    path = f"{base}/{name}"
    state.write.option("compression", "zstd").parquet(f"{root}/{path}")
    found = commits.listed(spark, f"{root}/{path}")
    return [File(name, f"{path}/{f}", n) for f, n in found.items() if f.endswith(".parquet")]


def add_sales(
    spark: SparkSession,
    root: str,
    batch_id: str,
    fact: DataFrame,
    dim_customer: DataFrame,
    at: datetime,
) -> State:
    """Add a batch of sales to the standing reports; nothing but the batch is read.

    A batch id counts once. `fact` is read once a state.
    """
    root = _root(root)
    state = commits.read(spark, root)
    if commits.batches(spark, root).where(F.col("batch_id") == batch_id).count():
        raise ValueError(f"batch {batch_id} is already committed")
    base, files = f"states/{uuid.uuid4().hex}", []
    for name, part in increments.states(fact, dim_customer).items():
        files += _written(spark, root, name, part, base)
    change = Commit(kind="batch", at=at, files=tuple(files), batch_id=batch_id)
    state = commits.commit(spark, root, state, change)
    if len({f.path.split("/")[1] for f in state.files.values()}) > FOLD_EVERY:
        state = fold(spark, root.removesuffix("/reports"), at) or state
    return state


def states(spark: SparkSession, root: str, state: State | None = None) -> dict[str, DataFrame]:
    """The states of all batches, as they were written: the reports merge them."""
    root = _root(root)
    state = state or commits.read(spark, root)
    found = {}
    for name, schema in REPORT_STATES.items():
        paths = [f"{root}/{f.path}" for f in state.of(name)]
        read = spark.read.schema(schema)
        found[name] = read.parquet(*paths) if paths else spark.createDataFrame([], schema)
    return found


def fold(spark: SparkSession, root: str, at: datetime) -> State | None:
    """Merge the states of all batches into one; None when another job did so first."""
    state = commits.read(spark, _root(root))
    base, files = f"states/{uuid.uuid4().hex}", []
    for name, parts in states(spark, root, state).items():
        merged = increments.merged(parts, name)
        files += _written(spark, _root(root), name, merged, base)
    change = Commit(
        kind="fold", at=at, files=tuple(files), gone=tuple(state.files), same_rows=True
    )
    try:
        return commits.commit(spark, _root(root), state, change)
    except Conflict:
        session.remove(spark, [f"{_root(root)}/{base}"])
        return None

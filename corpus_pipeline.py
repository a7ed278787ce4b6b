"""The corpus pipeline: each stage's result is written and read as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retail_engine.llm import queries, stages
from retail_engine.llm.common import shared_folder, working_tables
from retail_engine.session import remove

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Working tables of the stages that have ended, to be deleted when another begins.
_left: list[str] = []


def _stage(work: Callable[[DataFrame], DataFrame]) -> Stage:
    """A stage that first deletes the working tables of the one before, whose result is written."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _left)
        _left.clear()
        with working_tables() as folders:
            found = work(docs)
        _left.extend(folders)
        return found

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality", _stage(stages.of_quality)),
    ("near_duplicates", _stage(stages.without_near_duplicates)),
    ("personal_data", _stage(lambda docs: stages.without_personal_data(docs, queries.SECRET))),
    ("mixing", _stage(stages.at_target_weights)),
    ("packing", _stage(queries.packed_documents)),
]

#: No SQL gives these rows: the stages iterate, draw and pack.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Small helpers shared by the operators: whole-text Python passes and column checks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import bindery.llm

# Functions of this package travel to the executors with the job, which need not have it.
cloudpickle.register_pickle_by_value(bindery.llm)

#: Rows in one Arrow batch are also bounded by bytes, so that very long texts do not pile up.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plain(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns, under fixed names (``{fixed: given}``); extra columns and
    clashing names in ``df`` cannot reach an operator."""
    return df.select(*[F.col(f"`{given}`").alias(fixed) for fixed, given in columns.items()])


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a null text as the empty one."""
    return plain(df, {"doc_id": id_col, "text": text_col}).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches to Python end after ``BATCH_BYTES`` as well as after a row count.

    Spark reads this setting when a plan runs, which is after the operator has returned, so it stays
    set in the session of the caller.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def per_text(
    df: DataFrame, make: Callable[[], Callable[[list], list[tuple]]], schema: str
) -> DataFrame:
    """Rows of ``schema`` for each batch of (doc_id, text, ...) columns.

    ``make`` runs once per task and returns a function from the batch's columns (as Python
    lists) to rows. Batches stream, so memory is one batch whatever the size of a task.
    """
    bounded_batches(df.sparkSession)
    target = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        step = make()
        for batch in batches:
            rows = step([batch.column(i).to_pylist() for i in range(batch.num_columns)])
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)],
                schema=arrow,
            )
        pa.default_memory_pool().release_unused()  # the worker lives on after its task

    return df.mapInArrow(run, target)


def setting(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(name, str(default)))


def partitions(spark: SparkSession) -> int:
    return setting(spark, "spark.sql.shuffle.partitions", 200)


def one_thread() -> None:
    """Tokenizer libraries start a thread per core unless told otherwise."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"

"""Writing an intermediate table where every executor can read it again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local master gets a folder of its own when the setting is missing; on a
    cluster a machine-local folder would be lost with its machine, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="bindery-"))
    return sc.getCheckpointDir()


def ready_checkpoints(spark: SparkSession) -> None:
    """Make sure that Spark's own checkpoints go to the shared folder too."""
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)


def staged(df: DataFrame, label: str = "table", by: Sequence[str] = ()) -> DataFrame:
    """``df`` written once as Parquet, in a folder for each value of ``by``, and read back.

    The result has no lineage behind it, knows its size (so joins can be planned on
    it) and still prunes columns. Use it for a table that later steps read twice.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Session settings that every query relies on."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch. Documents have a few KB each and some have MBs, so
#: Spark's default of 10,000 rows would need hundreds of MB in a Python worker.
ARROW_ROWS = "1000"
_DEFAULT_ARROW_ROWS = "10000"


def prepare(spark: SparkSession) -> SparkSession:
    """Make a session fit for this library; a setting the user changed stays.

    * Small Arrow batches, so that Python memory is bounded.
    * Python workers find this package although it isn't installed, and use one
      thread each for matrix products: there is a worker for each core already.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", _DEFAULT_ARROW_ROWS) == _DEFAULT_ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    env.setdefault("OPENBLAS_NUM_THREADS", "1")
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
    return spark


def spread(df: DataFrame, rows: int = 5000) -> DataFrame:
    """The same rows dealt over one task for each ``rows`` of them, before work that is heavy for each row.

    A small file is one task however many rows it has, and a task is one core.
    """
    return df.repartition(max(1, -(-df.count() // rows)))


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """A table of a data folder, by Spark's reader only (any file system)."""
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

"""Written tables that cut lineage and survive the loss of executors.

A table goes to the folder that the cluster names in ``spark.checkpoint.dir``
(shared by the driver and all executors). Only where that setting is missing,
as in tests, a folder of our own is used and the setting is filled in.
"""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The folder for written tables, from the session. Where it is unset, one of our own is set in a local session; a cluster must name it."""
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_SETTING} must name a folder that the driver and all executors share")
        root = f"/tmp/checkpoints/millrace-{os.getpid()}"
        spark.conf.set(_SETTING, root)
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone already; the folder is then the cluster's to clean
        pass


def materialize(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; digests are best left uncompressed (``none``).

    The result has no lineage behind it: a lost executor costs the tasks it
    ran, not the history of an iteration. Tables go when the session ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).option("parquet.enable.dictionary", str(compression != "none").lower()).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a written table that no later plan reads."""
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        _remove(df.sparkSession, f)

"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows per Arrow batch; documents run to hundreds of kilobytes, so batches stay small.
ARROW_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: at most ARROW_ROWS rows in an Arrow batch, for the session (Spark reads it when a plan runs, not when it is made)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names. In local mode, where every task sees this machine's disk, a temporary one if none is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.millrace_path = path
    return held


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(held: DataFrame) -> None:
    """Delete a table made by ``materialize`` that nothing will read again."""
    if path := getattr(held, "millrace_path", None):
        _delete(held.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application materialized, once its results are written."""
    _delete(spark, _own_dir(spark))


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"

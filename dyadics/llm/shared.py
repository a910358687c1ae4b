"""Tables cut from their lineage, kept where every executor can read them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Rows of 8 to 16 bytes that a broadcast may hold: some 50 MB on each executor.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``. Its tables back the operators' results, so they live as
    long as the application; ``release`` removes them when no result is needed any more."""
    return f"{shared_folder(spark)}/dyadics-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; results that were not written before are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more."""
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, so that lost executors cost no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its ``rows`` are within the bound; otherwise Spark joins it by a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df

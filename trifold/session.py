"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only in a single local process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, which cuts its lineage and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store that Spark reads; none if it isn't there."""
    files, at = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate result that nothing reads any more."""
    files, at = _file_system(spark, path)
    files.delete(at, True)


def small(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it has ``limit`` rows at most; as it is beyond."""
    df = durable(df)
    return F.broadcast(df) if df.count() <= limit else df

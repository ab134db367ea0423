"""New folders in the one that the cluster shares, gone when the driver's process ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def folder(spark: SparkSession) -> str:
    """Below ``spark.checkpoint.dir``; where that is unset and all tasks run on this machine (tests), a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not named and not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{named.rstrip('/')}/tables-{uuid.uuid4().hex}" if named else f"file://{tempfile.mkdtemp(prefix='tessella-')}"
    if not _made:
        atexit.register(_remove, spark)
    _made.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write a table once that a plan reads several times."""
    path = f"{folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession) -> None:
    try:
        jvm = spark.sparkContext._jvm
        for path in _made:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may have gone first
        pass

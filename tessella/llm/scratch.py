"""Tables that cut lineage, kept in the folder that the cluster shares until they are no longer read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and all tasks run in this process' machine (tests), a folder
    of our own. On a cluster without it there is no folder that all can see: an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; what is in it is deleted when the driver's process ends, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_all, spark)
    _made.add(path)
    return path


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    spark.sparkContext._jvm.System.gc()  # Spark drops the shuffle files of what is garbage; they would stay long otherwise
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._stored_at)


def free_names(df: DataFrame, n: int) -> list[str]:
    """``n`` names that no column of ``df`` has, whatever their case."""
    longest = max(map(len, df.columns), default=0)
    return [f"{'_' * (longest + 1)}{k}" for k in range(n)]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`fresh_path` named, through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _made.discard(path)


def _remove_all(spark: SparkSession) -> None:
    try:
        for path in list(_made):
            remove(spark, path)
    except Exception:  # the JVM may have gone first; whoever runs the cluster may empty the folder
        pass

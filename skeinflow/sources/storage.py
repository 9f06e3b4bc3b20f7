"""The folder that driver and executors share, and written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where the setting is absent and Spark is local, as in tests.

    On a cluster a temporary folder of the driver would be another folder on each executor, so there the setting is required.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not is_local(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="skeinflow-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
        found = context.getCheckpointDir()
    return found.rstrip("/")


def is_local(master: str) -> bool:
    """Do driver and executors share one process."""
    return master == "local" or master.startswith("local[")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    _made.append(f"{shared_dir(spark)}/skeinflow/{uuid.uuid4().hex}")
    return _made[-1]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """For ``sweep``: what is written from here on."""
    return len(_made)


def sweep(spark: SparkSession, since: int = 0, keep_last: bool = False) -> int:
    """Delete the tables written since a mark, but for the last one where ``keep_last``; how many.

    Only for tables that no DataFrame in use reads any more.
    """
    end = len(_made) - keep_last
    gone, _made[since:end] = _made[since:end], []
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in gone:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(gone)

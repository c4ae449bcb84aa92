"""Intermediate results in storage that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is empty (tests on one machine) a folder of our own is made and remembered.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        folder = tempfile.mkdtemp(prefix="erlink-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Whether an execution deletes its shuffle files when it is done (Spark 4.1).
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete the intermediate results of this process. No DataFrame that reads them may be used after that."""
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors.

    Its shuffle files go as soon as it is written, since nothing reads them again; otherwise they would stay until the driver
    happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/erlink-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """``df`` partitioned and sorted by ``key`` and checkpointed so: what groups by the key later moves nothing of it.

    The checkpoint lies in the shared folder, so lost executors cost nothing; as it knows how it is partitioned, joins and
    cogroups bring the other side to it. Fewer partitions than the session's default would be shuffled once more.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    n = max(int(partitions), int(spark.conf.get("spark.sql.shuffle.partitions")))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan does not tell how its result is partitioned
    try:
        return df.repartition(n, key).sortWithinPartitions(key).checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)

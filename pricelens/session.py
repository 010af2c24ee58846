"""Session settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # hot join keys are split at run time, also when that costs an extra exchange
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# what a task reads at once, by Spark's default and here: what is held of it unpacked takes many times its size
_READ_AT_ONCE = {
    "spark.sql.files.maxPartitionBytes": ("134217728b", "32m"),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": ("67108864b", "32m"),
}


# work folders of local sessions that name none
_local_dirs: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; everything else is left to the caller."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    for key, (default, value) in _READ_AT_ONCE.items():
        if spark.conf.get(key) == default:  # a caller's own size stays
            spark.conf.set(key, value)
    return spark


@contextmanager
def kept_partitions(spark: SparkSession) -> Iterator[None]:
    """Joins planned inside keep sides that are already partitioned by some of the join keys."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a folder of its own, because a machine-local
    folder would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="pricelens-")
    return _local_dirs[app]


def new_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the application's part of the shared folder, which can
    be dropped as a whole when the application has ended."""
    return os.path.join(work_dir(spark), spark.sparkContext.applicationId, f"{purpose}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    return staged(df)[0]


def staged(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``cut_lineage``, with the folder, for jobs that know when its last reader is done."""
    spark = df.sparkSession
    path = new_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a staged folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

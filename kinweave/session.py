"""Session defaults and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

# Every setting is a default: anything the cluster already configured wins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_local_scratch: dict[str, str] = {}
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def get_session(app_name: str = "kinweave", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may fall back to a temporary folder: on a
    cluster a machine-local folder is gone with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _local_scratch:
        _local_scratch[context.applicationId] = tempfile.mkdtemp(prefix="kinweave-")
    return _local_scratch[context.applicationId]


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared folder."""
    return f"{shared_dir(spark)}/kinweave/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once nothing reads them any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def placed(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins by key: never broadcast, however small its files are.

    Names and paths take little space in a file and much more in memory, so a
    table that grows with the input can look small enough to go through the
    driver. What is derived from ``df`` without a join keeps this.
    """
    return df.hint("merge")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    Unlike a cached block the result survives lost executors, and unlike
    ``checkpoint()`` it carries exact size statistics, so Catalyst broadcasts a
    small table and shuffles a large one without a hint.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _written[stored] = path
    return stored


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more; other tables are left alone.

    Spark deletes shuffle files when nothing on the driver refers to them any
    more, so those of finished work go as well.
    """
    for path in [_written.pop(t) for t in tables if t in _written]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark._jvm.System.gc()

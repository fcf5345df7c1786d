"""Where intermediate tables go: the folder that the session names, shared by all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's shared scratch folder. Only a local session (tests) without one gets a folder of its own; on a
    cluster, where executors would each write to their own disk, that is an error."""
    known = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not known:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {_KEY} to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="trekframe-")
        spark.conf.set(_KEY, known)
    return known.rstrip("/")


def scratch_path(spark: SparkSession, label: str = "t") -> str:
    """A new path under the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/trekframe-{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")  # the write's shuffle files are of no more use once it is done
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    return spark.read.schema(schema).parquet(path)

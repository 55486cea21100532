"""Cutting the lineage of loops."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> None:
    """Have checkpoints written to the shared folder that the session names.

    Where it names none, as in tests, they go under /tmp, but on a local master alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or "/tmp/ferrule-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of `df`."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Whether Spark deletes a query's shuffle files when the query ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """`df`, written as compressed columns beside the checkpoints and read again; what was shuffled for it is deleted.

    The table goes when the driver ends; `keep` collects the folder names, for drop()."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    atexit.register(_leave, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    if keep is not None:
        keep.append(path)
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that written() wrote."""
    for path in paths:
        _leave(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    paths.clear()


def forget(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and cached blocks of what nothing refers to any more.

    Spark does so when the driver happens to collect its garbage, which may be never while executors' disks fill up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _leave(jvm, conf, folder: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # the engine has gone already
        pass

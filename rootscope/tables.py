"""Tables in the cluster's shared folder, for results that are read more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, in local mode alone, one in /tmp is set for the session."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file:///tmp/rootscope-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
        file_system(spark, path)[0].deleteOnExit(file_system(spark, path)[1])
    return path.rstrip("/")


def file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again, so that no executor's loss repeats its work.

    The folder is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # The table takes the place of the shuffles that made it: their files go when it is written.
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def together(df: DataFrame, *keys: str) -> DataFrame:
    """df with the rows of equal keys in one partition, by a shuffle of its own.

    A plain repartition by the keys is left out of the plan where df seems to be partitioned so already, as a union of joins on
    them does. Adaptive execution then coalesces or splits the sides each on its own, and as Python stages require no
    distribution, nothing brings the keys together again. No plan has the partitioning of a hash of the keys.
    """
    return df.repartition(F.xxhash64(*keys))


def unique_name(df: DataFrame, wanted: str) -> str:
    """wanted, lengthened until it clashes with no column of df."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted

"""The folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, below the warehouse, and only if all runs on one machine. It goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.scratch"
    own = f"{root.rstrip('/')}/retrieval-{spark.sparkContext.applicationId}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return f"{own}/{tag}-{uuid.uuid4().hex[:12]}"


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back; the shuffle files that it took go when it is written."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, tag)
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
